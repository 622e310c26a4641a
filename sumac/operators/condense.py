"""Records condensed to the classes that many queries tell apart, so that a pass over all records adds up a few numbers for
each class and the queries read the classes. A value's class in a field is which of the queries' conditions on it hold."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import stored
from . import aggregates as A
from . import predicates as P

#: Queries whose conditions name so many fields together share a pass.
FIELDS = 3
#: The column that tells which pass a class is of.
PASS = "__pass"
#: Conditions that fit in one number; a field with more of them is kept by value.
BITS = 62


def leaves(p: P.Predicate | None) -> list[P.Predicate]:
    if p is None:
        return []
    return [x for part in p.parts for x in leaves(part)] if isinstance(p, (P.And, P.Or)) else [p]


def conditions(q: A.Query) -> list[P.Predicate]:
    """All conditions on one field that the query's answer depends on."""
    a = q.aggregation
    parts = [a.numerator] if isinstance(a, A.Proportion) else [a.a, a.b] if isinstance(a, A.Comparison) else []
    return [x for p in (q.scope, *parts) for x in leaves(p)]


def by_value(q: A.Query) -> set[str]:
    """Fields whose values the answer names or counts."""
    a = q.aggregation
    return {a.group} if isinstance(a, A.TopK) else {a.field} if isinstance(a, A.Count) and a.field else set()


def named(q: A.Query) -> set[str]:
    times = {q.aggregation.time} if isinstance(q.aggregation, A.Trend) else set()
    return {x.field for x in conditions(q)} | by_value(q) | times


def measured(q: A.Query) -> set[str]:
    a = q.aggregation
    return set() if isinstance(a, (A.Count, A.Proportion)) or a.field is None else {a.field}


def passes(queries: list[A.Query]) -> list[tuple[list[str], list[A.Query]]]:
    """The fields of each pass and its queries."""
    found: list[set[str]] = []
    for fields in sorted({tuple(sorted(named(q))) for q in queries}, key=lambda x: (-len(x), x)):
        home = next((s for s in found if len(s | set(fields)) <= max(len(s), FIELDS)), None)
        found.append(set(fields)) if home is None else home.update(fields)
    at = lambda q: next(k for k, s in enumerate(found) if named(q) <= s)
    return [(sorted(s), [q for q in queries if at(q) == k]) for k, s in enumerate(found)]


def within_passes(queries: list[A.Query]) -> list[A.Query]:
    """The queries as they are asked of the classes."""
    own = {q.query_id: P.Eq(PASS, k) for k, (_, qs) in enumerate(passes(queries)) for q in qs}
    return [replace(q, scope=own[q.query_id] if q.scope is None else P.And((own[q.query_id], q.scope))) for q in queries]


def classed(fields: list[str], queries: list[A.Query], kinds: dict[str, str]) -> dict[str, list[P.Predicate] | None]:
    """By field: the conditions that make its classes, or None if it is kept by value (texts and booleans always are)."""
    whole = set().union(*map(by_value, queries))
    out: dict[str, list[P.Predicate] | None] = {}
    for f in fields:
        asked = list(dict.fromkeys(x for q in queries for x in conditions(q) if x.field == f))
        out[f] = None if f in whole or kinds[f] in ("string", "boolean") or len(asked) > BITS else asked
    return out


def measures(queries: list[A.Query]) -> list[str]:
    return sorted(set().union(*map(measured, queries)))


def times(queries: list[A.Query]) -> list[str]:
    return sorted({q.aggregation.time for q in queries if isinstance(q.aggregation, A.Trend)})


def condense(df: DataFrame, queries: list[A.Query], apart: tuple[str, ...] = ()) -> DataFrame:
    """The classes of all passes, written once: a value of each field, N records, and sums and numbers of the measures.
    Ask them within_passes(queries). Records that differ in the columns `apart` are in different classes."""
    kinds, out = dict(df.dtypes), []
    for f in set().union(*(named(q) | measured(q) for q in queries)):
        P.check(P.NotNull(f), df.columns)
    for k, (fields, qs) in enumerate(passes(queries)):
        keys, kept = [], []
        for f, asked in classed(fields, qs, kinds).items():
            if asked is None:
                keys.append(F.col(f))
                continue
            bits = [F.shiftleft(F.coalesce(P.compile(x, df), F.lit(False)).cast("long"), i) for i, x in enumerate(asked)]
            keys.append(reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0).cast("long")).alias(f"__class_{f}"))
            kept.append(F.min(f).alias(f))
        keys += [(F.year(t) * 12 + F.month(t)).alias(f"__month_{t}") for t in times(qs)]
        sums = [x for m in measures(qs) for x in (F.sum(A.number(df, m)).alias(A.SUM + m), F.count(A.number(df, m)).alias(A.NUMBER + m))]
        rows = df.groupBy(*keys, *apart).agg(F.count("*").alias(A.N), *kept, *sums)
        out.append(rows.select(F.lit(k).alias(PASS), *fields, *apart, A.N, *[c for m in measures(qs) for c in (A.SUM + m, A.NUMBER + m)]))
    return stored(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out))


def condense_text(spark: SparkSession, queries: list[A.Query], view: str) -> DataFrame:
    """The same by way of SQL text over a view."""
    kinds, out = dict(spark.table(view).dtypes), []
    for k, (fields, qs) in enumerate(passes(queries)):
        keys, kept = [], []
        for f, asked in classed(fields, qs, kinds).items():
            keys.append(f if asked is None else " | ".join(["0L", *(f"IF({P.to_sql(x)}, {1 << i}L, 0L)" for i, x in enumerate(asked))]))
            kept.append(f if asked is None else f"MIN({f}) AS {f}")
        keys += [f"year({t}) * 100 + month({t})" for t in times(qs)]
        sums = [f"SUM({A.number_sql(m)}) AS {A.SUM}{m}, COUNT({A.number_sql(m)}) AS {A.NUMBER}{m}" for m in measures(qs)]
        out.append(f"SELECT {', '.join([f'{k} AS {PASS}', *kept, f'COUNT(*) AS {A.N}', *sums])} FROM {view} GROUP BY {', '.join(keys) or '()'}")
    return stored(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(spark.sql, out)))
