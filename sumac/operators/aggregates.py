"""Query specs and their evaluation: one at a time, as SQL text, or many in one pass over the records.

A result is tall: query_id, rank, key, value. Scalars have rank 1 and a null key; a comparison has the keys
difference and ratio; top-k and trend have a row a group.
"""

from __future__ import annotations

import hashlib
import json
from collections import defaultdict
from dataclasses import dataclass, field, is_dataclass
from functools import singledispatch
from typing import Union

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import stored
from . import predicates as P

RESULT = "query_id string, rank int, key string, value double"
#: Columns of rows that stand for many records (see condense): how many, and a field's sum and number of values.
N, SUM, NUMBER = "__n", "__sum_", "__number_"


@dataclass(frozen=True)
class Count:
    field: str | None = None  # distinct values of it if given


@dataclass(frozen=True)
class Sum:
    field: str
    nulls: str = "exclude"


@dataclass(frozen=True)
class Mean:
    field: str
    nulls: str = "exclude"  # exclude, as_zero or as_null
    places: int = 4


@dataclass(frozen=True)
class Proportion:
    numerator: P.Predicate
    places: int = 4


@dataclass(frozen=True)
class Comparison:
    a: P.Predicate
    b: P.Predicate
    measure: str = "count"  # count, mean or sum
    field: str | None = None
    output: str = "both"  # difference, ratio or both


@dataclass(frozen=True)
class TopK:
    group: str
    k: int = 5
    measure: str = "count"
    field: str | None = None
    descending: bool = True
    ties: str = "first"  # first, all or random_stable (the same as first)


@dataclass(frozen=True)
class Trend:
    bucket: str = "month"  # month, quarter or year
    measure: str = "count"
    field: str | None = None
    nulls: str = "exclude"
    time: str = "event_time"


Aggregation = Union[Count, Sum, Mean, Proportion, Comparison, TopK, Trend]


@dataclass(frozen=True)
class Query:
    query_id: str
    aggregation: Aggregation
    scope: P.Predicate | None = None
    facts: tuple[str, ...] = ()
    tags: dict = field(default_factory=dict, compare=False, hash=False)


def canonical(x) -> object:
    if isinstance(x, tuple(P.KINDS.values())):
        return P.to_dict(x)
    if is_dataclass(x):
        return {"kind": type(x).__name__.lower()} | {k: canonical(v) for k, v in vars(x).items() if k != "tags"}
    return list(map(canonical, x)) if isinstance(x, (tuple, list)) else x


def spec_hash(q: Query) -> str:
    """32 hex digits that depend on what is asked, not on the id or the tags."""
    text = json.dumps({"scope": P.to_dict(q.scope), "aggregation": canonical(q.aggregation), "facts": sorted(q.facts)}, sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def scoped(df: DataFrame, q: Query) -> Column:
    return F.lit(True) if q.scope is None else F.coalesce(P.compile(q.scope, df), F.lit(False))


def number(df: DataFrame, name: str) -> Column:
    """A field as a double; a boolean as 0 or 1, a text that is no number as null."""
    P.check(P.NotNull(name), df.columns)
    kind = dict(df.dtypes)[name]
    return F.col(name).cast("int").cast("double") if kind == "boolean" else F.col(name).try_cast("double")


def with_nulls(x: Column, nulls: str) -> Column:
    return F.coalesce(x, F.lit(0.0)) if nulls == "as_zero" else x


def counted(df: DataFrame, inside: Column) -> Column:
    """Aggregate: the records that are inside."""
    return F.coalesce(F.sum(F.when(inside, F.col(N))), F.lit(0)) if N in df.columns else F.count_if(inside)


def summed(df: DataFrame, inside: Column, name: str, nulls: str = "exclude") -> Column:
    return F.sum(F.when(inside, with_nulls(F.col(SUM + name) if N in df.columns else number(df, name), nulls)))


def averaged(df: DataFrame, inside: Column, name: str, nulls: str = "exclude") -> Column:
    if N not in df.columns:
        return F.avg(F.when(inside, with_nulls(number(df, name), nulls)))
    return summed(df, inside, name, nulls) / F.nullif(F.sum(F.when(inside, F.col(N if nulls == "as_zero" else NUMBER + name))), F.lit(0))


def bucket_of(trend: Trend) -> Column:
    t = F.col(trend.time)
    if trend.bucket == "month":
        return F.date_format(t, "yyyy-MM")
    if trend.bucket == "quarter":
        return F.concat(F.year(t).cast("string"), F.lit("-Q"), F.quarter(t).cast("string"))
    return F.year(t).cast("string")


@singledispatch
def values(spec, df: DataFrame, inside: Column) -> dict[str | None, Column]:
    """The aggregate Columns of a scalar spec over the rows that are inside, by key."""
    raise TypeError(f"no scalar spec: {spec}")


@values.register
def _(spec: Count, df, inside):
    if spec.field is None:
        return {None: counted(df, inside).cast("double")}
    P.check(P.NotNull(spec.field), df.columns)
    return {None: F.count_distinct(F.when(inside, F.col(spec.field))).cast("double")}


@values.register
def _(spec: Sum, df, inside):
    return {None: F.coalesce(summed(df, inside, spec.field), F.lit(0.0))}


@values.register
def _(spec: Mean, df, inside):
    return {None: F.round(averaged(df, inside, spec.field, spec.nulls), spec.places)}


@values.register
def _(spec: Proportion, df, inside):
    part = counted(df, inside & F.coalesce(P.compile(spec.numerator, df), F.lit(False)))
    return {None: F.round(part / F.nullif(counted(df, inside), F.lit(0)), spec.places)}


@values.register
def _(spec: Comparison, df, inside):
    def side(p: P.Predicate) -> Column:
        row = inside & F.coalesce(P.compile(p, df), F.lit(False))
        n = counted(df, row)
        if spec.measure == "count":
            return F.nullif(n, F.lit(0)).cast("double")
        return averaged(df, row, spec.field) if spec.measure == "mean" else F.when(n > 0, F.coalesce(summed(df, row, spec.field), F.lit(0.0)))

    a, b = side(spec.a), side(spec.b)
    out = {"difference": F.round(a - b, 6), "ratio": F.round(a / F.nullif(b, F.lit(0.0)), 6)}
    return {k: v for k, v in out.items() if spec.output in (k, "both")}


def group_key(spec: TopK | Trend, df: DataFrame) -> Column:
    P.check(P.NotNull(spec.group if isinstance(spec, TopK) else spec.time), df.columns)
    return F.col(spec.group).cast("string") if isinstance(spec, TopK) else bucket_of(spec)


def group_value(spec: TopK | Trend, df: DataFrame, inside: Column) -> Column:
    """A group's measure; null where the group has no row inside, or a mean has nothing to average."""
    n = counted(df, inside)
    if spec.measure == "count":
        return F.nullif(n, F.lit(0)).cast("double")
    of = (df, inside, spec.field, getattr(spec, "nulls", "exclude"))
    return F.round(averaged(*of), 6) if spec.measure == "mean" else F.when(n > 0, F.round(F.coalesce(summed(*of), F.lit(0.0)), 6))


def unpivot(rows: DataFrame, keep: list[Column], parts: list[tuple[str, Column, Column]]) -> DataFrame:
    """One row for each part (query_id, key, value) of a wide row."""
    structs = [F.struct(F.lit(i).alias("query_id"), k.cast("string").alias("key"), v.cast("double").alias("value")) for i, k, v in parts]
    return rows.select(*keep, F.explode(F.array(*structs)).alias("x")).select("x.*")


def fields_of(spec, columns: list[str]) -> set[str]:
    """The columns that a query, or a part of one, can name."""
    if isinstance(spec, str):
        return {spec} & set(columns)
    parts = vars(spec).values() if hasattr(spec, "__dict__") else spec if isinstance(spec, (tuple, list, frozenset)) else ()
    return set().union(*[fields_of(x, columns) for x in parts])


def evaluate_batch(df: DataFrame, queries: list[Query], once: bool = False) -> DataFrame:
    """The results of many queries: all scalar ones in one aggregate, all grouped ones with the same group
    in another. The work is a pass over df for each distinct group, not for each query. With once, the columns that
    the queries name are written first and the passes read those, so whatever is behind df (a join) is done once."""
    empty = df.sparkSession.createDataFrame([], RESULT)
    if once:
        used = fields_of(queries, df.columns)
        df = stored(df.select([c for c in df.columns if c in used] or df.columns[:1]))
    scalar = [q for q in queries if not isinstance(q.aggregation, (TopK, Trend))]
    out = []
    if scalar:
        cells = [(q, k, c, f"c{n}_{m}") for n, q in enumerate(scalar) for m, (k, c) in enumerate(values(q.aggregation, df, scoped(df, q)).items())]
        wide = df.agg(*[c.alias(name) for _, _, c, name in cells])
        tall = unpivot(wide, [], [(q.query_id, F.lit(k), F.col(name)) for q, k, _, name in cells])
        out.append(tall.select("query_id", F.when(F.col("key") == "ratio", 2).otherwise(1).alias("rank"), "key", "value"))
    groups: dict[tuple, list[Query]] = defaultdict(list)
    for q in queries:
        if isinstance(q.aggregation, TopK):
            groups["top", q.aggregation.group].append(q)
        elif isinstance(q.aggregation, Trend):
            groups["trend", q.aggregation.bucket, q.aggregation.time].append(q)
    for qs in groups.values():
        keyed = df.withColumn("__key", group_key(qs[0].aggregation, df)).where(F.col("__key").isNotNull())
        wide = keyed.groupBy("__key").agg(*[group_value(q.aggregation, df, scoped(df, q)).alias(f"c{n}") for n, q in enumerate(qs)])
        tall = unpivot(wide, [], [(q.query_id, F.col("__key"), F.col(f"c{n}")) for n, q in enumerate(qs)]).where("value IS NOT NULL")
        options = F.create_map(*[x for q in qs for x in (F.lit(q.query_id), F.struct(*[F.lit(v).alias(k) for k, v in order_of(q.aggregation).items()]))])
        tall = tall.withColumn("o", options[F.col("query_id")])
        by = F.when(F.col("o.kind") == "trend", F.lit(0.0)).when(F.col("o.down"), -F.col("value")).otherwise(F.col("value"))
        tied, w = Window.partitionBy("query_id").orderBy("by"), Window.partitionBy("query_id").orderBy("by", "key")
        ranked = tall.withColumn("by", by).withColumn("tied", F.rank().over(tied))
        if isinstance(qs[0].aggregation, TopK):  # each task keeps the best of its groups before they meet
            ranked = ranked.where(F.col("tied") <= max(q.aggregation.k for q in qs))
        ranked = ranked.withColumn("rank", F.row_number().over(w))
        out.append(ranked.where(F.when(F.col("o.all"), F.col("tied")).otherwise(F.col("rank")) <= F.col("o.k")).select("query_id", "rank", "key", "value"))
    for x in out:
        empty = empty.unionByName(x)
    return empty


def order_of(spec: TopK | Trend) -> dict:
    if isinstance(spec, Trend):
        return {"kind": "trend", "down": False, "all": False, "k": 1 << 30}
    if not 1 <= spec.k <= 100:
        raise ValueError("k is from 1 to 100")
    return {"kind": "top", "down": spec.descending, "all": spec.ties == "all", "k": spec.k}


def evaluate(df: DataFrame, q: Query) -> DataFrame:
    """The result of one query. The scope is a filter, so it reaches the scan; a top-k is a bounded sort."""
    inside = df if q.scope is None else df.where(P.compile(q.scope, df))
    spec = q.aggregation
    if isinstance(spec, (TopK, Trend)):
        rows = inside.select(group_key(spec, df).alias("key"), "*") if "key" not in df.columns else inside.withColumn("key", group_key(spec, df))
        rows = rows.where(F.col("key").isNotNull()).groupBy("key").agg(group_value(spec, df, F.lit(True)).alias("value")).where("value IS NOT NULL")
        if isinstance(spec, Trend):
            ranked = rows.withColumn("rank", F.row_number().over(Window.orderBy("key")))  # a row a time bucket
        else:
            o = order_of(spec)
            by = F.col("value").desc() if o["down"] else F.col("value").asc()
            if o["all"]:  # whatever is as good as the k-th; each task keeps its best before they meet
                rows = rows.withColumn("tied", F.rank().over(Window.orderBy(by))).where(F.col("tied") <= o["k"]).drop("tied")
            else:
                rows = rows.orderBy(by, "key").limit(o["k"])
            ranked = rows.withColumn("rank", F.row_number().over(Window.orderBy(by, "key")))
        return ranked.select(F.lit(q.query_id).alias("query_id"), "rank", "key", "value")
    cells = list(values(spec, df, F.lit(True)).items())
    wide = inside.agg(*[c.alias(f"c{n}") for n, (_, c) in enumerate(cells)])
    tall = unpivot(wide, [], [(q.query_id, F.lit(k), F.col(f"c{n}")) for n, (k, _) in enumerate(cells)])
    return tall.select("query_id", F.when(F.col("key") == "ratio", 2).otherwise(1).alias("rank"), "key", "value")


def number_sql(name: str) -> str:
    return f"CAST(CAST({name} AS INT) AS DOUBLE)" if name == "verified_purchase" else f"CAST({name} AS DOUBLE)"


def batch_sql(queries: list[Query], source: str, condensed: bool = False) -> list[str]:
    """Many queries as a few SQL statements over a table or view, one for all scalar ones and one for each distinct group:
    the text's own way to the rows of evaluate_batch. condensed: each row of the view stands for N records."""

    def count(where: str) -> str:
        return f"COALESCE(SUM({N}) FILTER (WHERE {where}), 0)" if condensed else f"COUNT(*) FILTER (WHERE {where})"

    def total(spec, where: str, nulls: str = "exclude") -> str:
        x = f"{SUM}{spec.field}" if condensed else number_sql(spec.field)
        return f"SUM({f'COALESCE({x}, 0.0)' if nulls == 'as_zero' else x}) FILTER (WHERE {where})"

    def mean(spec, where: str, nulls: str = "exclude") -> str:
        if not condensed:
            return "AVG" + total(spec, where, nulls).removeprefix("SUM")
        return f"({total(spec, where, nulls)} / NULLIF(SUM({N if nulls == 'as_zero' else NUMBER + spec.field}) FILTER (WHERE {where}), 0))"

    def folded(spec, where: str, nulls: str = "exclude") -> str:
        n = count(where)
        if spec.measure == "count":
            return f"CAST(NULLIF({n}, 0) AS DOUBLE)"
        return mean(spec, where, nulls) if spec.measure == "mean" else f"CASE WHEN {n} > 0 THEN COALESCE({total(spec, where, nulls)}, 0.0) END"

    def scalar(spec, where: str) -> list[tuple[str, int, str]]:
        n = count(where)
        if isinstance(spec, Count):
            return [("NULL", 1, f"COUNT(DISTINCT {spec.field}) FILTER (WHERE {where})" if spec.field else n)]
        if isinstance(spec, Sum):
            return [("NULL", 1, f"COALESCE({total(spec, where, spec.nulls)}, 0.0)")]
        if isinstance(spec, Mean):
            return [("NULL", 1, f"ROUND({mean(spec, where, spec.nulls)}, {spec.places})")]
        if isinstance(spec, Proportion):
            return [("NULL", 1, f"ROUND({count(f'{where} AND {P.to_sql(spec.numerator)}')} / NULLIF({n}, 0), {spec.places})")]
        a, b = (folded(spec, f"{where} AND {P.to_sql(p)}") for p in (spec.a, spec.b))
        cells = [("'difference'", 1, f"ROUND({a} - {b}, 6)"), ("'ratio'", 2, f"ROUND({a} / NULLIF({b}, 0.0), 6)")]
        return [c for c in cells if spec.output in (c[0].strip("'"), "both")]

    out, groups = [], defaultdict(list)
    cells = []
    for q in queries:
        if isinstance(q.aggregation, (TopK, Trend)):
            key, *_ = group_sql(q.aggregation)
            groups[key, isinstance(q.aggregation, TopK)].append(q)
        else:
            cells += [(q.query_id, *c) for c in scalar(q.aggregation, P.to_sql(q.scope))]
    if cells:
        wide = ", ".join(f"CAST({c[-1]} AS DOUBLE) AS c{i}" for i, c in enumerate(cells))
        rows = ", ".join(f"'{q}', {rank}, CAST({key} AS STRING), c{i}" for i, (q, key, rank, _) in enumerate(cells))
        out.append(f"SELECT stack({len(cells)}, {rows}) AS (query_id, rank, key, value) FROM (SELECT {wide} FROM {source}) w")
    for (key, top), qs in groups.items():
        wide = ", ".join(f"ROUND({folded(q.aggregation, P.to_sql(q.scope), getattr(q.aggregation, 'nulls', 'exclude'))}, 6) AS c{i}" for i, q in enumerate(qs))
        rows = ", ".join(f"'{q.query_id}', c{i}" for i, q in enumerate(qs))
        tall = f"SELECT key, stack({len(qs)}, {rows}) AS (query_id, value) FROM (SELECT {key} AS key, {wide} FROM {source} GROUP BY 1) w WHERE key IS NOT NULL"
        options = ", ".join(f"('{q.query_id}', {-1 if top and q.aggregation.descending else int(top)}, {top and q.aggregation.ties == 'all'}, {q.aggregation.k if top else 1 << 30})" for q in qs)
        ranks = f"SELECT *, RANK() OVER (PARTITION BY query_id ORDER BY value * sign) AS tied, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY value * sign, key) AS rank FROM ({tall}) t JOIN (VALUES {options}) AS o(query_id, sign, ties, k) USING (query_id) WHERE value IS NOT NULL"
        out.append(f"SELECT query_id, CAST(rank AS INT) AS rank, CAST(key AS STRING) AS key, value FROM ({ranks}) r WHERE CASE WHEN ties THEN tied ELSE rank END <= k")
    return out


def group_sql(spec: TopK | Trend) -> tuple[str, str]:
    """The key of a grouped query, and the field that it comes from, as SQL text."""
    if isinstance(spec, TopK):
        return f"CAST({spec.group} AS STRING)", spec.group
    year = f"CAST(year({spec.time}) AS STRING)"
    return {"month": f"CONCAT({year}, '-', LPAD(CAST(month({spec.time}) AS STRING), 2, '0'))", "quarter": f"CONCAT({year}, '-Q', CAST(quarter({spec.time}) AS STRING))", "year": year}[spec.bucket], spec.time


def to_sql(q: Query, source: str) -> str:
    """The query as SQL text over a table or view."""
    spec, where = q.aggregation, P.to_sql(q.scope)
    head = f"SELECT '{q.query_id}' AS query_id"
    x = f"CAST(CAST({spec.field} AS INT) AS DOUBLE)" if getattr(spec, "field", None) == "verified_purchase" else f"CAST({getattr(spec, 'field', None)} AS DOUBLE)"
    if getattr(spec, "nulls", None) == "as_zero":
        x = f"COALESCE({x}, 0.0)"
    one = lambda e: f"{head}, 1 AS rank, CAST(NULL AS STRING) AS key, CAST({e} AS DOUBLE) AS value FROM {source} WHERE {where}"
    if isinstance(spec, Count):
        return one(f"COUNT(DISTINCT {spec.field})" if spec.field else "COUNT(*)")
    if isinstance(spec, Sum):
        return one(f"COALESCE(SUM({x}), 0.0)")
    if isinstance(spec, Mean):
        return one(f"ROUND(AVG({x}), {spec.places})")
    if isinstance(spec, Proportion):
        return one(f"ROUND(CAST(COUNT(CASE WHEN {P.to_sql(spec.numerator)} THEN 1 END) AS DOUBLE) / NULLIF(COUNT(*), 0), {spec.places})")
    if isinstance(spec, Comparison):

        def side(p):
            w = P.to_sql(p)
            n = f"COUNT(CASE WHEN {w} THEN 1 END)"
            if spec.measure == "count":
                return f"CAST(NULLIF({n}, 0) AS DOUBLE)"
            v = f"(CASE WHEN {w} THEN {x} END)"
            return f"AVG{v}" if spec.measure == "mean" else f"(CASE WHEN {n} > 0 THEN COALESCE(SUM{v}, 0.0) END)"

        inner = f"SELECT {side(spec.a)} AS a, {side(spec.b)} AS b FROM {source} WHERE {where}"
        parts = [("difference", 1, "ROUND(a - b, 6)"), ("ratio", 2, "ROUND(a / NULLIF(b, 0.0), 6)")]
        return " UNION ALL ".join(f"{head}, {r} AS rank, '{k}' AS key, {e} AS value FROM ({inner}) s" for k, r, e in parts if spec.output in (k, "both"))
    measure = {"count": "CAST(COUNT(*) AS DOUBLE)", "mean": f"ROUND(AVG({x}), 6)", "sum": f"ROUND(COALESCE(SUM({x}), 0.0), 6)"}[spec.measure]
    key, field = group_sql(spec)
    down = "DESC" if isinstance(spec, TopK) and spec.descending else "ASC"
    inner = f"SELECT {key} AS key, {measure} AS value FROM {source} WHERE {where} AND {field} IS NOT NULL GROUP BY {key}"
    if isinstance(spec, Trend):
        return f"{head}, CAST(ROW_NUMBER() OVER (ORDER BY key) AS INT) AS rank, key, value FROM ({inner}) g WHERE value IS NOT NULL"
    ranks = f"SELECT key, value, CAST(ROW_NUMBER() OVER (ORDER BY value {down}, key) AS INT) AS rank, RANK() OVER (ORDER BY value {down}) AS tied FROM ({inner}) g WHERE value IS NOT NULL"
    return f"{head}, rank, key, value FROM ({ranks}) r WHERE {'tied' if spec.ties == 'all' else 'rank'} <= {spec.k}"
