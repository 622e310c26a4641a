"""Repeatable faults in scopes, facts and answers, and the pipelines that carry them.

Draws depend on a seed and on what is drawn for (query, record, field), never on the order of rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import normal, normal_sql, uniform, uniform_sql
from ..functions.shared import cut, stored
from . import aggregates as A
from . import predicates as P

NUMBERS = ("rating", "helpful_votes", "price")
SWAPPED = ("category", "brand")
FLIPPED = ("verified_purchase",)


def draw(*key) -> float:
    """The same draw as functions.draws.uniform, on the driver."""
    return int(hashlib.sha256("|".join(map(str, key)).encode()).hexdigest()[:13], 16) / 16**13


def other_values(df: DataFrame, queries: list[A.Query], seed: int = 42) -> dict[str, str]:
    """By query whose scope is one category or brand: of all other values of the field, the one with the least hash of the
    draw's key and the value. The values stay in Spark."""
    asked = [(q.query_id, q.scope.field, q.scope.value, f"{seed}|{q.query_id}|value") for q in queries if isinstance(q.scope, P.Eq) and q.scope.field in SWAPPED]
    if not asked:
        return {}
    values = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in SWAPPED])).alias("x")).select("x.*").where("v IS NOT NULL").distinct()
    keys = df.sparkSession.createDataFrame(asked, "query_id string, field string, now string, k string")
    pairs = values.join(F.broadcast(keys), "field").where("v <> now")
    found = pairs.groupBy("query_id").agg(F.min_by("v", F.struct(F.sha2(F.concat_ws("|", "k", "v"), 256), "v")).alias("v"))
    return {r["query_id"]: r["v"] for r in found.collect()}  # a row a query


def other_value_sql(q: A.Query, source: str = "records", seed: int = 42) -> P.Sql:
    f = q.scope.field
    return P.Sql(f"(SELECT arg_min(v, sha256('{seed}|{q.query_id}|value|' || v)) FROM (SELECT DISTINCT {f} AS v FROM {source}) WHERE v <> {P.sql_literal(q.scope.value)})")


def scope_fault(p: P.Predicate | None, query_id: str, other: object = None, seed: int = 42) -> P.Predicate:
    """A predicate near p: range ends moved apart or together, another category or brand, a rating one off,
    the first operand alone of an and, one value less of a list; anything else becomes a rating range.
    other: the value that a category or brand changes to (see other_values)."""
    u = lambda name: draw(seed, query_id, name)
    if isinstance(p, P.And):
        return p.parts[0]
    if isinstance(p, P.In) and len(p.values) > 1:
        gone = int(u("drop") * len(p.values))
        return replace(p, values=p.values[:gone] + p.values[gone + 1 :])
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    if isinstance(p, P.Range) and all(v is None or number(v) for v in (p.low, p.high)):
        j = 0.8 + 0.4 * u("range")
        return replace(p, low=None if p.low is None else p.low * j, high=None if p.high is None else p.high * (2 - j))
    if isinstance(p, P.Eq) and p.field in SWAPPED and other is not None:
        return replace(p, value=other)
    if isinstance(p, P.Eq) and p.field == "rating" and number(p.value):
        return replace(p, value=min(5.0, max(1.0, p.value + (1 if u("sign") < 0.5 else -1))))
    return P.Range("rating", low=1 + u("low"), high=5.0)


def fact_fault(df: DataFrame, fields: list[str], seed: int = 42, inside: Column | None = None) -> DataFrame:
    """df with corrupted values of some fields: numbers by a normal of a tenth of their range, floored at 0
    (ratings stay in [1, 5], one place; nulls stay null); 30% of booleans flipped; 20% of categories and brands swapped for
    the least other value. inside: the rows to corrupt. Times and other texts stay."""
    fields = [f for f in fields if f in NUMBERS + SWAPPED + FLIPPED]
    ends = df.agg(F.lit(1).alias("__one"), *[g(f).alias(f"__{n}_{f}") for f in fields if f not in FLIPPED for n, g in (("lo", F.min), ("hi", F.max))])
    rows = df.crossJoin(F.broadcast(ends))  # one row
    inside = F.lit(True) if inside is None else F.coalesce(inside, F.lit(False))
    out = {}
    for f in fields:
        c, u = F.col(f), uniform(seed, F.col("record_id"), f)
        if f in FLIPPED:
            new = F.when(u < 0.3, ~c).otherwise(c)
        elif f in SWAPPED:
            new = F.when(u < 0.2, F.when(c == F.col(f"__lo_{f}"), F.col(f"__hi_{f}")).otherwise(F.col(f"__lo_{f}"))).otherwise(c)
        else:
            moved = c + normal(seed, F.col("record_id"), f) * 0.1 * (F.col(f"__hi_{f}") - F.col(f"__lo_{f}"))
            new = F.round(F.greatest(F.lit(1.0), F.least(F.lit(5.0), moved)), 1) if f == "rating" else F.greatest(F.lit(0.0), moved)
            new = F.round(new).cast("bigint") if dict(df.dtypes)[f] == "bigint" else new
        out[f] = F.when(inside & c.isNotNull(), new).otherwise(c)
    return rows.withColumns(out).select(*df.columns)


def faulty_facts_answer(df: DataFrame, q: A.Query, fields: list[str], seed: int = 42) -> DataFrame:
    """The answer over corrupted facts of the scope, which is applied again to the corrupted values."""
    inside = None if q.scope is None else P.compile(q.scope, df)
    return A.evaluate(fact_fault(df, fields, seed, inside), q)


def answer_fault(result: DataFrame, queries: list[A.Query], seed: int = 42) -> DataFrame:
    """Tall results with a wrong aggregation: counts and sums times U(0.7, 1.4), means plus N(0, 0.5),
    proportions 0.15 up or down within [0, 1], comparisons with the other sign, top-k reversed, trends
    in a drawn order."""
    kinds = F.create_map(*[x for q in queries for x in (F.lit(q.query_id), F.lit(type(q.aggregation).__name__))])
    kind, u = kinds[F.col("query_id")], uniform(seed, F.col("query_id"), "answer")
    v = F.col("value")
    value = (
        F.when(kind.isin("Count", "Sum"), v * (0.7 + 0.7 * u))
        .when(kind == "Mean", v + 0.5 * normal(seed, F.col("query_id"), "answer"))
        .when(kind == "Proportion", F.greatest(F.lit(0.0), F.least(F.lit(1.0), v + F.when(u < 0.5, -0.15).otherwise(0.15))))
        .when(kind == "Comparison", F.lit(0.0) - v)
        .otherwise(v)
    )
    sizes = result.groupBy("query_id").agg(F.max("rank").alias("__n"))
    rows = result.join(sizes, "query_id")
    shuffled = F.row_number().over(Window.partitionBy("query_id").orderBy(uniform(seed, F.col("query_id"), F.col("key")), "key"))
    rank = F.when(kind == "TopK", F.col("__n") + 1 - F.col("rank")).when(kind == "Trend", shuffled).otherwise(F.col("rank"))
    return rows.select("query_id", rank.cast("int").alias("rank"), "key", value.alias("value"))


#: Which stages a pipeline gets wrong: R scope, E facts, A aggregation.
PIPELINES = {"clean": "", "wrong_scope": "R", "wrong_facts": "E", "wrong_aggregation": "A", "scope_and_facts": "RE", "all_wrong": "REA"}
FACTS = [*NUMBERS, *SWAPPED, *FLIPPED]


def stage_answers(df: DataFrame, queries: list[A.Query], seed: int = 42) -> dict[str, DataFrame]:
    """Results with the scope and facts each right or wrong: keys "", "R", "E" and "RE" name what is wrong.

    The columns that the queries name are written once, right and corrupted, so that the join behind the records is done once
    and a fact is drawn once. Right and wrong scopes are asked in one batch over each of the two tables.
    """
    names = [c for c in df.columns if c in {"record_id", "rating", *SWAPPED} | A.fields_of(queries, df.columns)]
    df = stored(df.select(*names))
    others = other_values(df, queries, seed)
    wrong = [replace(q, scope=scope_fault(q.scope, q.query_id, others.get(q.query_id), seed)) for q in queries]
    asked = set().union(*[A.fields_of(q, df.columns) for q in [*queries, *wrong]])
    bad = stored(fact_fault(df, [f for f in FACTS if f in asked], seed))
    both = [replace(q, query_id=f"{kind}/{q.query_id}") for kind, qs in (("right", queries), ("wrong", wrong)) for q in qs]
    found = {}
    for fact, table in (("", df), ("E", bad)):
        rows = cut(A.evaluate_batch(table, both))  # a few rows a query
        for scope, kind in (("", "right"), ("R", "wrong")):
            mine = rows.where(F.col("query_id").startswith(f"{kind}/"))
            found[scope + fact] = mine.withColumn("query_id", F.substring("query_id", len(kind) + 2, 1 << 20))
    return found


def run_pipelines(df: DataFrame, queries: list[A.Query], seed: int = 42) -> DataFrame:
    """pipeline_id, query_id, rank, key, value: what each pipeline answers."""
    found, out = stage_answers(df, queries, seed), []
    for name, faults in PIPELINES.items():
        rows = found[faults.replace("A", "")]
        rows = answer_fault(rows, queries, seed) if "A" in faults else rows
        out.append(rows.select(F.lit(name).alias("pipeline_id"), "*"))
    return reduce(DataFrame.unionByName, out)


def fact_fault_sql(source: str, seed: int = 42) -> str:
    """Rows of fact_fault over all FACTS of a source, as SQL for DuckDB."""
    ends = ", ".join(f"{g}({f}) AS {n}_{f}" for f in NUMBERS + SWAPPED for n, g in (("lo", "MIN"), ("hi", "MAX")))
    u = lambda f: uniform_sql(f"'{seed}'", "record_id", f"'{f}'")
    moved = lambda f: f"{f} + {normal_sql(repr(str(seed)), 'record_id', repr(f))} * 0.1 * (hi_{f} - lo_{f})"
    new = {
        "rating": f"ROUND(greatest(1.0, least(5.0, {moved('rating')})), 1)",
        "helpful_votes": f"CAST(ROUND(greatest(0.0, {moved('helpful_votes')})) AS BIGINT)",
        "price": f"greatest(0.0, {moved('price')}) + price * 0",
    } | {f: f"CASE WHEN {u(f)} < 0.2 THEN CASE WHEN {f} = lo_{f} THEN hi_{f} ELSE lo_{f} END ELSE {f} END" for f in SWAPPED}
    new |= {f: f"CASE WHEN {u(f)} < 0.3 THEN NOT {f} ELSE {f} END" for f in FLIPPED}
    return f"(SELECT s.* REPLACE ({', '.join(f'{e} AS {f}' for f, e in new.items())}) FROM {source} s, (SELECT {ends} FROM {source}) ends)"


def answer_fault_sql(result: str, queries: list[A.Query], seed: int = 42) -> str:
    """Rows of answer_fault of tall results, as SQL for DuckDB."""
    kinds = ", ".join(f"('{q.query_id}', '{type(q.aggregation).__name__}')" for q in queries)
    u, z = uniform_sql(f"'{seed}'", "query_id", "'answer'"), normal_sql(f"'{seed}'", "query_id", "'answer'")
    value = f"""CASE WHEN kind IN ('Count', 'Sum') THEN value * (0.7 + 0.7 * {u}) WHEN kind = 'Mean' THEN value + 0.5 * {z}
      WHEN kind = 'Proportion' THEN greatest(0.0, least(1.0, value + CASE WHEN {u} < 0.5 THEN -0.15 ELSE 0.15 END)) WHEN kind = 'Comparison' THEN 0.0 - value ELSE value END"""
    shuffled = f"ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY {uniform_sql(repr(str(seed)), 'query_id', 'key')}, key)"
    rank = f"CASE kind WHEN 'TopK' THEN MAX(rank) OVER (PARTITION BY query_id) + 1 - rank WHEN 'Trend' THEN {shuffled} ELSE rank END"
    return f"(SELECT query_id, CAST({rank} AS INT) AS rank, key, {value} AS value FROM {result} JOIN (VALUES {kinds}) AS k(query_id, kind) USING (query_id))"


def trace(df: DataFrame, q: A.Query, run_id: str) -> DataFrame:
    """Trace events of a clean run: stage, rows in and out, in order, with the scope's fingerprint."""
    inside = F.lit(True) if q.scope is None else F.coalesce(P.compile(q.scope, df), F.lit(False))
    row = df.agg(F.count("*").alias("total"), F.count_if(inside).alias("eligible"), F.bit_xor(F.when(inside, F.xxhash64("record_id"))).alias("h"))
    stages = [("scope", "total", "eligible"), ("extract", "eligible", "eligible"), ("aggregate", "eligible", None)]
    event = [F.struct(F.lit(run_id).alias("run_id"), F.lit(i).alias("seq"), F.lit(s).alias("stage"), F.col(a).alias("rows_in"), (F.col(b) if b else F.lit(1).cast("bigint")).alias("rows_out"), F.hex("h").alias("scope_hash")) for i, (s, a, b) in enumerate(stages)]
    return row.select(F.explode(F.array(*event)).alias("e")).select("e.*")
