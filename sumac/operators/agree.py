"""Agreement of two evaluations of the same queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import aggregates as A
from . import predicates as P


def evaluate_text(spark: SparkSession, queries: list[A.Query], view: str, condensed: bool = False) -> DataFrame:
    """The queries by way of SQL text over a view, a path of its own beside the Column one: one statement for all
    scalar ones and one for each distinct group."""
    return reduce(DataFrame.unionByName, [spark.sql(text) for text in A.batch_sql(queries, view, condensed)])


def compare(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Cell by cell: query_id, rank, key, value_a, value_b, same. Numbers agree within the tolerance, null
    with null; a cell that one side lacks does not."""
    left = a.select("query_id", "rank", F.coalesce("key", F.lit("")).alias("key"), F.col("value").alias("value_a"), F.lit(True).alias("in_a"))
    right = b.select("query_id", "rank", F.coalesce("key", F.lit("")).alias("key"), F.col("value").alias("value_b"), F.lit(True).alias("in_b"))
    both = left.join(right, ["query_id", "rank", "key"], "full_outer")
    equal = F.col("value_a").eqNullSafe(F.col("value_b")) | F.coalesce(F.abs(F.col("value_a") - F.col("value_b")) <= tolerance, F.lit(False))
    same = F.coalesce(F.col("in_a") & F.col("in_b"), F.lit(False)) & equal
    return both.select("query_id", "rank", "key", "value_a", "value_b", F.col("in_a").isNotNull().alias("in_a"), F.col("in_b").isNotNull().alias("in_b"), same.alias("same"))


def status(cells: DataFrame) -> DataFrame:
    """query_id, status (agreed, disagreed or single_engine), cells that differ, and a diagnostic."""
    rows = cells.groupBy("query_id").agg(F.bool_and("same").alias("all_same"), F.bool_or("in_a").alias("any_a"), F.bool_or("in_b").alias("any_b"), F.count_if(~F.col("same")).alias("differing"))
    state = F.when(~(F.col("any_a") & F.col("any_b")), "single_engine").when(F.col("all_same"), "agreed").otherwise("disagreed")
    note = F.when(state == "disagreed", F.concat(F.col("differing").cast("string"), F.lit(" cells differ"))).when(state == "single_engine", F.lit("one side has no result"))
    return rows.select("query_id", state.alias("status"), "differing", note.alias("diagnostic"))


def report(statuses: DataFrame) -> DataFrame:
    return statuses.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "agreed").alias("agreed"), F.count_if(F.col("status") == "disagreed").alias("disagreed"), F.count_if(F.col("status") == "single_engine").alias("single_engine"))


def disagreements(statuses: DataFrame, families: DataFrame) -> DataFrame:
    """Rate of disagreement by family. families: query_id, family."""
    rows = statuses.join(families, "query_id")
    return rows.groupBy("family").agg(F.count("*").alias("total"), F.count_if(F.col("status") != "agreed").alias("disagreed"), F.round(F.avg((F.col("status") != "agreed").cast("int")), 4).alias("rate"))


def stage_oracles(df: DataFrame, q: A.Query) -> dict[str, DataFrame]:
    """What each stage should give: R the scope, E its facts, A the answer."""
    inside = df if q.scope is None else df.where(P.compile(q.scope, df))
    facts = project(inside, list(q.facts)) if q.facts else inside
    return {"R": inside.select("record_id"), "E": facts, "A": A.evaluate(df, q)}


def project(df: DataFrame, fields: list[str], derived: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """record_id and the known ones of fields; derived: name to (kind, field), the kind one of identity,
    year, month, quarter, log1p (null where the field is no number above -1)."""
    kept = ["record_id"] + [f for f in fields if f in df.columns and f != "record_id"]
    out = [F.col(c) for c in kept]
    for name, (kind, f) in (derived or {}).items():
        P.check(P.NotNull(f), df.columns)
        make = {"identity": F.col, "year": F.year, "month": F.month, "quarter": F.quarter, "log1p": log1p}[kind]
        out.append(make(f).alias(name))
    return df.select(*out)


def log1p(name: str) -> Column:
    x = F.col(name).try_cast("double")
    return F.when(x > -1, F.log1p(x))
