"""Extraction results as tables: parsing, checking, caching and bounded repair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def schema_of(fields: dict[str, str]) -> T.StructType:
    """Schema of one response: an array of records with an id, a scope decision and the fields, each nullable."""
    row = T.StructType([T.StructField("record_id", T.StringType()), T.StructField("in_scope", T.BooleanType())])
    for name, kind in fields.items():
        row = row.add(name, kind)
    return T.StructType([T.StructField("records", T.ArrayType(row))])


def parse(responses: DataFrame, fields: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """responses: batch, response (JSON). Returns the rows of those that parse, and the batches that do not."""
    schema = schema_of(fields)
    parsed = responses.withColumn("p", F.from_json("response", schema, {"mode": "PERMISSIVE"}))
    ok = F.col("p.records").isNotNull()
    return parsed.where(ok).select("batch", F.explode("p.records").alias("r")).select("batch", "r.*"), parsed.where(~ok).select("batch")


def in_scope(rows: DataFrame) -> DataFrame:
    return rows.where("in_scope")


def pivot_entries(entries: DataFrame, fields: list[str]) -> DataFrame:
    """entries: record_id, field_name, value, is_missing, one row a field; to one column a field, null where missing."""
    present = entries.where(~F.coalesce("is_missing", F.lit(False)))
    return present.groupBy("record_id").pivot("field_name", fields).agg(F.first("value", ignorenulls=True))


def cache_key(*parts) -> F.Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def split_by_cache(work: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """work (with cache_key) that the cache has, with its result, and what is left to do."""
    return work.join(cache, "cache_key"), work.join(cache, "cache_key", "left_anti")


def first_good(attempts: DataFrame, most: int = 2) -> DataFrame:
    """attempts: batch, attempt (from 0), ok, result. Each batch's first good result of attempt 0 to most,
    how many repairs it took, and whether it failed."""
    rows = attempts.where(F.col("attempt") <= most)
    good = F.col("ok")
    out = rows.groupBy("batch").agg(F.min_by("result", F.when(good, F.col("attempt"))).alias("result"), F.min(F.when(good, F.col("attempt"))).alias("repairs"), F.max("attempt").alias("tried"))
    return out.select("batch", "result", F.coalesce("repairs", "tried").alias("repairs"), F.col("repairs").isNull().alias("failed"))


def checks(extracted: DataFrame, expected: DataFrame, number_fields: list[str]) -> DataFrame:
    """One row of counts: invented and missing ids, values that are no number, rows with an unclear scope.
    extracted has text fields."""
    invented = extracted.join(expected.select("record_id"), "record_id", "left_anti").agg(F.count("*").alias("invented"))
    missing = expected.join(extracted.select("record_id"), "record_id", "left_anti").agg(F.count("*").alias("missing"))
    wrong = sum((F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()) for c in number_fields), start=F.lit(0))
    other = extracted.agg(wrong.alias("wrong_type"), F.count_if(F.col("in_scope").isNull()).alias("ambiguous"))
    return invented.crossJoin(missing).crossJoin(other)  # single rows


def usage(calls: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """Tokens and cost of each run. calls: run_id, tokens_in, tokens_out."""
    cost = (F.sum("tokens_in") * price_in + F.sum("tokens_out") * price_out) / 1000
    return calls.groupBy("run_id").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(cost, 6).alias("cost"))
