"""Which records stand behind an answer, and hashes of records, answers and tables."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import predicates as P
from .aggregates import Comparison, Proportion, Query, counted


def contributing(df: DataFrame, q: Query, id_col: str = "record_id") -> DataFrame:
    """query_id, record_id of the records behind the answer: the scope; of a proportion the numerator's
    rows; of a comparison the rows of a and then those of b, so a row of both stands twice."""
    inside = df if q.scope is None else df.where(P.compile(q.scope, df))
    spec = q.aggregation
    ids = lambda rows: rows.select(F.lit(q.query_id).alias("query_id"), F.col(id_col).alias("record_id"))
    if isinstance(spec, Proportion):
        return ids(inside.where(P.compile(spec.numerator, df)))
    if isinstance(spec, Comparison):
        return ids(inside.where(P.compile(spec.a, df))).unionAll(ids(inside.where(P.compile(spec.b, df))))
    return ids(inside)


def eligible_counts(df: DataFrame, queries: list[Query]) -> DataFrame:
    """query_id, eligible of many queries from one pass."""
    inside = [F.lit(True) if q.scope is None else P.compile(q.scope, df) for q in queries]
    wide = df.agg(*[counted(df, c).alias(f"c{i}") for i, c in enumerate(inside)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(q.query_id).alias("query_id"), F.col(f"c{i}").alias("eligible")) for i, q in enumerate(queries)])).alias("x")).select("x.*")


def stored_ids(evidence: DataFrame, cap: int = 500) -> DataFrame:
    """The first cap ids of each query, in order: what an answer stores. Hashes are over all."""
    w = Window.partitionBy("query_id").orderBy("record_id")
    return evidence.withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap).drop("n")


def exact_hash(ids: Column) -> Column:
    """Aggregate: 32 hex digits of SHA-256 over the sorted ids joined by |. It gathers a group's ids in one
    task; beyond about a million of them use fingerprint."""
    return F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(ids)), "|"), 256), 1, 32)


def fingerprint(*columns: Column) -> list[Column]:
    """Aggregates of constant size that tell two sets of rows apart, whatever their order: n, the xor and
    the sum of 60-bit hashes, which are the first 15 digits of the MD5 of the columns as texts."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns])
    h = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
    return [F.count("*").alias("n"), F.bit_xor(h).alias("hash_xor"), F.sum(h.cast("decimal(38,0)")).alias("hash_sum")]


def fingerprint_sql(*columns: str) -> str:
    """The aggregates as SQL for DuckDB, the sum as text."""
    text = "concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in columns) + ")"
    h = f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"
    return f"COUNT(*) AS n, bit_xor({h}) AS hash_xor, CAST(SUM({h}) AS VARCHAR) AS hash_sum"


def table_fingerprint(df: DataFrame) -> DataFrame:
    """One row that names the content of a whole table."""
    return df.agg(*fingerprint(*[F.col(c) for c in sorted(df.columns)]))


def digest(value: object, digits: int = 32) -> str:
    """Hash of an answer, a config or a certificate: SHA-256 over canonical JSON."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()[:digits]


def answer_hashes(result: DataFrame) -> DataFrame:
    """query_id, answer_hash of tall results."""
    line = F.concat_ws(":", F.lpad(F.col("rank").cast("string"), 10, "0"), F.coalesce("key", F.lit("")), F.coalesce(F.format_number("value", 6), F.lit("null")))
    return result.groupBy("query_id").agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "|"), 256), 1, 32).alias("answer_hash"))


def enumerate_scope(df: DataFrame, q: Query, id_col: str = "record_id") -> DataFrame:
    """One row: eligible, excluded, total, failure code (EMPTY_SCOPE or null) and the scope's fingerprint."""
    inside = F.coalesce(P.compile(q.scope, df), F.lit(False)) if q.scope is not None else F.lit(True)
    h = F.when(inside, F.xxhash64(id_col))
    row = df.agg(F.count_if(inside).alias("eligible"), F.count_if(~inside).alias("excluded"), F.count("*").alias("total"), F.bit_xor(h).alias("hash_xor"), F.sum(h.cast("decimal(38,0)")).alias("hash_sum"))
    return row.select(F.lit(q.query_id).alias("query_id"), "*", F.when(F.col("eligible") == 0, "EMPTY_SCOPE").alias("failure"))
