"""Sinks and the tables that describe what was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evidence import fingerprint
from . import ranges
from .ingest import latest

SNAPSHOT = "snapshot_id string, dataset_id string, path string, rows long, rejects long, hash_xor long, hash_sum decimal(38,0), active boolean, seq long"


def write_records(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """Parquet, partitioned by category and year if asked. Rows of one partition are brought together
    first, split by hash, so a large category has several files and a small one not one from every task."""
    if "year" in partition_by and "year" not in df.columns:
        df = df.withColumn("year", F.year("event_time"))
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_rejects(rejects: DataFrame, path: str) -> None:
    rejects.write.json(path)


def write_world(df: DataFrame, path: str) -> None:
    """A sample as Parquet and JSON lines, and its ids."""
    df.write.parquet(f"{path}/records.parquet")
    df.write.json(f"{path}/records.jsonl")
    df.select("record_id").write.text(f"{path}/ids.txt")


def append_stage(df: DataFrame, path: str) -> None:
    """Stage outputs of runs, one folder a run."""
    df.write.mode("append").partitionBy("run_id").parquet(path)


def export(df: DataFrame, path: str) -> None:
    df.write.parquet(f"{path}/batch.parquet")
    df.write.option("header", True).csv(f"{path}/batch.csv")


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """name, sha256 of every data file under a path, by ranges of the files."""
    files = ranges.file_checksums(ranges.range_checksums(spark, path))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256")


def write_bundle(metrics: DataFrame, path: str) -> None:
    """Metrics as CSV with checksums beside them, those of the files and those of their ranges."""
    spark = metrics.sparkSession
    metrics.write.option("header", True).csv(f"{path}/metrics")
    ranges.range_checksums(spark, f"{path}/metrics").write.parquet(f"{path}/ranges")
    files = ranges.file_checksums(spark.read.parquet(f"{path}/ranges"))
    files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256").write.parquet(f"{path}/checksums")


def bundle_changes(spark: SparkSession, path: str) -> DataFrame:
    """name, start, state of the ranges of a bundle's files that are not as they were written."""
    return ranges.changed_ranges(spark.read.parquet(f"{path}/ranges"), ranges.range_checksums(spark, f"{path}/metrics"))


def verify_bundle(spark: SparkSession, path: str) -> DataFrame:
    """name, state (ok, changed, missing or unlisted) of each file of a bundle."""
    now = file_checksums(spark, f"{path}/metrics").withColumnRenamed("sha256", "now")
    both = spark.read.parquet(f"{path}/checksums").join(now, "name", "full_outer")
    state = F.when(F.col("now").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.col("now") == F.col("sha256"), "ok").otherwise("changed")
    return both.select("name", state.alias("state"))


def snapshot_id(dataset: Column, source_hash: Column, config_hash: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", dataset, source_hash, config_hash), 256), 1, 16)


def snapshot_row(records: DataFrame, snapshot: str, dataset: str, path: str, rejects: int, seq: int, active: bool = True) -> DataFrame:
    """The registry row of a snapshot: its rows and fingerprint."""
    row = records.agg(*fingerprint(F.col("record_id")))
    return row.select(
        F.lit(snapshot).alias("snapshot_id"), F.lit(dataset).alias("dataset_id"), F.lit(path).alias("path"), F.col("n").alias("rows"),
        F.lit(rejects).cast("long").alias("rejects"), "hash_xor", "hash_sum", F.lit(active).alias("active"), F.lit(seq).cast("long").alias("seq"),
    )


def tombstone(registry: DataFrame, snapshot: str, seq: int) -> DataFrame:
    """The row that deactivates a snapshot, to be appended; empty if there is no such snapshot."""
    return latest(registry, "snapshot_id", "seq").where(F.col("snapshot_id") == snapshot).withColumn("active", F.lit(False)).withColumn("seq", F.lit(seq).cast("long"))


def list_snapshots(registry: DataFrame, dataset: str | None = None, active_only: bool = True) -> DataFrame:
    """The last row of each snapshot; rows without an id are skipped."""
    rows = latest(registry.where("snapshot_id IS NOT NULL"), "snapshot_id", "seq")
    if dataset is not None:
        rows = rows.where(F.col("dataset_id") == dataset)
    return rows.where("active") if active_only else rows


def validate_snapshot(registry: DataFrame, snapshot: str, records: DataFrame | None) -> DataFrame:
    """check, ok: whether the snapshot is registered, its data are there, with rows, and with the same content."""
    row = latest(registry, "snapshot_id", "seq").where(F.col("snapshot_id") == snapshot)
    registered = row.agg(F.count("*").alias("c")).select(F.lit("registered").alias("check"), (F.col("c") == 1).alias("ok"))
    if records is None:
        return registered.unionByName(registered.select(F.lit("exists").alias("check"), F.lit(False).alias("ok")))
    now = records.agg(*fingerprint(F.col("record_id"))).select(F.col("n").alias("n_now"), F.col("hash_xor").alias("x_now"), F.col("hash_sum").alias("s_now"))
    both = now.join(row, F.lit(True), "left")  # two single rows
    same = F.coalesce((F.col("n_now") == F.col("rows")) & F.col("x_now").eqNullSafe(F.col("hash_xor")) & F.col("s_now").eqNullSafe(F.col("hash_sum")), F.lit(False))
    tests = {"exists": F.lit(True), "has_rows": F.col("n_now") > 0, "same_content": same, "rejects_known": F.coalesce(F.col("rejects") >= 0, F.lit(False))}
    return registered.unionByName(both.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), v.alias("ok")) for k, v in tests.items()])).alias("x")).select("x.*"))
