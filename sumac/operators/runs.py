"""Tables of runs, traces and experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """Page number (from 1) of df in the order: a bounded sort of number * size rows."""
    if number < 1 or not 1 <= size <= 500:
        raise ValueError("pages count from 1 and have at most 500 rows")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def leaderboard(runs: DataFrame) -> DataFrame:
    """Runs, accuracy, mean loss and latency of each pipeline, best first."""
    rows = runs.groupBy("pipeline_id").agg(
        F.count("*").alias("runs"),
        F.round(F.avg(F.col("is_correct").cast("int")), 4).alias("accuracy"),
        F.round(F.avg("loss"), 4).alias("mean_loss"),
        F.round(F.avg("latency_ms"), 4).alias("mean_latency"),
    )
    return rows.orderBy(F.desc("accuracy"), "pipeline_id")


def select_runs(runs: DataFrame, number: int = 1, size: int = 50, **wanted) -> DataFrame:
    """A page of runs with given column values (None: any), newest first."""
    for name, value in wanted.items():
        runs = runs if value is None else runs.where(F.col(name) == value)
    return page(runs, [F.desc("created_at"), "run_id"], number, size)


def run_trace(events: DataFrame, run_id: str) -> DataFrame:
    return events.where(F.col("run_id") == run_id).orderBy("ts", "event_id")


def matrix(queries: DataFrame, worlds: DataFrame, settings: DataFrame, pipelines: DataFrame, families: list[str] | None = None) -> DataFrame:
    """Jobs of an experiment: queries with the worlds of their scale, each with every pipeline and setting
    (provider, model, seed). job_id depends on the cell alone."""
    q = queries if families is None else queries.where(F.col("family").isin(families))
    cells = q.join(worlds, "scale_n").crossJoin(F.broadcast(pipelines)).crossJoin(F.broadcast(settings))  # a few settings
    return cells.withColumn("job_id", F.md5(F.concat_ws("_", "query_id", "world_id", "pipeline_id", "provider", "model", F.col("seed").cast("string"))))


def dry_run(jobs: DataFrame, tokens_per_job: int, price: float) -> DataFrame:
    return jobs.agg(F.count("*").alias("jobs"), (F.count("*") * tokens_per_job).alias("tokens"), F.round(F.count("*") * tokens_per_job * price / 1000, 4).alias("cost"))


def to_do(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Jobs without a completed run."""
    return jobs.join(runs.where("status = 'completed'").select("job_id"), "job_id", "left_anti")


def status_counts(runs: DataFrame, by: str = "status") -> DataFrame:
    return runs.groupBy(by).agg(F.count("*").alias("n"))


def experiment_summary(runs: DataFrame, queries: DataFrame, worlds: DataFrame, default_scale: int = 50) -> DataFrame:
    """Runs and accuracy by scale: a run's query names its world, whose scale is default_scale if unknown."""
    rows = runs.select("query_id", "is_correct").join(queries.select("query_id", "world_id"), "query_id", "left").join(worlds.select("world_id", "scale_n"), "world_id", "left")
    rows = rows.withColumn("scale_n", F.coalesce("scale_n", F.lit(default_scale)))
    return rows.groupBy("scale_n").agg(F.count("*").alias("runs"), F.round(F.avg(F.col("is_correct").cast("int")), 6).alias("accuracy"))


def audit(events: DataFrame, path: str) -> None:
    """Appends audit events: ts, user_id, action, resource."""
    events.select("ts", "user_id", "action", "resource").write.mode("append").parquet(path)
