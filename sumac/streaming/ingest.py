"""Incremental ingest: a file stream of raw lines into canonical tables, with the accepted ids as keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.ingest import canonicalize, deduplicated
from ..sources.readers import in_file_order, parse_lines

#: What the state sees of a row; an epoch has an id once.
KEY = "source_record_id string, epoch long"
#: Keeps state on disk, so that ids need not fit in memory.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def read_lines(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"))


def stage_batch(batch: DataFrame, epoch: int, target: str, dataset_id: str = "d") -> None:
    """One micro-batch of lines: reject, and keep the first row of each id of the batch.

    Rows are numbered by file and line within the batch. Each epoch has a folder that it overwrites, so an epoch
    that runs again leaves the same rows.
    """
    lines = in_file_order(batch.withColumn("__m", F.monotonically_increasing_id())).where(F.trim("line") != "")
    rows = canonicalize(parse_lines(lines), dataset_id).persist()
    deduplicated(rows.where("reason IS NULL")).drop("reason").write.mode("overwrite").parquet(f"{target}/staged/epoch={epoch}")
    rows.where("reason IS NOT NULL").select("row_index", "reason").write.mode("overwrite").parquet(f"{target}/rejects/epoch={epoch}")
    rows.unpersist()


def first_seen(keys: DataFrame) -> DataFrame:
    """The first epoch of each id that no earlier batch had; a batch can hold several epochs. The state of an id is its first epoch and
    the times of its first and last batch: an id is new where these are one."""
    seen = keys.withColumn("at", F.current_timestamp()).groupBy("source_record_id").agg(F.min("epoch").alias("epoch"), F.min("at").alias("since"), F.max("at").alias("now"))
    return seen.where("since = now").select("source_record_id", "epoch")


def accept_batch(keys: DataFrame, batch: int, target: str, schema: str) -> None:
    """Writes the staged rows with these keys, reading no other epochs than theirs. A batch that runs again has the same keys,
    as its state goes back too, and overwrites its epochs."""
    spark = keys.sparkSession
    keys = keys.persist()
    epochs = [r.epoch for r in keys.select("epoch").distinct().collect()]  # micro-batches since the last run
    if epochs:
        staged = spark.read.schema(f"{schema}, epoch long").option("basePath", f"{target}/staged").parquet(*[f"{target}/staged/epoch={e}" for e in epochs])
        rows = staged.join(keys, ["source_record_id", "epoch"], "left_semi").select(*staged.columns)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(f"{target}/records")
    elif batch == 0:  # nothing was accepted: a table without rows
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{target}/records/epoch=0")
    keys.unpersist()


def start(lines: DataFrame, target: str, checkpoint: str, dataset_id: str = "d") -> StreamingQuery:
    """Ingests all files that are there. Lines are staged by one stream; a second one follows with the accepted ids as state: an id
    that comes again meets its state, and no earlier output is read. Returns the second one."""
    spark = lines.sparkSession
    empty = canonicalize(parse_lines(spark.createDataFrame([], "row_index long, line string")), dataset_id).drop("reason")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in empty.schema)
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{target}/staged/epoch=-1")
    staging = lines.writeStream.foreachBatch(lambda df, epoch: stage_batch(df, epoch, target, dataset_id))
    staging.option("checkpointLocation", f"{checkpoint}/staged").trigger(availableNow=True).start().awaitTermination()

    keys = spark.readStream.schema(KEY).parquet(f"{target}/staged")
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        accepting = first_seen(keys).writeStream.outputMode("update").foreachBatch(lambda df, batch: accept_batch(df, batch, target, schema))
        return accepting.option("checkpointLocation", f"{checkpoint}/accepted").trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER[0], before) if before else spark.conf.unset(PROVIDER[0])
