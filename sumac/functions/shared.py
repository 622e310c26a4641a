"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def ship(module: str) -> None:
    """Send a module's functions to the executors by value, so they need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Without one, a local session gets a temporary folder (tests), and a cluster an error."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        path = f"file://{tempfile.mkdtemp(prefix='sumac-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def new_folder(spark: SparkSession) -> str:
    """A folder in the shared one that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/sumac-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df written once as Parquet and read back, so that its users share the work and filters reach the files."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, by: str, order: str) -> str:
    """The name of a table with df's rows, dealt into buckets by one column and sorted in each by it and another: groups of the column
    meet without an exchange. Long columns of whole numbers are delta-coded by the file format."""
    spark = df.sparkSession
    name = f"sumac_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, by).sortBy(by, order).option("path", new_folder(spark)).option("parquet.writer.version", "v2").format("parquet").saveAsTable(name)
    return name
