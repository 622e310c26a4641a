"""Helpers that several training-data operators share."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White-space words: fixed by the result contracts.
WORD = "[^\\x20\\x09-\\x0D]+"


def ship(module: str) -> None:
    """Send a module's functions to the executors by value, so they need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def worker_state() -> dict:
    """What a Python worker keeps between tasks: Spark reuses the process, but unpickles functions anew."""
    return vars(sys.modules.setdefault("sumac_worker_state", types.ModuleType("sumac_worker_state")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Without one, a local session gets a temporary folder (tests),
    and a cluster an error."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        path = f"file://{tempfile.mkdtemp(prefix='sumac-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_hash(text: Column) -> Column:
    """Tells apart rows that share an id; null text has a hash of its own."""
    return F.xxhash64(text, text.isNull())


def row_key(ident: Column, th: Column) -> Column:
    """One number for an id and the hash of a text."""
    return F.xxhash64(ident, ident.isNull(), th)


def same_row(ident: Column, th: Column, other: Column, other_th: Column) -> Column:
    """Whether id and text hash are the same, null ids too. Written so that Spark takes none of it for a join key: a join
    on row_key alone shares its exchange with an aggregate on row_key and more."""
    differs = lambda a, b: a.isNull().cast("int").bitwiseXOR(b.isNull().cast("int"))
    return (th.bitwiseXOR(other_th) == 0) & F.nullif(ident, other).isNull() & (differs(ident, other) == 0)


def words(text: Column) -> Column:
    """White-space words of a text, in order; null and blank texts have none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star steps.

    edges: columns u and v of one comparable type. Returns node, root (the least node of its component)
    for every node with an edge. Each step is one partial aggregation and one join; its output is
    checkpointed, so no step depends on the lineage of the ones before it, and nothing is collected
    but two numbers per round.
    """
    # Invariant: every edge is (u, v) with u > v.
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        # large star: every larger neighbour of u moves to the least of u and its neighbours
        large = now.select(F.col("u").alias("w"), F.col("v").alias("u")).join(least, "u")
        large = cut(large.select(F.col("w").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # small star: u and its smaller neighbours move to the least of them
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = cut(small.select("e.u", "e.v").where("u <> v").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


ship(__name__)
