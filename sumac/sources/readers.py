"""Readers of raw and canonical data."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.predicates import from_dict

#: Raw fields, all as text: what is a number and what a text is told from the raw line.
RAW_FIELDS = ["asin", "title", "main_category", "categories", "brand", "average_rating", "rating_number", "price", "store", "bought_in_last_month", "timestamp", "verified_purchase", "helpful_votes"]
MAX_BYTES = 500 * 1024 * 1024
FORMATS = {"jsonl": "json", "json": "json", "gz": "json", "csv": "csv", "parquet": "parquet"}


class TooLarge(ValueError):
    """The input exceeds the limit of bytes."""


def read_records(spark: SparkSession, path: str, schema: T.StructType | None = None, recursive: bool = False) -> DataFrame:
    """Canonical Parquet, one file or a directory tree; the schema is given, not inferred."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.option("recursiveFileLookup", str(recursive).lower()).parquet(path)


def as_table(df: DataFrame, name: str) -> str:
    df.createOrReplaceTempView(name)
    return name


def input_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files under a path, from their listing alone: no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length")
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def check_size(spark: SparkSession, path: str, max_bytes: int | None = MAX_BYTES) -> None:
    if max_bytes is not None and (n := input_bytes(spark, path)) > max_bytes:
        raise TooLarge(f"{path} has {n} bytes; the limit is {max_bytes}")


#: Where a row comes from: its file, the start of the split of it, and its place in the scan.
PLACE = ("__file", "__block", "__m")


def placed(rows: DataFrame) -> DataFrame:
    """Rows read from files, with their PLACE."""
    return rows.withColumns({"__file": F.col("_metadata.file_path"), "__block": F.col("_metadata.file_block_start"), "__m": F.monotonically_increasing_id()})


def in_file_order(rows: DataFrame) -> DataFrame:
    """Rows with their PLACE, numbered by file and line: row_index, from 0, the same however files are split.

    The rows of each block of a file are counted first; a block's first number is the running sum of the blocks
    before it, by file and start, and its rows keep the order in which they are read. There is one row a block.
    """
    blocks = rows.groupBy("__file", "__block").agg(F.count("*").alias("n"), F.min("__m").alias("first"))
    upto = F.sum("n").over(Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1))  # a row a block
    blocks = blocks.select("__file", "__block", "first", F.coalesce(upto, F.lit(0)).alias("before"))
    # sent to the rows where they lie: an exchange by block would leave a task to each block
    return rows.join(F.broadcast(blocks), ["__file", "__block"]).withColumn("row_index", F.col("before") + F.col("__m") - F.col("first")).drop(*PLACE, "first", "before")


def parse_lines(lines: DataFrame) -> DataFrame:
    """line (text) to row_index order columns, the raw fields as text, and what the raw JSON looked like.

    Columns: the RAW_FIELDS, line, malformed, number_time (the timestamp is a JSON number), first_category,
    keys (all keys of the object).
    """
    is_object = F.col("__v").isNotNull() & F.col("line").rlike(r"^[ \t\r\n]*\{")  # what parses and begins so is one
    get = lambda name: F.try_variant_get("__v", f"$.{name}", "string")
    kind = F.schema_of_variant(F.try_variant_get("__v", "$.timestamp", "variant"))
    # from a generator: a filter on the fields stays above it, where it would else parse the line again for each field
    rows = lines.withColumn("__v", F.explode(F.array(F.try_parse_json("line"))))
    return rows.select(
        *[c for c in lines.columns],
        (~is_object).alias("malformed"),
        *[get(f).alias(f) for f in RAW_FIELDS],
        F.coalesce(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), F.lit(False)).alias("number_time"),
        F.try_variant_get("__v", "$.categories[0]", "string").alias("first_category"),
        F.try_variant_get("__v", "$.categories", "array<string>").alias("category_list"),
        F.coalesce(F.map_keys(F.from_json("line", "map<string,string>")), F.array().cast("array<string>")).alias("keys"),
    )


def plain_rows(df: DataFrame) -> DataFrame:
    """Rows of CSV or Parquet, with row_index, as parse_lines gives them: every other column as text, missing ones null."""
    names = [c for c in df.columns if c != "row_index"]
    text = lambda f: F.col(f).cast("string") if f in df.columns else F.lit(None).cast("string")
    kinds = dict(df.dtypes)
    listed = kinds.get("categories", "").startswith("array")
    row: list[Column] = [F.col("row_index"), F.to_json(F.struct(*names)).alias("line"), F.lit(False).alias("malformed")]
    row += [(F.to_json("categories") if f == "categories" and listed else text(f)).alias(f) for f in RAW_FIELDS]
    row += [F.lit(kinds.get("timestamp", "string") in ("int", "bigint", "double")).alias("number_time")]
    row += [(F.get("categories", F.lit(0)) if listed else text("categories")).alias("first_category")]
    row += [(F.col("categories").cast("array<string>") if listed else F.when(text("categories").isNotNull(), F.array(text("categories")))).alias("category_list")]
    row += [F.array(*map(F.lit, names)).alias("keys")]
    return df.select(*row)


def load_raw(spark: SparkSession, path: str, fmt: str | None = None, max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """Raw rows of a file or folder, by format or else by extension (jsonl, json read as lines, jsonl.gz,
    csv with a header, parquet); anything else is rejected. A line that is no JSON object stays, malformed.
    row_index is the number of the row by file and line."""
    fmt = fmt or FORMATS.get(path.rstrip("/").rsplit(".", 1)[-1].lower())
    if fmt not in ("json", "csv", "parquet"):
        raise ValueError(f"no reader for {path}")
    check_size(spark, path, max_bytes)
    if fmt == "json":
        lines = in_file_order(placed(spark.read.text(path))).where(F.trim("value") != "").select("row_index", F.col("value").alias("line"))
        if path.endswith(".gz"):  # gzip files do not split: spread their numbered rows
            lines = lines.repartition(spark.sparkContext.defaultParallelism, "row_index")
        return parse_lines(lines)
    if fmt == "csv":
        names = spark.read.option("header", True).csv(path).columns
        rows = spark.read.option("header", True).schema(T.StructType([T.StructField(c, T.StringType()) for c in names])).csv(path)
    else:
        rows = spark.read.parquet(path)
    return plain_rows(in_file_order(placed(rows)))


def load_queries(spark: SparkSession, path: str) -> list[dict]:
    """Query specs from JSON lines (few), their predicates parsed."""
    rows = spark.read.text(path).where(F.trim("value") != "").collect()
    specs = [json.loads(r["value"]) for r in rows]
    return [s | {"scope": from_dict(s.get("scope"))} for s in specs]


def load_worlds(spark: SparkSession, config: dict) -> DataFrame:
    """The samples that a config lists: name, scale, seed, policy. Scales are positive and rise."""
    scales = config.get("scales", [])
    if not scales or any(not isinstance(n, int) or n < 1 for n in scales) or sorted(set(scales)) != scales:
        raise ValueError("scales are rising positive numbers")
    policy, seed = config.get("policy", "nested"), int(config.get("seed", 42))
    if policy not in ("nested", "stratified"):
        raise ValueError(f"unknown policy {policy!r}")
    return spark.createDataFrame([(f"world_s{seed}_n{n}", n, seed, policy) for n in scales], "world_id string, scale_n long, seed long, policy string")
