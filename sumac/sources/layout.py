"""Parquet files in which rows near in several columns lie together, so that a filter on any one of them opens few files."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of the sample from which a column's buckets are learnt, about; results do not depend on it, only how even the files are.
SAMPLE = 20_000
#: A column has 2^BITS buckets at most.
BITS = 6
#: Texts are told apart by so many of their first characters.
TEXT = 64
#: Rows of a file, about, where there are many: a task sorts those of one file.
FILE_ROWS = 500_000


def bounds(df: DataFrame, columns: list[str], bits: int, n: int) -> list[list]:
    """The upper ends of each column's buckets but the last: values that divide a sample of the n rows evenly. A value with many rows is in one bucket."""
    rows = df.select(*[head(df, c).alias(c) for c in columns]).sample(min(1.0, SAMPLE / max(n, 1)), 42).limit(4 * SAMPLE).collect()
    out = []
    for c in columns:
        values = sorted(r[c] for r in rows if r[c] is not None)
        out.append(sorted({values[len(values) * i // 2**bits] for i in range(1, 2**bits)}) if values else [])
    return out


def head(df: DataFrame, c: str) -> Column:
    return F.substring(f"`{c}`", 1, TEXT) if dict(df.dtypes)[c] == "string" else F.col(f"`{c}`")


def bucket(x: Column, ends: list, bits: int, low: int = 0, n: int = 0) -> Column:
    """The number of ends below x, by halves: as many comparisons as bits. Few buckets are spread over all numbers of so many bits, so that a
    column of few values counts as much as another. Nulls are in the first bucket."""
    n = n or len(ends) + 1
    if not ends:
        return F.lit(low * 2**bits // n)
    m = len(ends) // 2
    return F.when(x > F.lit(ends[m]), bucket(x, ends[m + 1 :], bits, low + m + 1, n)).otherwise(bucket(x, ends[:m], bits, low, n))


def interleaved(buckets: list[Column], bits: int) -> Column:
    """One number from the bits of several, the highest ones first."""
    out = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for x in buckets:
            out = F.shiftleft(out, 1).bitwiseOR(F.shiftright(x, b).bitwiseAND(F.lit(1)).cast("long"))
    return out


def write_layout(df: DataFrame, path: str, columns: list[str], files: int, bits: int = BITS) -> None:
    """df under path/rows in about so many files, or more where these would have over FILE_ROWS rows, by ranges of the interleaved bits of the columns' buckets, and path/files with each file's
    name, rows, and the least and greatest value (min_c, max_c) and nulls (nulls_c) of every column. Rows of one cell, however many, are dealt
    over several files by their order in the input."""
    if len(columns) * bits > 62:
        raise ValueError("at most 62 bits in all")
    n = df.count()
    z = interleaved([bucket(head(df, c), e, bits) for c, e in zip(columns, bounds(df, columns, bits, n), strict=True)], bits)
    rows = df.withColumn("__z", z).withColumn("__order", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(max(files, ceil(n / FILE_ROWS)), "__z", "__order").sortWithinPartitions("__z")
    ranged.drop("__z", "__order").write.parquet(f"{path}/rows")
    spark = df.sparkSession
    written = spark.read.schema(df.schema).parquet(f"{path}/rows").select(F.col("_metadata.file_name").alias("file"), *[f"`{c}`" for c in columns])
    # distinct rows are counted by hash first: the least and greatest texts alone would have all rows of a task sorted
    counted = written.groupBy("file", *[f"`{c}`" for c in columns]).agg(F.count("*").alias("__n"))
    about = [F.sum("__n").alias("rows")]
    for c in columns:
        x = F.col(f"`{c}`")
        about += [F.min(x).alias(f"min_{c}"), F.max(x).alias(f"max_{c}"), F.sum(F.when(x.isNull(), F.col("__n")).otherwise(0)).alias(f"nulls_{c}")]
    counted.groupBy("file").agg(*about).write.parquet(f"{path}/files")


def files_for(spark: SparkSession, path: str, ranges: dict[str, tuple]) -> list[str]:
    """Names of the files that can hold rows with each column within its closed range (None: open)."""
    keep = F.lit(True)
    for c, (low, high) in ranges.items():
        if low is not None:
            keep = keep & (F.col(f"max_{c}") >= F.lit(low))
        if high is not None:
            keep = keep & (F.col(f"min_{c}") <= F.lit(high))
        if low is None and high is None:
            keep = keep & F.col(f"min_{c}").isNotNull()
    return [r.file for r in spark.read.parquet(f"{path}/files").where(keep).select("file").collect()]


def read_layout(spark: SparkSession, path: str, ranges: dict[str, tuple]) -> DataFrame:
    """The rows with each column within its closed range; nulls are in none. Only files that can hold such rows are opened."""
    schema = spark.read.parquet(f"{path}/rows").schema
    names = files_for(spark, path, ranges)
    if not names:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*[f"{path}/rows/{name}" for name in names])
    for c, (low, high) in ranges.items():
        x = F.col(f"`{c}`")
        rows = rows.where(x.isNotNull())
        rows = rows if low is None else rows.where(x >= F.lit(low))
        rows = rows if high is None else rows.where(x <= F.lit(high))
    return rows
