"""Checksums of files of any size: fixed ranges of a file are read as streams by tasks, so no file is one value or one task's work."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import ship

RANGE = 64 << 20
CHUNK = 1 << 20

SCHEMA = "path string, length long, start long, size long, sha256 string"


def opened(path: str):
    """A file by the name that Spark lists it under, in which no character is escaped."""
    from pyarrow import fs

    if path.startswith("/") or path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    scheme, _, rest = path.partition("://")
    authority, _, name = rest.partition("/")
    files, base = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return files.open_input_file(f"{base.rstrip('/')}/{name}")


def digests(size: int):
    """Of ranges as rows of path, length and start: their bytes read and the SHA-256 of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("path", pa.string()), ("length", pa.int64()), ("start", pa.int64()), ("size", pa.int64()), ("sha256", pa.string())])
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                left = length = min(size, r["length"] - r["start"])
                sums = hashlib.sha256()
                with opened(r["path"]) as f:
                    f.seek(r["start"])
                    while left > 0:
                        block = f.read(min(CHUNK, left))
                        if not block:
                            raise OSError(f"{r['path']} ends {left} bytes early")
                        sums.update(block)
                        left -= len(block)
                rows.append(r | {"size": length, "sha256": sums.hexdigest()})
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return run


def range_checksums(spark: SparkSession, path: str, size: int = RANGE, pattern: str = "*part-*") -> DataFrame:
    """path, length, start, size, sha256 of every range of the data files under a path; Spark lists no empty files,
    so one that has become empty counts as missing. Only names and lengths come from the listing. Ranges are dealt over all tasks, a file's over many. Local paths and those that Arrow can open (hdfs, s3, gs)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size).cast("long"))
    rows = files.select("path", "length", F.explode(starts).alias("start"))
    tasks = spark.sparkContext.defaultParallelism * 4
    ship(__name__)
    return rows.repartition(tasks, "path", "start").mapInArrow(digests(size), SCHEMA)


def whole() -> Column:
    """Aggregate over a file's ranges: of one range its SHA-256, which is the file's; of more the SHA-256 of their number and their
    digests in order. 64 bytes a range: a file of a terabyte is gathered as one megabyte."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("start", "sha256"))), lambda x: x["sha256"])
    several = F.sha2(F.concat(F.count("*").cast("string"), F.lit(":"), F.array_join(parts, ",")), 256)
    return F.when(F.count("*") == 1, F.min("sha256")).otherwise(several)


def file_checksums(ranges: DataFrame) -> DataFrame:
    """path, length, sha256 of each file from its ranges."""
    return ranges.groupBy("path", "length").agg(whole().alias("sha256"))


def changed_ranges(before: DataFrame, now: DataFrame) -> DataFrame:
    """name, start, state of the ranges that differ: changed, missing or unlisted. Files are known by name."""
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    a, b = (x.select(name, "start", F.struct("size", "sha256").alias(side)) for x, side in ((before, "a"), (now, "b")))
    both = a.join(b, ["name", "start"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select("name", "start", F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unlisted").otherwise("changed").alias("state"))
