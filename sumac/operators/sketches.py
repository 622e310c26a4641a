"""Distinct counts that merge: a sketch for each fine group, stored once, united by any coarser one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import stored

#: Base-2 logarithm of the hashes that a sketch keeps: the 4,096 least, 32 KB a group at most. Counts below that are exact.
LG_K = 12
#: Three standard errors (1 / sqrt(2 ** LG_K) each), to which estimates are held.
ERROR = 3 / 2 ** (LG_K / 2)


def distinct_sketches(df: DataFrame, by: dict, value: str, lg_k: int = LG_K) -> DataFrame:
    """The columns of by (name: column) and sketch, of the distinct values of a column: one partial aggregate of bounded state, written once. Nulls do not count."""
    groups = [c.alias(name) for name, c in by.items()]
    return stored(df.select(*groups, F.col(value).cast("string").alias("__v")).groupBy(*by).agg(F.theta_sketch_agg("__v", F.lit(lg_k)).alias("sketch")))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """by, sketch and estimate: the sketches of each coarser group united. A union keeps the least hashes of all its parts, so the estimate does not depend on
    how groups were cut before."""
    united = sketches.groupBy(*by).agg(F.theta_union_agg("sketch", F.lit(LG_K)).alias("sketch"))
    return united.withColumn("estimate", F.theta_sketch_estimate("sketch"))
