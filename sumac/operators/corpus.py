"""Samples of a corpus, slices that stress an analysis, summaries, and proofs of nesting."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.draws import normal, uniform
from ..functions.shared import stored
from .evidence import fingerprint, table_fingerprint
from .retrieval import few

#: Samples up to this size are a top-n; larger ones are cut off at a hash that is found by counting.
TOP_ROWS = 1000
#: Hex digits by which a round of counting narrows at most, to one of 4,096 parts.
DIGITS = 3
#: Rows of a part that are few enough to be sorted by one task.
PART_ROWS = 10_000


def order_key(seed: int, id_col: str = "record_id"):
    """The seeded shuffle: ids in the order of their hashes."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(id_col)), 256)


def last_kept(keys: DataFrame, wanted: Callable[[Column], Column]) -> DataFrame:
    """s, h, id: the key of the last row to keep in each stratum, in order of h and id. keys: s, h (hex), id; wanted gives the number
    to keep from a stratum's count.

    Selection by counting: rows are counted by their hash's next digits, the part that holds the wanted row is counted by further
    digits, and so on until it is small. No task sees a whole stratum. A null is a stratum; nothing is kept where none is wanted.
    """
    keys = stored(keys)
    part = keys.groupBy("s").agg(F.count("*").alias("m"))
    part = part.select("s", F.lit("").alias("prefix"), F.least(wanted(F.col("m")), F.col("m")).cast("long").alias("n"), "m").where("n > 0")
    digits = F.greatest(F.lit(0 if PART_ROWS >= 1024 else 1), F.least(F.lit(DIGITS), F.ceil(F.log(F.col("m") / 1024) / F.log(F.lit(16.0)))))

    def inside(part: DataFrame) -> DataFrame:
        p = few(part.withColumnRenamed("s", "t"))
        return keys.join(p, F.col("s").eqNullSafe(F.col("t")) & F.col("h").startswith(F.col("prefix"))).drop("t")

    key, one = F.struct("h", "id"), F.col("lo").eqNullSafe(F.col("hi"))
    while True:
        p = F.substr("h", F.lit(1), (F.length("prefix") + digits).cast("int"))
        counts = inside(part).groupBy("s", "n", p.alias("p")).agg(F.count("*").alias("m"), F.min(key).alias("lo"), F.max(key).alias("hi"))
        w = Window.partitionBy("s").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # 4,096 rows a stratum at most
        counts = counts.withColumn("before", F.coalesce(F.sum("m").over(w), F.lit(0)))
        part = stored(counts.where("before < n AND n <= before + m").select("s", F.col("p").alias("prefix"), (F.col("n") - F.col("before")).alias("n"), "m", "lo", "hi"))
        if part.where((F.col("m") > PART_ROWS) & ~one).isEmpty():
            break
    keyed = F.sort_array(F.collect_list(key))  # PART_ROWS at most
    several = inside(part.where(~one)).groupBy("s", "n").agg(keyed.alias("k")).select("s", F.col("k")[F.col("n").cast("int") - 1].alias("k"))
    return several.unionByName(part.where(one).select("s", F.col("hi").alias("k"))).select("s", "k.*")


def up_to(df: DataFrame, by: Column, wanted: Callable[[Column], Column], seed: int, id_col: str = "record_id") -> DataFrame:
    """df's rows up to the last one kept of their stratum. Rows that share an id are kept together."""
    keyed = df.withColumns({"__s": by, "__h": order_key(seed, id_col)})
    cut = few(last_kept(keyed.select(F.col("__s").alias("s"), F.col("__h").alias("h"), F.col(id_col).alias("id")), wanted).toDF("__t", "__last_h", "__last_id"))
    kept = (F.col("__h") < F.col("__last_h")) | ((F.col("__h") == F.col("__last_h")) & (F.coalesce(F.col(id_col) <= F.col("__last_id"), F.lit(True))))
    return keyed.join(cut, F.col("__s").eqNullSafe(F.col("__t"))).where(kept).select(*df.columns)


def nested_sample(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The first n records of the seeded shuffle. Samples of the same seed nest. A bounded top-n, or, for more than TOP_ROWS, all up
    to a hash found by counting: neither sorts the table."""
    if n > TOP_ROWS:
        return up_to(df, F.lit(0), lambda m: F.lit(n), seed)
    return df.withColumn("__h", order_key(seed)).orderBy("__h", "record_id").limit(n).drop("__h")


def fraction_sample(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """About a fraction of the records, without a shuffle; smaller fractions of the same seed nest."""
    return df.where(uniform(seed, F.col("record_id")) < fraction)


def holdout(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """A fraction that no fraction_sample of up to 1 - fraction and the same seed touches."""
    return df.where(uniform(seed, F.col("record_id")) >= 1 - fraction)


def stratified_sample(df: DataFrame, fraction: float, by: str = "category", seed: int = 42) -> DataFrame:
    """ceil(fraction * n) records of every stratum, null included: those up to a hash found by counting, however large a stratum is."""
    return up_to(df, F.col(by), lambda m: F.ceil(fraction * m), seed)


def null_heavy(df: DataFrame, n: int = 50, seed: int = 42) -> DataFrame:
    return nested_sample(df.where("price IS NULL"), n, seed)


def tie_heavy(df: DataFrame, most: int = 5) -> DataFrame:
    """Records of the first brands, at least two, whose count is the smallest most frequent count."""
    sizes = df.groupBy("brand").agg(F.count("*").alias("n"))
    modal = sizes.groupBy("n").agg(F.count("*").alias("brands")).orderBy(F.desc("brands"), "n").limit(1)
    tied = sizes.join(F.broadcast(modal.where("brands >= 2").select("n")), "n").orderBy("brand").limit(most)
    return df.join(F.broadcast(tied.select("brand")), "brand", "left_semi")


def rare_category(df: DataFrame) -> DataFrame:
    least = df.groupBy("category").agg(F.count("*").alias("n")).orderBy("n", "category").limit(1)
    return df.join(F.broadcast(least.select("category")), "category", "left_semi")


def date_boundary(df: DataFrame, spare: int = 10, seed: int = 42) -> DataFrame:
    """Records at the edge of a month; where there are none, a small sample."""
    day = F.dayofmonth("event_time")
    edge = df.where((day <= 2) | (day >= 28))
    return edge if edge.limit(1).count() else nested_sample(df, spare, seed)


def near_equal(df: DataFrame) -> DataFrame:
    """Records of the two categories, neighbours by mean rating, whose means are closest."""
    means = df.groupBy("category").agg(F.avg("rating").alias("mean"))
    w = Window.orderBy("mean", "category")  # a row a category
    gaps = means.select("category", F.lag("category").over(w).alias("before"), (F.col("mean") - F.lag("mean").over(w)).alias("gap"))
    pair = gaps.where("before IS NOT NULL").orderBy("gap", "category").limit(1)
    return df.join(F.broadcast(pair.select(F.explode(F.array("category", "before")).alias("category"))), "category", "left_semi")


SLICES = {"null_heavy": null_heavy, "tie_heavy": tie_heavy, "rare_category": rare_category, "date_boundary": date_boundary, "near_equal": near_equal}


def checksum(df: DataFrame) -> DataFrame:
    return table_fingerprint(df)


def summary(df: DataFrame) -> DataFrame:
    """One row: rows, brands, mean rating, verified and missing-price ratios, mean votes, first and last time."""
    return df.agg(
        F.count("*").alias("n"),
        F.count_distinct("brand").alias("brands"),
        F.round(F.avg("rating"), 4).alias("mean_rating"),
        F.round(F.avg(F.col("verified_purchase").cast("int")), 4).alias("verified_ratio"),
        F.round(F.avg(F.col("price").isNull().cast("int")), 4).alias("missing_price_ratio"),
        F.round(F.avg("helpful_votes"), 4).alias("mean_votes"),
        F.min("event_time").alias("first_time"),
        F.max("event_time").alias("last_time"),
    )


def counts_by(df: DataFrame, dimensions: list[str]) -> DataFrame:
    """dimension, key, n for several dimensions, each from one aggregate of its own column."""
    parts = [df.groupBy(F.col(d).cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit(d).alias("dimension"), "key", "n") for d in dimensions]
    return reduce(DataFrame.unionByName, parts)


def divergence(child: DataFrame, parent: DataFrame) -> DataFrame:
    """How a sample differs from its parent: new_rows, preserved_rows, new_categories."""
    new = child.join(parent.select("record_id"), "record_id", "left_anti").agg(F.count("*").alias("new_rows"))
    total = child.agg(F.count("*").alias("n"))
    categories = child.select("category").subtract(parent.select("category")).agg(F.count("*").alias("new_categories"))
    return new.crossJoin(total).crossJoin(categories).select("new_rows", (F.col("n") - F.col("new_rows")).alias("preserved_rows"), "new_categories")  # three single rows


def verify_nesting(chain: list[tuple[str, DataFrame]]) -> DataFrame:
    """For each sample and the next larger one: missing ids and up to five of them."""
    out = []
    for (small, a), (large, b) in zip(chain, chain[1:]):
        missing = a.select("record_id").join(b.select("record_id"), "record_id", "left_anti")
        some = missing.orderBy("record_id").limit(5).agg(F.array_join(F.array_sort(F.collect_list("record_id")), ",").alias("sample"))
        row = missing.agg(F.count("*").alias("missing")).crossJoin(some)  # two single rows
        out.append(row.select(F.lit(small).alias("small"), F.lit(large).alias("large"), "missing", "sample", (F.col("missing") == 0).alias("nested")))
    return reduce(DataFrame.unionByName, out)


def synthetic(spark: SparkSession, n: int, seed: int = 42, categories: tuple[str, ...] = ("Electronics", "Books", "Home", "Clothing", "Sports"), weights: tuple[float, ...] = (0.35, 0.25, 0.2, 0.12, 0.08)) -> DataFrame:
    """Records for scale tests; record i depends on (seed, i) alone, so sizes nest.

    Weighted categories, long-tailed brands, ratings skewed high in half steps, dates that lean to the
    last quarter, log-normal prices with 30% missing, Pareto votes, 70% verified.
    """
    i = F.col("id")
    u = lambda name: uniform(seed, i, name)
    category, edge = F.lit(categories[-1]), sum(weights)
    for c, w in zip(reversed(categories[:-1]), reversed(weights[1:])):
        edge -= w
        category = F.when(u("category") < edge / sum(weights), c).otherwise(category)
    year = F.lit(2020) + F.floor(u("year") * 4)
    month = F.when(u("season") < 0.4, 10 + F.floor(u("month") * 3)).otherwise(1 + F.floor(u("month") * 12))
    return spark.range(n).select(
        F.format_string("rec_%04d_%012d", F.lit(seed), i).alias("record_id"),
        F.format_string("p%09d", F.floor(u("product") * F.lit(max(1, n // 4)))).alias("product_id"),
        category.alias("category"),
        F.format_string("Brand %d", F.floor(F.pow(u("brand"), F.lit(3.0)) * 200)).alias("brand"),
        F.concat(F.lit("Item "), i.cast("string")).alias("title"),
        (5 - F.floor(F.pow(u("rating"), F.lit(2.0)) * 9) * 0.5).alias("rating"),
        F.least(F.floor(F.pow(1 - u("votes"), F.lit(-0.8)) - 1), F.lit(100_000)).cast("bigint").alias("helpful_votes"),
        (u("verified") < 0.7).alias("verified_purchase"),
        F.make_timestamp(year.cast("int"), month.cast("int"), (1 + F.floor(u("day") * 28)).cast("int"), F.floor(u("hour") * 24).cast("int"), F.lit(0), F.lit(0)).alias("event_time"),
        F.when(u("missing") >= 0.3, F.round(F.exp(3 + normal(seed, i, "price")), 2)).alias("price"),
        F.when(u("parent") < 0.25, F.format_string("p%09d", F.floor(u("which") * F.lit(max(1, n // 4))))).alias("parent_id"),
    )


def manifest(spark: SparkSession, name: str, df: DataFrame, parent: str | None, seed: int) -> DataFrame:
    """One row for the table of samples: name, parent, seed, and the content's fingerprint."""
    return df.agg(*fingerprint(F.col("record_id"))).select(F.lit(name).alias("world_id"), F.lit(parent).cast("string").alias("parent"), F.lit(seed).alias("seed"), "n", "hash_xor", "hash_sum")
