"""Lexical and dense retrieval for many queries at once, context packing and batch plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import cut
from .inner import asked_in_blocks, inner_top

#: Rows of queries that are sent to every task; beyond them the join is shuffled.
SENT_ROWS = 10_000


def few(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its size is checked to be small."""
    return F.broadcast(df) if df.limit(SENT_ROWS + 1).count() <= SENT_ROWS else df


def render(records: DataFrame) -> DataFrame:
    """record_id, text of eight lines, and a map of metadata."""
    names = [("ID", "record_id"), ("Title", "title"), ("Category", "category"), ("Brand", "brand"), ("Rating", "rating"), ("Verified", "verified_purchase"), ("Votes", "helpful_votes"), ("Price", "price")]
    meta = F.create_map(*[x for k in ("category", "brand", "product_id") for x in (F.lit(k), F.col(k))])
    parts = [x for n, c in names for x in (F.lit(f"\n{n}: " if c != names[0][1] else f"{n}: "), F.coalesce(F.col(c).cast("string"), F.lit("n/a")))]
    return records.select("record_id", F.concat(*parts).alias("text"), meta.alias("metadata"))


def chunk(docs: DataFrame, size: int, overlap: int, text_col: str = "text") -> DataFrame:
    """docs with chunk_index and chunk_text: pieces of size characters, each overlap into the one before;
    the last is the first that reaches the end. An empty or null text has one empty chunk."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap is shorter than a chunk")
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = F.when(F.length(text) <= size, 1).otherwise(1 + F.ceil((F.length(text) - size) / (size - overlap))).cast("int")
    rows = docs.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.withColumn("chunk_text", F.substr(text, F.col("chunk_index") * (size - overlap) + 1, F.lit(size)))


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def tokenize(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9 longer than one character."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda x: F.length(x) > 1)


def hash_embedding(text: Column, dims: int = 16) -> Column:
    """A unit vector from the first bytes of the text's SHA-256."""
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.conv(F.substr(digest, 2 * i + 1, F.lit(2)), 16, 10).cast("double") / 255)
    return F.transform(F.array(raw), lambda v: F.transform(v, lambda x: x / F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, y: a + y * y))))[0]


def dense_top(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", read: Callable | None = None) -> DataFrame:
    """query_id, unit, score, rank: the k vectors with the largest inner product for each query (query_id,
    vector). The queries go to every task in blocks; each task keeps about k a query before the shuffle. read: see inner_top."""
    v = F.col(vector_col)
    rows = vectors.select(F.col(id_col).alias("unit"), (v.cast("array<double>") if read is None else v).alias("v"))
    found = None
    for block, names in asked_in_blocks(queries.select("query_id", F.col("vector").cast("array<double>").alias("q")), SENT_ROWS):
        pairs = inner_top(rows, block, k, read=read).join(F.broadcast(names), "n").drop("n")  # a block's names
        found = pairs if found is None else found.unionByName(pairs)
    return best_k(found, k)


def best_k(pairs: DataFrame, k: int) -> DataFrame:
    """query_id, unit, score, rank: the k best of pairs (query_id, unit, score), scores rounded to nine places, ties to the lesser unit."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "unit")
    return pairs.select("query_id", "unit", F.round("score", 9).alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pack_context(candidates: DataFrame, budget: int) -> DataFrame:
    """Greedy packing of each query's ranked candidates (query_id, unit, rank, tokens): one that does not
    fit is skipped and the next is tried. Returns per query: candidates, selected, dropped, tokens, units."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "unit", "tokens")))  # a query's candidates are few
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<string>").alias("units"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["tokens"] <= budget
        return F.struct(F.when(fits, acc["used"] + x["tokens"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["units"], F.array(x["unit"].cast("string")))).otherwise(acc["units"]).alias("units"))

    rows = candidates.groupBy("query_id").agg(ordered.alias("c")).withColumn("p", F.aggregate("c", start, step))
    n, chosen = F.size("c"), F.size("p.units")
    reason = F.when(n == chosen, "all_fit").otherwise("budget_exceeded")
    return rows.select("query_id", n.alias("candidates"), chosen.alias("selected"), (n - chosen).alias("dropped"), F.col("p.used").alias("tokens"), F.array_join("p.units", ",").alias("units"), reason.alias("reason"), F.substring(F.sha2(F.array_join("p.units", ","), 256), 1, 32).alias("manifest_hash"))


def quality_at(retrieved: DataFrame, relevant: DataFrame, ks: list[int]) -> DataFrame:
    """query_id, k, recall and precision. retrieved: query_id, unit, rank; relevant: query_id, unit."""
    marked = retrieved.join(relevant.withColumn("hit", F.lit(1)), ["query_id", "unit"], "left")
    total = relevant.groupBy("query_id").agg(F.count("*").alias("relevant"))
    cells = marked.groupBy("query_id").agg(*[F.count_if((F.col("rank") <= k) & F.col("hit").isNotNull()).alias(f"h{k}") for k in ks])
    rows = total.join(cells, "query_id", "left")
    return rows.select("query_id", "relevant", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(f"h{k}", F.lit(0)).alias("hits")) for k in ks])).alias("x")).select(
        "query_id", "x.k", F.round(F.col("x.hits") / F.col("relevant"), 6).alias("recall"), F.round(F.col("x.hits") / F.col("x.k"), 6).alias("precision")
    )


def row_numbers(df: DataFrame, order: list[str], name: str = "row") -> DataFrame:
    """df with numbers from 0 in the order, without one task seeing all rows: range partitions, their
    sizes, and a count within each."""
    parts = cut(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    sizes = parts.groupBy("__p").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return parts.withColumn("__i", inside).join(F.broadcast(sizes.select("__p", before.alias("__b"))), "__p").withColumn(name, F.col("__b") + F.col("__i")).drop("__p", "__i", "__b")


def batch_plan(ids: DataFrame, size: int, tokens_per_row: int = 150, id_col: str = "record_id") -> DataFrame:
    """batch, first and last id, rows and tokens of ids in order, size to a batch."""
    rows = row_numbers(ids.select(id_col), [id_col]).withColumn("batch", F.floor(F.col("row") / size))
    return rows.groupBy("batch").agg(F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id"), F.count("*").alias("rows"), (F.count("*") * tokens_per_row).alias("tokens"))


def consecutive_edges(records: DataFrame, by: str, id_col: str = "record_id") -> DataFrame:
    """src, dst: each record and the next of the same group in order of the id. Rows without a group form one.

    Range partitions of group and id, each with its own neighbours; the last id of a group in a partition meets the
    first in the next partition that has the group. So a large group is many tasks.
    """
    rows = records.select(F.col(by).alias("g"), F.col(id_col).alias("src"))
    parts = cut(rows.repartitionByRange("g", "src").withColumn("p", F.spark_partition_id()))
    inside = parts.select("src", F.lead("src").over(Window.partitionBy("p", "g").orderBy("src")).alias("dst")).where("dst IS NOT NULL")
    ends = parts.groupBy("g", "p").agg(F.min("src").alias("first"), F.max("src").alias("last"))  # a row a group and partition
    across = ends.select(F.col("last").alias("src"), F.lead("first").over(Window.partitionBy("g").orderBy("p")).alias("dst")).where("dst IS NOT NULL")
    return inside.unionByName(across)
