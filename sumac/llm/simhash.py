"""SimHash near-duplicates: pigeonhole blocks of the fingerprint, then exact Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, cut, row_key, same_row, ship, text_hash

SHINGLE = 3
SEED = 42
DISTANCE = 3
#: The 64 bits in five blocks: two fingerprints within 3 bits agree on two blocks at least, so each of the
#: ten pairs of blocks is a join key of 25 or 26 bits and no close pair is missed.
BLOCKS = (13, 13, 13, 13, 12)
#: Members of a bucket that one task compares at once; a larger bucket is dealt out in tiles of two parts.
TILE = 4096
#: Tasks over which the members of one component are dealt.
SALTS = 16
#: Shingle hashes counted at once, so a long text needs no more memory than a short one.
STEP = 1 << 16

ship(__name__)


def fingerprint(text: bytes | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the lower-cased (A-Z) word shingles of a UTF-8 text; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    shingles = iter([b" ".join(words)]) if n == 1 else map(b" ".join, zip(*(words[i:] for i in range(size))))
    ones = np.zeros(64, np.int64)
    for start in range(0, n, STEP):
        k = min(STEP, n - start)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, (s for _, s in zip(range(k), shingles)), repeat(seed)), np.uint64, k)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, th (hash of the text) and fp (the fingerprint as a signed long) of every row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(t.as_py()) for t in b.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fps], names=["id", "th", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("th"), F.col(text_col).cast("binary").alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("th", T.LongType()), T.StructField("fp", T.LongType())])
    return rows.mapInArrow(task, schema)


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph that links values within the distance: below len(fps) of them."""
    n = len(fps)
    label = np.arange(n)
    edges = []
    bits = fps.view(np.uint64)
    for i in range(n - 1):
        near = np.nonzero(np.bitwise_count(bits[i + 1 :] ^ bits[i]) <= distance)[0] + i + 1
        for j in near[label[near] != label[i]]:
            if label[j] != label[i]:
                edges.append((int(fps[j]), int(fps[i])))
                label[label == label[j]] = label[i]
    return edges


def close_links(distinct_fps: DataFrame, distance: int = DISTANCE, tile: int = TILE) -> DataFrame:
    """Links u, v between fingerprints (column fp, distinct) that keep every component of the full graph.

    Every pair within the distance meets in a bucket, and every bucket's own components are kept by a
    spanning forest, so joining them links whatever the full set of pairs would link. Large buckets are
    split in parts; each two parts meet in a tile, so no task holds a whole bucket.
    """
    if distance > len(BLOCKS) - 2:
        raise ValueError("the blocks find pairs of at most three differing bits")
    starts = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    block = [F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in zip(starts, BLOCKS)]
    keys = [F.lit(k << 32).bitwiseOR(F.shiftleft(block[i], 13)).bitwiseOR(block[j]) for k, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))]
    rows = distinct_fps.select("fp", F.explode(F.array(*keys)).alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(sizes, "bucket").withColumn("parts", F.ceil(F.col("n") / tile).cast("int"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(part, j) * F.col("parts") + F.greatest(part, j))
    rows = rows.select("bucket", "fp", F.explode(tiles).alias("tile")).repartition("bucket", "tile").sortWithinPartitions("bucket", "tile")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> pa.RecordBatch | None:
            found = forest(np.concatenate(held), distance) if held and sum(map(len, held)) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], names=["u", "v"]) if found else None

        for b in batches:
            bucket, fp, tile_id = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            edge = np.nonzero((np.diff(bucket) != 0) | (np.diff(tile_id) != 0))[0] + 1
            for lo, hi in zip([0, *edge], [*edge, len(fp)]):
                if hi > lo:
                    if (bucket[lo], tile_id[lo]) != key:
                        if (out := done()) is not None:
                            yield out
                        key, held = (bucket[lo], tile_id[lo]), []
                    held.append(fp[lo:hi])
        if (out := done()) is not None:
            yield out

    return rows.mapInArrow(task, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """Near-duplicate classes of all rows.

    Returns per row: id, th (hash of the text), fp, group (the least fingerprint of its component) and
    component_id (the least non-null id of the component). Rows of equal fingerprint are one node, so a
    group of copies is never compared or collected; only distinct fingerprints meet.

    Null, empty and blank texts have fingerprint 0 and are linked like any other. A null id takes part in
    its group; component_id is null only if every id of the group is. Repeated rows stay repeated.
    """
    rows = cut(fingerprints(docs, id_col, text_col))
    nodes = cut(rows.groupBy("fp").agg(F.min("id").alias("least_id")))
    roots = connected_components(close_links(nodes.select("fp"), distance))
    nodes = cut(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left"))
    alone = nodes.where("root IS NULL").select("fp", F.col("fp").alias("group"), F.col("least_id").alias("component_id"))
    linked = nodes.where("root IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)))
    # A large component is met in SALTS tasks: its one row comes in so many copies.
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    linked = linked.join(least, ["root", "salt"]).select("fp", F.col("root").alias("group"), "component_id")
    classes = cut(alone.unionByName(linked))
    return rows.join(classes, "fp").select("id", "th", "fp", "group", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """The rows of docs, all columns, that stand for their near-duplicate class: the least id, of equal ids
    the least text hash, of repeated rows one. A null id stands only for a class without other ids."""
    classes = near_duplicates(docs, id_col, text_col, distance)
    order = F.struct(F.col("id").isNull(), "id", "th")
    chosen = classes.groupBy("group").agg(F.min(order).alias("k")).select(F.col("k.id").alias("__id"), F.col("k.th").alias("__th"))
    # A class without ids may share its text hash with no other class, so (id, th) names the row.
    rows = docs.withColumn("__rth", text_hash(F.col(text_col))).withColumn("__key", row_key(F.col(id_col), F.col("__rth"))).alias("d")
    chosen = chosen.withColumn("__ckey", row_key(F.col("__id"), F.col("__th")))
    same = same_row(F.col(f"d.{id_col}"), F.col("__rth"), F.col("__id"), F.col("__th"))
    rows = rows.join(chosen, (F.col("__key") == F.col("__ckey")) & same, "left_semi")
    return rows.dropDuplicates(["__key", id_col, "__rth"]).drop("__rth", "__key")
