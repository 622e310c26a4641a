"""Ordered digests of row sets of any size, and comparison of two of them by going down only where they differ.

Rows that say the same become one entry with the number of its copies. An entry's place is the SHA-256 of its row, so blocks (entries whose
places begin alike) hold about as many entries each, whatever the rows look like; a block's digest is over its sorted entries, and a node's over
those of its sixteen children. Neither partitions nor the order of rows matter, and no task holds more than a block."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import bucketed, stored

#: Entries a block, about.
BLOCK = 1024
#: So many prefixes at most are put into a filter as literals, which spares buckets and row groups; more are met by a semi join.
LITERALS = 1000


@dataclass(frozen=True)
class Tree:
    """levels[d]: prefix (d hex digits), rows, digest. entries: the name of a table of block (the longest prefix), place (32 bytes), copies and
    the key's columns, bucketed by block."""

    levels: list[DataFrame]
    entries: str
    key: tuple[str, ...]

    @property
    def depth(self) -> int:
        return len(self.levels) - 1

    def root(self) -> DataFrame:
        """rows, digest of the whole; an empty table has the digest of an empty text."""
        return self.levels[0].select("rows", "digest")

    def nodes(self) -> DataFrame:
        """level, prefix, rows, digest of all nodes."""
        out = None
        for d, nodes in enumerate(self.levels):
            rows = nodes.select(F.lit(d).alias("level"), "prefix", "rows", "digest")
            out = rows if out is None else out.unionAll(rows)
        return out


def place(columns: list[str]) -> Column:
    """SHA-256 of a row. Each value has its length before it and a null is a letter, so different rows have different texts."""
    text = lambda c: F.col(f"`{c}`").cast("string")
    parts = [F.coalesce(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("n")) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def build(df: DataFrame, key: list[str], depth: int | None = None, block: int = BLOCK) -> Tree:
    """The tree of a table over all its columns, in order of name. Without a depth, the least at which blocks have about `block` entries; two
    trees are compared at one depth, so the second takes that of the first. Columns are of types that have a text (no maps)."""
    at, copies = "__place", "__copies"
    texts = {c: f"__text{i}" for i, c in enumerate(sorted(df.columns))}
    other = [c for c in key if dict(df.dtypes)[c] != "string"]  # these are no texts
    # rows meet as their texts; hashes do not compress, so they are taken behind the exchange and written once, as bytes
    rows = df.select(*[F.col(f"`{c}`").cast("string").alias(t) for c, t in texts.items()], *[f"`{c}`" for c in other])
    entries = rows.groupBy(*texts.values()).agg(*[F.first(f"`{c}`").alias(c) for c in other], F.count("*").alias(copies))
    if depth is None:
        entries = stored(entries)
        depth, n = 0, entries.count()
        while n > block * 16**depth:
            depth += 1
    named = [F.col(f"`{c}`") if c in other else F.col(texts[c]).alias(c) for c in key]
    hashed = place(list(texts.values()))
    name = bucketed(entries.select(F.substring(hashed, 1, depth).alias("__block"), F.unhex(hashed).alias(at), *named, copies), "__block", at)
    line = F.concat(F.lower(F.hex(at)), F.lit(":"), F.col(copies).cast("string"))
    level = folded(df.sparkSession.table(name), "__block", line, F.sum(copies), depth)
    levels = [stored(level)]
    for d in range(depth - 1, -1, -1):
        line = F.concat("prefix", F.lit(":"), "digest")
        level = folded(levels[0].withColumnRenamed("rows", "n").withColumn("up", F.substring("prefix", 1, d)), "up", line, F.sum("n"), d)
        levels.insert(0, stored(level))
    return Tree(levels, name, tuple(key))


def folded(rows: DataFrame, by: str, line: Column, n: Column, level: int) -> DataFrame:
    """prefix, rows, digest: the lines that share a prefix, sorted. The root is there for an empty table too."""
    rows = rows.withColumn("__line", line)
    found = [F.coalesce(n, F.lit(0)).alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list("__line")), ","), 256).alias("digest")]
    if level == 0:
        return rows.agg(*found).select(F.lit("").alias("prefix"), "rows", "digest")
    return rows.groupBy(F.col(by).alias("prefix")).agg(*found).select("prefix", "rows", "digest")


def within(df: DataFrame, column: str, some: DataFrame) -> DataFrame:
    """df's rows whose column is among the prefixes."""
    head = [r[0] for r in some.select("prefix").limit(LITERALS + 1).collect()]
    if len(head) <= LITERALS:
        return df.where(F.col(column).isin(head))
    return df.join(some.select(F.col("prefix").alias(column)), column, "left_semi")


def blocks(a: Tree, b: Tree) -> DataFrame:
    """prefix of the blocks in which two trees differ. A level is read below the nodes that differ above it."""
    if a.depth != b.depth:
        raise ValueError("trees of different depth; build the second with the depth of the first")
    differing = None
    for d in range(a.depth + 1):
        sides = []
        for tree, name in ((a, "x"), (b, "y")):
            rows = tree.levels[d].select("prefix", F.col("digest").alias(name), F.substring("prefix", 1, max(d - 1, 0)).alias("up"))
            sides.append((rows if differing is None else within(rows, "up", differing)).drop("up"))
        both = sides[0].join(sides[1], "prefix", "full_outer")
        differing = stored(both.where(~F.col("x").eqNullSafe(F.col("y"))).select("prefix"))
    return differing


def differences(a: Tree, b: Tree) -> DataFrame:
    """The key's columns, copies_a, copies_b, state: the rows that the tables do not share, by key. state is only_a or only_b, or changed where
    the key has such rows on both sides; of a row that is in both in different numbers all copies count. Only differing blocks are read."""
    if a.key != b.key:
        raise ValueError("trees with different keys")
    spark, some = a.levels[0].sparkSession, blocks(a, b)
    key = list(a.key)
    names, sums = [F.col(f"`{k}`") for k in key], [F.sum(f"copies_{s}").alias(f"copies_{s}") for s in "ab"]
    # a block's entries are a list, so both sides meet by the column that they lie by: the short list of blocks alone is exchanged
    both = some.select(F.col("prefix").alias("__block"))
    for t, side in ((a, "a"), (b, "b")):
        copies = [(F.col("__copies") if s == side else F.lit(0).cast("long")).alias(f"copies_{s}") for s in "ab"]
        lists = within(spark.table(t.entries), "__block", some).groupBy("__block").agg(F.collect_list(F.struct("__place", *names, *copies)).alias(f"rows_{side}"))
        both = both.join(lists, "__block", "left")
    rows = both.select("__block", F.explode(F.concat(*[F.coalesce(f"rows_{s}", F.array()) for s in "ab"])).alias("x")).select("__block", "x.*")
    both = rows.groupBy("__block", "__place", *names).agg(*sums).where("copies_a <> copies_b")  # one place has one key
    found = both.groupBy(*names).agg(*sums)
    return found.withColumn("state", F.when(F.col("copies_b") == 0, "only_a").when(F.col("copies_a") == 0, "only_b").otherwise("changed"))
