"""Phrase collocations: counts of n-grams in weighted acyclic automata, united by range of prefixes and composed for the counts of parts."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .automata import Automaton, Union, build, compose
from .common import new_path, ship

LONGEST = 5
LEAST = 100
BEST = 2000
#: Bytes of text that make one shard: its n-grams are counted, sorted and put into one automaton for each range of prefixes.
SHARD = 16 << 20
#: Buckets of the counting filter: one for so many bytes of text, as a power of two between these.
BYTES_A_BUCKET, LEAST_BITS, MOST_BITS = 256, 16, 28
#: Up to so many bits a task adds up its counts in a table of all buckets; beyond, it sorts those that a shard has.
TABLE_BITS = 22
#: Buckets of a slice of the filter: a place in it is two bytes.
SLICE = 1 << 16
#: Bytes of text for which there is one range of prefixes at least.
BYTES_A_RANGE = 256 << 20
#: Widths of n-grams that the filters count: the first two in one pass, the last in another.
WIDTHS = (1, 2, 3)
#: Parts over which the first rows of a language are chosen before they meet.
SALTS = 64

#: Fixed by the contract: what ends a piece, and what ends a word.
PIECE_ENDS, WORD_ENDS = b".,;:!?\n\x0b\x0c\r", b" \t"

ship(__name__)

KIND = np.zeros(256, np.uint8)
KIND[list(WORD_ENDS)] = 1
KIND[list(PIECE_ENDS)] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))


class Words:
    """The words of some texts of one language: ids in order, the piece of each, the distinct words, and a hash of language and word for each."""

    def __init__(self, lang: str, texts: list[bytes]):
        low = LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
        kind = KIND[low]
        inside = kind == 0
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        start, end = edges[::2], edges[1::2]
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[start]
        offsets = np.zeros(len(start) + 1, np.int64)
        np.cumsum(end - start, out=offsets[1:])
        each = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(low[inside])]).dictionary_encode()
        self.ids = each.indices.to_numpy().astype(np.int64)
        self.words = each.dictionary.to_pylist()
        seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))

    def pairs(self) -> np.ndarray:
        """Whether a word and the next are in one piece."""
        return self.piece[:-1] == self.piece[1:]

    def links(self, filters: list[Filter]) -> list[np.ndarray]:
        """Where a word, a pair of words, a triple starts that may be frequent: by the filters so far, and the places that the next one is to judge. A filter's
        hash of n words is made from that of n - 1, and n words can only be frequent if both n - 1 in them are."""
        h = self.hashes[self.ids]
        at, out = np.ones(len(h), bool), []
        for n in range(1, WIDTHS[-1] + 1):
            if n > 1:
                h = mixed(h[: len(h) - 1], self.hashes[self.ids[n - 1 :]])
                at = at[:-1] & at[1:] & (self.pairs() if n == 2 else True)
            done = next((f for f in filters if n in f.widths), None)
            if done is not None:
                at = at.copy()
                at[at] = done.passes(h[at])
            out.append((h, at))
        return out


def mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A hash of pairs of hashes."""
    h = (first * MIX[0] + second) * MIX[1]
    h ^= h >> np.uint64(32)
    return h * MIX[2]


def bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Language and texts, SHARD bytes or one text of more at a time. A null text is empty, a null language `und`."""
    held: dict[str, list[bytes]] = defaultdict(list)
    size = 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            t = text.as_py()
            held["und" if lang is None else lang].append(t or b"")
            size += len(t or b"")
            if size >= SHARD:
                yield from held.items()
                held, size = defaultdict(list), 0
    yield from held.items()


class Filter(NamedTuple):
    """A bitmap of the buckets in which n-grams of these widths may be frequent."""

    bits: int
    widths: tuple[int, ...]
    bitmap: np.ndarray

    def passes(self, h: np.ndarray) -> np.ndarray:
        at = bucket(h, self.bits)
        return (self.bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def packed(buckets: np.ndarray, counts: np.ndarray) -> bytes:
    """Counts of a slice, 255 at most, as whichever is shorter: one byte for each bucket, or place and count of those that have any."""
    c = np.minimum(counts, 255).astype(np.uint8)
    if 3 * len(c) < SLICE:
        return zlib.compress(buckets.astype(np.uint16).tobytes() + c.tobytes(), 1)
    dense = np.zeros(SLICE, np.uint8)
    dense[buckets] = c
    return zlib.compress(dense.tobytes(), 1)


def counting_filter(rows: DataFrame, bits: int, least: int, widths: tuple[int, ...], before: list[Filter]) -> tuple[dict[str, int], Filter]:
    """Words of each language, and the filter of the buckets whose n-grams come least times or more together.

    No n-gram that comes least times can lie in another bucket, so what the bitmap turns down is no part of a candidate; what it lets pass is
    counted exactly later. The bitmap has 2**bits bits (32 MB at MOST_BITS) at any input, which bounds what the driver holds and sends.
    """
    least = min(least, 255)  # where counts stop
    n_slices = (1 << bits) // SLICE
    schema = "slice int, n long, data binary"

    def row(k: int, n: int, data: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n], pa.int64()), pa.array([data], pa.binary())], names=["slice", "n", "data"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, np.uint8) if bits <= TABLE_BITS else None
        words: dict[str, int] = defaultdict(int)
        for lang, texts in shards(batches):
            w = Words(lang, texts)
            words[lang] += len(w.ids)
            links = w.links(before)
            of = np.concatenate([bucket(links[n - 1][0][links[n - 1][1]], bits) for n in widths])
            if table is not None:
                table[:] = np.minimum(np.bincount(of, minlength=1 << bits) + table, 255)
            else:
                found, counts = np.unique(of, return_counts=True)
                ends = np.searchsorted(found, np.arange(n_slices + 1) * SLICE)
                yield from (row(k, 0, packed(found[a:b] - k * SLICE, counts[a:b])) for k, (a, b) in enumerate(zip(ends, ends[1:])) if b > a)
        if table is not None:
            for k in range(n_slices):
                part = table[k * SLICE : (k + 1) * SLICE]
                at = np.flatnonzero(part)
                if len(at):
                    yield row(k, 0, packed(at, part[at]))
        for lang, n in words.items():
            yield row(-1, n, lang.encode("utf-8", "surrogatepass"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(SLICE, np.int32)
        words: dict[bytes, int] = defaultdict(int)
        for b in batches:
            for k, n, data in zip(*(c.to_pylist() for c in b.columns)):
                if k < 0:
                    words[data] += n
                    continue
                if k != now:
                    if now is not None:
                        yield row(now, 0, np.packbits(total >= least).tobytes())
                    now, total = k, np.zeros(SLICE, np.int32)
                data = zlib.decompress(data)
                if len(data) == SLICE:
                    total += np.frombuffer(data, np.uint8)
                else:
                    m = len(data) // 3
                    total[np.frombuffer(data, np.uint16, m)] += np.frombuffer(data, np.uint8, m, 2 * m)
                np.minimum(total, least, out=total)
        if now is not None:
            yield row(now, 0, np.packbits(total >= least).tobytes())
        for data, n in words.items():
            yield row(-1, n, data)

    parts = rows.mapInArrow(count, schema).repartition(partitions(rows, n_slices), "slice").sortWithinPartitions("slice")
    bitmap = np.zeros((n_slices, SLICE // 8), np.uint8)
    n_words: dict[str, int] = defaultdict(int)
    for r in parts.mapInArrow(add, schema).toLocalIterator():
        if r["slice"] < 0:
            n_words[bytes(r["data"]).decode("utf-8", "surrogatepass")] += r["n"]
        else:
            bitmap[r["slice"]] = np.frombuffer(bytes(r["data"]), np.uint8)
    return dict(n_words), Filter(bits, widths, bitmap.ravel())


def partitions(df: DataFrame, most: int) -> int:
    return min(most, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def grams(w: Words, filters: list[Filter], longest: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Sorted labels, and the n-grams of 1 to longest words of which every word, pair and triple passes the filters: rows of places in the labels (-1 behind
    the end), with their counts."""
    links = [at for _, at in w.links(filters)]
    order = sorted(np.unique(w.ids[links[0]]).tolist(), key=w.words.__getitem__)
    labels = [w.words[i] for i in order]
    rank = np.full(len(w.words), -1, np.int64)
    rank[order] = np.arange(len(order))
    ids = rank[w.ids]
    u, c = np.unique(ids[links[0]], return_counts=True)
    found = [(u[:, None], c)]
    key = ids.copy()  # of the n-gram that starts here
    at = np.flatnonzero(links[0])
    for n in range(2, longest + 1):
        last = links[min(n, len(links)) - 1]  # what the end of an n-gram has to pass
        start = at + n - min(n, len(links))
        fits = start < len(last)
        at = at[fits][last[start[fits]]]
        if not len(at):
            break
        u, first, inverse, c = np.unique(key[at] * len(labels) + ids[at + n - 1], return_index=True, return_inverse=True, return_counts=True)
        found.append((ids[at[first][:, None] + np.arange(n)], c))
        key[at] = inverse
    table, counts = np.full((sum(len(c) for _, c in found), longest), -1, np.int64), np.concatenate([c for _, c in found])
    start = 0
    for t, c in found:
        table[start : start + len(c), : t.shape[1]] = t
        start += len(c)
    return labels, table, counts


def prefix_range(hashes: np.ndarray, table: np.ndarray, n_ranges: int) -> np.ndarray:
    """The range of each n-gram: by a hash of its first two words, so that no single word gathers its n-grams in one task. hashes: by label."""
    first = hashes[table[:, 0]]
    h = mixed(first, np.where(table[:, 1] >= 0, hashes[table[:, 1]], np.uint64(0)))
    return ((h >> np.uint64(32)) * np.uint64(n_ranges) >> np.uint64(32)).astype(np.int64)


def range_of(lang: str, words: tuple[bytes, ...], n_ranges: int) -> int:
    seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))
    hashes = np.array([xxhash.xxh64_intdigest(x, seed) for x in words[:2]], np.uint64)
    return int(prefix_range(hashes, np.array([[0, 1 if len(words) > 1 else -1]]), n_ranges)[0])


def shard_automata(rows: DataFrame, filters: list[Filter], n_ranges: int, longest: int) -> DataFrame:
    """range, lang, data: of each shard an automaton for each range of prefixes and language, built from the shard's sorted n-grams."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in shards(batches):
            w = Words(lang, texts)
            labels, table, counts = grams(w, filters, longest)
            if not len(counts):
                continue
            by_word = dict(zip(w.words, w.hashes.tolist()))
            ranges = prefix_range(np.array([by_word[x] for x in labels], np.uint64), table, n_ranges)
            order = np.lexsort((*table.T[::-1], ranges))
            ranges, table, counts = ranges[order], table[order], counts[order]
            ends = np.flatnonzero(np.diff(ranges, prepend=-1, append=-1))
            out = []
            for a, b in zip(ends, ends[1:]):
                lengths = (table[a:b] >= 0).sum(1).tolist()
                items = ((tuple(x[:k]), c) for x, k, c in zip(table[a:b].tolist(), lengths, counts[a:b].tolist()))
                auto = build(items)
                out.append((int(ranges[a]), Automaton(auto.counts, [tuple((labels[i], t) for i, t in arcs) for arcs in auto.arcs]).dumps()))
            n, data = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array([lang] * len(n)), pa.array(data, pa.binary())], names=["range", "lang", "data"])

    return rows.mapInArrow(task, "range int, lang string, data binary")


def united(parts: DataFrame, n_ranges: int, least: int) -> DataFrame:
    """range, lang, data: one automaton for each range and language, counts added up; n-grams below least are left out."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, Union()

        def row() -> Iterator[pa.RecordBatch]:
            if now is not None and len((auto := held.result(least)).counts) > 1:
                yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]]), pa.array([auto.dumps()], pa.binary())], names=["range", "lang", "data"])

        for b in batches:
            for n, lang, data in zip(*(c.to_pylist() for c in b.columns)):
                if (n, lang) != now:
                    yield from row()
                    now, held = (n, lang), Union()
                held.add(Automaton.loads(data))
        yield from row()

    together = parts.repartition(partitions(parts, n_ranges), "range").sortWithinPartitions("range", "lang")
    return together.mapInArrow(task, "range int, lang string, data binary")


def parts_asked(counts: DataFrame, n_ranges: int) -> DataFrame:
    """range, lang, source, data: for each range of prefixes an automaton of the parts whose counts the candidates of range `source` need.

    First parts of two words and more start as their candidate does, so their counts are in its own range; asked for are first words and rests.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, lang, data in zip(*(c.to_pylist() for c in b.columns)):
                asked = {p for c, _ in Automaton.loads(data) if len(c) > 1 for p in (c[:1], *(c[k:] for k in range(1, len(c))))}
                by: dict[int, list] = defaultdict(list)
                for p in asked:
                    by[range_of(lang, p, n_ranges)].append(p)
                if by:
                    every = [build((p, 1) for p in sorted(ps)).dumps() for ps in by.values()]
                    m = len(every)
                    yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.int32()), pa.array([lang] * m), pa.array([n] * m, pa.int32()), pa.array(every, pa.binary())], names=["range", "lang", "source", "data"])

    return counts.mapInArrow(task, "range int, lang string, source int, data binary")


def parts_counted(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """range, lang, data: what a range has asked for, with counts: asked automata composed with the counts of their range. `range` is the one that asked."""

    def task(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        known = [Automaton.loads(data.as_py()) for data in right.column("data")]  # one; a part that nobody counted has no place in any candidate
        every = [build(compose(Automaton.loads(data.as_py()), known[0])).dumps() for data in left.column("data")] if known else []
        n = len(every)
        return pa.Table.from_arrays([left.column("source").slice(0, n), left.column("lang").slice(0, n), pa.array(every, pa.binary())], names=["range", "lang", "data"])

    return asked.groupBy("range", "lang").cogroup(counts.groupBy("range", "lang")).applyInArrow(task, "range int, lang string, data binary")


def scored(counts: DataFrame, answers: DataFrame, n_words: dict[str, int]) -> DataFrame:
    """lang, phrase, a, l, r, n, score of every candidate, and with null score the phrases that a longer candidate covers."""

    def task(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        lang = left.column("lang")[0].as_py()
        n = n_words[lang]
        found: dict[tuple, int] = {}
        for data in right.column("data"):
            found.update(Automaton.loads(data.as_py()))
        own = {p: c for data in left.column("data") for p, c in Automaton.loads(data.as_py())}
        rows, covered = [], set()
        for c, a in own.items():
            if len(c) < 2:
                continue
            cuts = [(own[c[:k]] if k > 1 else found[c[:1]], found[c[k:]]) for k in range(1, len(c))]
            score, _, left_count, right_count = min((1000 * a * n // (x * y), k, x, y) for k, (x, y) in enumerate(cuts))
            rows.append((c, a, left_count, right_count, score))
            if len(c) > 2:  # a phrase inside a longer one with its count is also inside one of one word more with it
                covered |= {p for p, f in ((c[:-1], cuts[-1][0]), (c[1:], cuts[0][1])) if f == a}
        rows += [(p, None, None, None, None) for p in covered]
        phrases, *numbers = zip(*rows) if rows else [()] * 5
        columns = [pa.array([lang] * len(rows), pa.string()), pa.array([b" ".join(p).decode() for p in phrases], pa.string()), *(pa.array(x, pa.int64()) for x in numbers)]
        return pa.Table.from_arrays(columns, names=["lang", "phrase", "a", "l", "r", "score"])

    return counts.groupBy("range", "lang").cogroup(answers.groupBy("range", "lang")).applyInArrow(task, "lang string, phrase string, a long, l long, r long, score long")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, best: int = BEST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to longest words.

    Words, pieces, counts, cuts and ties are those of the result contract (README). A null text is empty and a null language `und`; a language without a
    candidate has no row, and an empty table none. Rows that repeat count again. Counts are exact and of any size; texts are never cut.

    1. Hashed counts of words and pairs of words, added up over all rows, tell which cannot come `least` times; then those of three words whose pairs may.
    2. Each shard counts its n-grams of what is left, sorts them and builds an automaton for each range of prefixes (written once).
    3. Each range unites its automata and keeps the n-grams that come `least` times or more: candidates, and all parts that any can have.
    4. Ranges ask one another for the counts of parts, as automata that are composed with the counts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").cast("binary").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    bits = min(MOST_BITS, max(LEAST_BITS, (size // BYTES_A_BUCKET).bit_length()))
    n_ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BYTES_A_RANGE)
    n_words, single = counting_filter(rows, bits, least, WIDTHS[:2], [])
    _, triple = counting_filter(rows, bits, least, WIDTHS[2:], [single])

    def written(df: DataFrame, name: str) -> DataFrame:
        path = new_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    parts = written(shard_automata(rows, [single, triple], n_ranges, longest), "grams")
    counts = written(united(parts, n_ranges, least), "counts")
    answers = parts_counted(parts_asked(counts, n_ranges), counts)
    every = written(scored(counts, answers, n_words), "phrases")
    covered = every.where("score IS NULL").select("lang", "phrase")
    kept = every.where("score IS NOT NULL").join(covered, ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    first = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = first.withColumn("k", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("k") <= best)
    top = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)  # SALTS * best rows a language at most
    n = F.create_map(*[F.lit(x) for pair in n_words.items() for x in pair]) if n_words else F.create_map().cast("map<string,bigint>")
    return top.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.element_at(n, F.col("lang")).cast("long").alias("n"), "score")
