"""Token ids as Parquet list columns, in document order, for selective reads of tokens or of their counts."""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import ship, text_hash, worker_state

#: Pieces that a Python worker keeps with their ids (about 60 bytes each): beyond, the half that was used last stays.
CACHE = 300_000
#: Text bytes that make one batch of the output.
SLICE = 1 << 21
#: Layout of the files. Token ids repeat, so they are dictionary-coded; the rising document ids and offsets
#: overflow their dictionary and are delta-coded by version 2 of the format. Pages hold few rows, and the
#: page index lets a reader skip to the ones that it wants.
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.dictionary.page.size": str(512 << 10),
}

ship(__name__)

#: White space but the single space and the line feed, marks used below, and what may be a special token.
ODD = r"^[ \n]|[ \n]$|  | \n|\n |\n\n\n|<\||[\x01-\x05\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A point or comma before white space that may belong to a longer piece.
LOOSE = r"(?:^|[^A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}])[.,][ \n]"
POINT, COMMA, FIRST, END = "\x01", "\x02", "\x04", "\x05"
#: Words that go through the tokenizer as one text, and texts at once.
TOGETHER = 500
BATCH = 16


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all ranges from starts on, each with its count, one after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Encodes texts a column at a time; keeps the ids of pieces that recur.

    A byte-level tokenizer splits before each single space, around a single line feed and between a
    letter and a point or comma, and encodes what lies between on its own. So a text whose white space is
    of that kind is the sequence of its pieces' ids; any other text goes through the tokenizer whole.
    Pieces: a word that follows a space, a line feed and the word behind it, a first word, and a point
    or comma behind a letter. Each is encoded once for a column, if it is not among the pieces kept.
    """

    def __init__(self, vocabulary: str, end: int):
        self.tokenizer = Tokenizer.from_str(vocabulary)
        pre = self.tokenizer.pre_tokenizer
        split = pre and [x for x, _ in pre.pre_tokenize_str("a b.\n\nc, d")]
        self.by_piece = split == ["a", "Ġb", ".", "Ċ", "Ċ", "c", ",", "Ġd"] and self.tokenizer.normalizer is None
        self.begins = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that begin a word with a space
        self.begins[[i for t, i in self.tokenizer.get_vocab().items() if t[:1] == "Ġ"]] = True
        self.end = np.array([end], np.int32)
        self.known = pa.array([], pa.string())
        self.ids = np.zeros(0, np.int32)  # of all known pieces, one after the other
        self.starts, self.counts, self.used = (np.zeros(0, np.int64) for _ in range(3))
        self.turn = 0

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, and how many each has. Few texts at once: the tokenizer's own results are large."""
        coded = []
        for lo in range(0, len(texts), BATCH):
            coded += [array("i", c.ids) for c in self.tokenizer.encode_batch_fast(texts[lo : lo + BATCH], add_special_tokens=False)]
        return np.frombuffer(b"".join(coded), np.int32), np.fromiter(map(len, coded), np.int64, len(coded))

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words without white space, each behind a space. Many words are one text, in which the ids that
        begin with a space show where each starts."""
        ids, _ = self.whole(["".join([" " + w for w in words[i : i + TOGETHER]]) for i in range(0, len(words), TOGETHER)])
        at = np.flatnonzero(self.begins[ids])
        if len(at) != len(words) or len(at) and at[0]:
            return self.whole([" " + w for w in words])
        return ids, np.diff(at, append=len(ids))

    def learn(self, new: pa.StringArray) -> np.ndarray:
        """Encodes new pieces and keeps them; returns their places among the known ones."""
        pieces = new.to_numpy(zero_copy_only=False).tolist()
        mark = np.fromiter((p < "\x0b" for p in pieces), bool, len(pieces))  # begins with a line feed or a mark
        said = {POINT: ".", COMMA: ","}
        ids, counts = self.words([p for p, m in zip(pieces, mark) if not m])
        marked = [p for p, m in zip(pieces, mark) if m and p != END]
        more, their = self.whole([said.get(p) or p.removeprefix(FIRST) for p in marked])
        order = np.concatenate((np.flatnonzero(~mark), [i for i in np.flatnonzero(mark) if pieces[i] != END], [i for i in np.flatnonzero(mark) if pieces[i] == END])).astype(np.int64)
        counts = np.concatenate((counts, their, np.ones(len(order) - len(counts) - len(their), np.int64)))
        ids = np.concatenate((ids, more, self.end[: len(order) - len(pieces) + pieces.count(END)]))
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(counts) - counts))
        self.counts, self.ids = np.concatenate((self.counts, counts)), np.concatenate((self.ids, ids))
        places = np.empty(len(order), np.int64)
        places[order] = len(self.known) + np.arange(len(order))
        self.known = pa.concat_arrays([self.known, new.take(pa.array(order))])
        self.used = np.concatenate((self.used, np.full(len(order), self.turn)))
        return places

    def forget(self) -> None:
        """Leaves the half of CACHE that was in use last."""
        keep = np.sort(np.argsort(-self.used, kind="stable")[: CACHE // 2])
        self.known, self.used = self.known.take(pa.array(keep)), self.used[keep]
        self.ids = self.ids[ranges(self.starts[keep], self.counts[keep])]
        self.counts = self.counts[keep]
        self.starts = np.cumsum(self.counts) - self.counts

    def encode(self, texts: pa.StringArray) -> pa.ListArray:
        """The ids of each text and the end id."""
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False) if self.by_piece else np.ones(len(texts), bool)
        plain = texts.filter(pa.array(~odd)) if odd.any() else texts
        stops = pc.replace_substring(plain, "\n", " \n")
        for stop, said in ((". ", f" {POINT} "), (", ", f" {COMMA} ")):
            stops = pc.replace_substring(stops, stop, said)
        plain = pc.if_else(pc.match_substring_regex(plain, LOOSE), pc.replace_substring(plain, "\n", " \n"), stops)
        split = pc.split_pattern(pc.binary_join_element_wise(FIRST, plain, " " + END, ""), " ")
        pieces = split.flatten().dictionary_encode()
        self.turn += 1
        at = pc.index_in(pieces.dictionary, value_set=self.known)
        new = at.is_null().to_numpy(zero_copy_only=False)
        at = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if new.any():
            at[new] = self.learn(pieces.dictionary.filter(pa.array(new)))
        self.used[at] = self.turn
        at = at[pieces.indices.to_numpy(zero_copy_only=False)]
        counts = self.counts[at]
        ids = self.ids[ranges(self.starts[at], counts)]
        ends = np.concatenate(([0], np.cumsum(counts)))[split.offsets.to_numpy() - split.offsets[0].as_py()]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
        if len(self.known) > CACHE:
            self.forget()
        if not odd.any():
            return lists
        ids, counts = self.whole(texts.filter(pa.array(odd)).to_pylist())
        ends = np.cumsum(counts)
        rest = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends + np.arange(1, len(ends) + 1))), pa.int32()), pa.array(np.insert(ids, ends, self.end[0])))
        order = np.empty(len(odd), np.int64)
        order[~odd], order[odd] = np.arange(len(lists)), np.arange(len(lists), len(odd))
        return pa.concat_arrays([lists, rest]).take(pa.array(order))


def worker_encoder(vocabulary: str, end: int) -> Encoder:
    """The encoder of this Python worker, which Spark uses for many tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    kept = worker_state()
    key = ("encoder", hash(vocabulary), end)
    if key not in kept:
        kept[key] = Encoder(vocabulary, end)
    return kept[key]


def write_tokens(docs: DataFrame, path: str, vocabulary: str | Path, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes every document's token ids and the end id to Parquet, in ascending order of the id.

    Columns: id, th (text hash, orders rows of one id), shard (number of the file in the order), n_tokens,
    tokens (array of int). Null and empty texts have the end id alone; null ids come first; repeated rows
    are written repeatedly; an empty table gives files without rows. vocabulary is a tokenizers JSON file on
    the driver; its content goes to the executors. The path must be new.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Path(vocabulary).read_text())  # a fixed file
    rows = docs.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("th"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("th", T.LongType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("tokens", T.ArrayType(T.IntegerType()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared.value, end)
        for b in batches:
            lo, ends = 0, np.cumsum(pc.binary_length(b.column(2)).to_numpy(zero_copy_only=False), dtype=np.int64)
            while lo < len(ends):
                begin = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, begin + SLICE, "right")))
                lists = encoder.encode(b.column(2).slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), lists.value_lengths(), lists], names=schema.names)
                lo = hi
        pa.default_memory_pool().release_unused()

    rows = rows.repartitionByRange("id", "th").sortWithinPartitions("id", "th")
    coded = rows.mapInArrow(task, schema).withColumn("shard", F.spark_partition_id())
    coded.select("id", "th", "shard", "n_tokens", "tokens").write.options(**LAYOUT).parquet(path)


def with_start(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds start, the number of ids of all documents before, to rows; counts: shard and n_tokens of all rows."""
    shards = counts.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a file
    inside = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("id", "th").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("inside", inside).join(shards.select("shard", before.alias("before")), "shard")
    return rows.withColumn("start", F.col("before") + F.col("inside") - F.col("n_tokens")).drop("before", "inside")


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """id, th, shard, n_tokens and start of every document. Reads no tokens."""
    rows = spark.read.parquet(path).select("id", "th", "shard", "n_tokens")
    return with_start(rows, rows)


def read_tokens(spark: SparkSession, path: str, ids: list | None = None) -> DataFrame:
    """id, th, shard, tokens; of some ids alone if given, which prunes files, row groups and pages."""
    rows = spark.read.parquet(path).select("id", "th", "shard", "tokens")
    return rows if ids is None else rows.where(F.col("id").isin(ids))


def checksums(tokens: DataFrame) -> DataFrame:
    """Of rows with tokens: id, th, shard, n_tokens and crc (of the ids as little-endian 32-bit integers)."""
    schema = T.StructType([tokens.schema[c] for c in ("id", "th", "shard")] + [T.StructField("n_tokens", T.LongType()), T.StructField("crc", T.LongType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
            crc = [zlib.crc32(values[lo:hi].tobytes()) for lo, hi in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())], names=schema.names)

    return tokens.select("id", "th", "shard", "tokens").mapInArrow(task, schema)


def token_table(docs: DataFrame, path: str, vocabulary: str | Path, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the tokens of docs to path, reads them back, and returns per row: id, start, n_tokens, crc."""
    spark = docs.sparkSession
    write_tokens(docs, path, vocabulary, end, id_col, text_col)
    rows = with_start(checksums(read_tokens(spark, path)), spark.read.parquet(path))
    return rows.select("id", "start", "n_tokens", "crc")
