"""BM25 for a few queries by one pass over the units, without an index: the pass counts the units of every term and keeps those units that can be among
the best, whatever the terms' weights turn out to be."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, fsum, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.shared import cut, ship, stored
from .inner import order_key
from .retrieval import best_k, tokenize

#: Distinct terms of the queries that a pass asks for; with more of them an index pays.
TERMS = 128
#: Bytes of text that a task reads at once, about, or those of one longer text.
BYTES = 4_000_000
#: Numbers that a task keeps of its candidates, about.
CELLS = 4_000_000
#: Units whose hashes are looked at together, and units whose terms are added up together.
HASHES, ADDED = 4_000_000, 1_000_000
TOTAL, COUNT, FOUND = range(3)

ship(__name__)


def edges_and_bytes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Where the texts begin and end in the bytes of all of them."""
    _, offsets, data = texts.cast(pa.string()).buffers()
    edge = np.frombuffer(offsets, np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    return edge - edge[0], np.frombuffer(data, np.uint8, edge[-1] - edge[0], edge[0]) if edge[-1] > edge[0] else np.zeros(0, np.uint8)


def words(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """The tokens of some texts without nulls (see tokenize), and how many each text has."""
    edge, raw = edges_and_bytes(texts)
    if len(raw) and raw.max() > 127:  # the only other characters that in lower case have one of a-z
        edge, raw = edges_and_bytes(pc.replace_substring(pc.replace_substring(texts, "\u0130", "i\u0307"), "\u212a", "k"))
    raw = raw + 32 * (raw - 65 < 26).view(np.uint8)  # arithmetic modulo 256
    inside = (raw - 97 < 26) | (raw - 48 < 10)
    apart = np.zeros(len(raw) + 1, bool)  # a text ends before this byte
    apart[edge] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | apart[1:-1]
    ends[:-1] &= ~inside[1:] | apart[1:-1]
    start = np.flatnonzero(begins)
    size = np.flatnonzero(ends) + 1 - start
    inside[start[size == 1]] = False
    start, size = start[size > 1], size[size > 1]
    places = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(places), pa.py_buffer(raw[inside])), np.diff(np.searchsorted(start, edge))


def in_pieces(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    size = pc.binary_length(b.column("text")).to_numpy().astype(np.int64)
    piece = (np.cumsum(size) - size) // BYTES
    edges = np.flatnonzero(np.diff(piece, prepend=-1))
    for start, stop in zip(edges, [*edges[1:], len(size)]):
        yield b.slice(start, stop - start)


def classes(rows: np.ndarray) -> np.ndarray:
    """A number for each row of whole numbers, the same for equal rows."""
    out, size = np.zeros(len(rows), np.int64), 1
    for column in rows.T if len(rows) else ():
        low, span = int(column.min()), int(column.max()) - int(column.min()) + 1
        if span == 1:
            continue
        if size * span >= 1 << 62:
            out = np.unique(out, return_inverse=True)[1]
            size = int(out.max()) + 1
        out, size = out * span + (column - low), size * span
    return out


def order_of(units: pa.Array) -> np.ndarray:
    """The place of each unit in Spark's order, null first."""
    if pa.types.is_nested(units.type):
        names = units.to_pylist()
        order = sorted(range(len(names)), key=lambda i: order_key(names[i]))
    else:
        order = pc.sort_indices(units, null_placement="at_start").to_numpy()
    place = np.empty(len(units), np.int64)
    place[order] = np.arange(len(units))
    return place


def first_of(group: np.ndarray, k: int, *order: np.ndarray) -> np.ndarray:
    """The first k rows of each group in an order, given from its last key to its first."""
    rows = np.lexsort((*order, group))
    start = np.flatnonzero(np.diff(group[rows], prepend=group[rows[0]] - 1)) if len(rows) else np.zeros(0, np.int64)
    return rows[np.arange(len(rows)) - np.repeat(start, np.diff(np.append(start, len(rows)))) < k]


class Candidates:
    """Of the units that no query can tell apart (as many of each term, and as long) the k least ones."""

    def __init__(self, k: int):
        self.k, self.rows, self.units, self.cells = k, [], [], 0

    def add(self, rows: np.ndarray, units: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
        """Gives out what it has if that stays too much."""
        self.rows.append(rows)
        self.units.append(units)
        self.cells += rows.size
        if self.cells > CELLS:
            self.thin()
            if self.cells > CELLS // 2:
                yield from self.take()

    def thin(self) -> None:
        rows, units = np.concatenate(self.rows), pa.concat_arrays(self.units)
        kept = first_of(classes(rows), self.k, order_of(units))
        self.rows, self.units, self.cells = [rows[kept]], [units.take(pa.array(kept))], rows[kept].size

    def take(self) -> Iterator[tuple[np.ndarray, pa.Array]]:
        if self.rows:
            self.thin()
            for a in range(0, len(self.rows[0]), 10_000):
                yield self.rows[0][a : a + 10_000], self.units[0].slice(a, 10_000)
        self.rows, self.units, self.cells = [], [], 0


def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The numbers that come more than once. A number is held once."""
    held, more, new = [], [], 0

    def meet() -> None:
        values = np.sort(np.concatenate(held)) if held else np.zeros(0, np.int64)
        first = np.ones(len(values), bool)
        first[1:] = values[1:] != values[:-1]
        more[:] = [np.unique(np.concatenate([*more, values[~first]]))]
        held[:] = [values[first]]

    for b in batches:
        held.append(b.column(0).to_numpy())
        new += len(held[-1])
        if new > 2 * HASHES:
            meet()
            new = 0
    meet()
    yield pa.RecordBatch.from_arrays([pa.array(more[0], pa.int64())], names=["h"])


def one_row_a_unit(units: DataFrame) -> DataFrame:
    """Rows of one unit become one text. Units are told apart by hash first, so that only those of a hash that comes again are gathered."""
    parts = max(1, ceil(units.count() / HASHES))
    again = cut(units.select(F.xxhash64("unit").alias("h")).repartition(parts, "h").mapInArrow(repeated, "h long"))
    if again.isEmpty():
        return units
    rows = units.withColumn("h", F.xxhash64("unit"))
    merged = rows.join(again, "h", "left_semi").groupBy("unit").agg(F.concat_ws("\n", F.collect_list("text")).alias("text"))
    return rows.join(again, "h", "left_anti").select("unit", "text").unionByName(merged)


def counted(units: DataFrame, terms: list[str], k: int) -> DataFrame:
    """kind, term, found, n, times, written once. TOTAL: how many units there are and how many tokens (n). COUNT: how many terms (times) come in n units;
    one of the asked terms stands by itself. FOUND: a unit that may be among a query's k best, its length and how often it has each asked term."""
    kind = units.schema["unit"].dataType
    found = T.StructType([T.StructField("unit", kind), T.StructField("len", T.LongType()), T.StructField("tfs", T.BinaryType())])
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("term", T.StringType()), T.StructField("found", found), T.StructField("n", T.LongType())])
    arrow = pa.struct([("unit", to_arrow_type(kind)), ("len", pa.int64()), ("tfs", pa.binary())])

    def rows_of(which: int, terms: pa.Array | None, found: pa.Array | None, n: np.ndarray) -> pa.RecordBatch:
        nulls = lambda t: pa.nulls(len(n), t)
        columns = [pa.array(np.full(len(n), which), pa.int32()), nulls(pa.string()) if terms is None else terms, nulls(arrow) if found is None else found, pa.array(n, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["kind", "term", "found", "n"])

    def candidates(given: Iterator[tuple[np.ndarray, pa.Array]]) -> Iterator[pa.RecordBatch]:
        for rows, units in given:
            tfs = pa.array([r.tobytes() for r in np.ascontiguousarray(rows[:, :-1])], pa.binary())
            yield rows_of(FOUND, None, pa.StructArray.from_arrays([units, pa.array(rows[:, -1], pa.int64()), tfs], fields=list(arrow)), np.ones(len(rows), np.int64))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, total, asked = Candidates(k), np.zeros(2, np.int64), pa.array(terms, pa.string())
        for b in (piece for whole in batches for piece in in_pieces(whole)):
            tokens, lengths = words(b.column("text"))
            coded = tokens.dictionary_encode()
            code, size = coded.indices.to_numpy(), max(1, len(coded.dictionary))
            row = np.repeat(np.arange(len(lengths)), lengths)
            pair = np.sort(row * size + code)
            yield rows_of(COUNT, coded.dictionary, None, np.bincount(pair[np.diff(pair, prepend=-1) > 0] % size, minlength=len(coded.dictionary)))
            place = pc.fill_null(pc.index_in(coded.dictionary, value_set=asked), -1).to_numpy()[code]
            on = place >= 0
            tf = np.bincount(row[on] * len(terms) + place[on], minlength=len(lengths) * len(terms)).reshape(len(lengths), len(terms))
            total += len(lengths), lengths.sum()
            yield from candidates(kept.add(np.column_stack([tf, lengths]).astype(np.int32), b.column("unit")))
        yield from candidates(kept.take())
        yield rows_of(TOTAL, pa.array(["units", "tokens"]), None, total)

    rows = units.select("unit", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(task, schema)
    spark = units.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(units.count() / ADDED))
    # many terms are rare: adding them up before they meet takes memory and spares little
    added = rows.repartition(parts, "term", "found").groupBy("kind", "term", "found").agg(F.sum("n").alias("n"))
    own = F.when((F.col("kind") == TOTAL) | F.col("term").isin(terms), F.col("term"))
    return stored(added.select("kind", own.alias("term"), "found", "n").groupBy("kind", "term", "found", "n").agg(F.count("*").alias("times")))


def weights(rows: list, units: int) -> dict[str, float]:
    """The idf of the asked terms. A negative one becomes a quarter of the mean of all terms."""
    raw = lambda n: log(units - n + 0.5) - log(n + 0.5)
    mean = fsum(raw(r["n"]) * r["times"] for r in rows) / max(1, sum(r["times"] for r in rows))
    return {r["term"]: 0.25 * mean if raw(r["n"]) < 0 else raw(r["n"]) for r in rows if r["term"] is not None}


def asked_terms(queries: DataFrame) -> dict | None:
    """The terms of each query and how often it has them; None if queries or terms are too many for a pass."""
    own = tokenize(F.col("text"))
    if max(x.limit(TERMS + 1).count() for x in (queries, queries.select(F.explode(own)).distinct())) > TERMS:
        return None
    out: dict = {}
    for r in queries.select("query_id", own.alias("terms")).collect():  # TERMS rows at most
        mine = out.setdefault(r["query_id"], {})
        for t in r["terms"]:
            mine[t] = mine.get(t, 0) + 1
    return out


def bm25_scan(units: DataFrame, id_col: str, text_col: str, asked: dict, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, unit, score, rank, as bm25_top of an index of the units gives them. asked: asked_terms(queries).

    Units with as many of each asked term and of one length score alike for every query, so of them a task keeps the k least; what is kept is scored once
    the terms' units are counted.
    """
    terms = sorted(set().union(*asked.values()))
    rows = counted(one_row_a_unit(units.select(F.col(id_col).alias("unit"), F.col(text_col).alias("text"))), terms, k)
    # numbers of units that some term comes in: fewer than the square root of twice the pairs of term and unit
    known = rows.where(F.col("kind") != FOUND).select("kind", "term", "n", "times").collect()
    total = {r["term"]: r["n"] for r in known if r["kind"] == TOTAL}
    n = total.get("units") or 0
    idf, mean = weights([r for r in known if r["kind"] == COUNT], n), (total.get("tokens") or 0) / max(1, n) or 1.0
    names = list(asked)
    factor = np.array([[asked[q].get(t, 0) * idf.get(t, 0.0) for t in terms] for q in names], float).reshape(len(names), len(terms))
    kinds = [queries.schema["query_id"].dataType, rows.schema["found"].dataType["unit"].dataType]
    schema = T.StructType([T.StructField("query_id", kinds[0]), T.StructField("unit", kinds[1]), T.StructField("score", T.DoubleType())])
    arrow_q = to_arrow_type(kinds[0])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = batch.column("unit")
            tf = np.frombuffer(b"".join(batch.column("tfs").to_pylist()), np.int32).reshape(len(units), len(terms)).astype(float)
            norm = k1 * (1 - b + b * batch.column("len").to_numpy() / mean)
            adds, place = tf * (k1 + 1) / (tf + norm[:, None]), order_of(units)
            for name, f in zip(names, factor):
                score = np.round((adds * f).sum(1), 9) + 0.0
                best = np.lexsort((place, -score))[:k]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(best), arrow_q), units.take(pa.array(best)), pa.array(score[best])], names=["query_id", "unit", "score"])

    return best_k(rows.where(F.col("kind") == FOUND).select("found.*").mapInArrow(task, schema), k)
