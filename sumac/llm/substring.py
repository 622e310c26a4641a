"""Substring deduplication: Rabin-Karp hashes of every window of words, counted in Spark."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, text_hash

WINDOW = 35
#: Text bytes whose windows are hashed and packed together: what a task holds, but for one longer document.
SLICE = 1 << 20
#: Text bytes behind one range of hashes, the unit that is counted at once.
RANGE_BYTES = 1 << 24
#: Bits of the hash by which a slice is dealt over tasks: 4,096 rows a slice at most, whatever the input. Beyond, each
#: task deals what it gets into narrower ranges, without another shuffle.
MOST_BITS = 12
#: Bytes of packed windows that a task deals at once.
DEAL_BYTES = 1 << 25
#: Longer words are hashed as a whole.
LONG_WORD = 4096

ship(__name__)

BYTE_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
WORD_BASE = np.array([0xC2B2AE3D27D4EB4F], np.uint64)
OTHER_BASE = np.array([0xD6E8FEB86659FD93], np.uint64)
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads each value over all 64 bits, one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


POWER = powers(BYTE_BASE, SLICE + 1)
INVERSE = powers(np.uint64(pow(int(BYTE_BASE), -1, 1 << 64)), SLICE + 1)


def long_hash(word: bytes) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(word, digest_size=8).digest(), np.uint64)


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every white-space word, which depends on the word alone, and where each begins: a
    polynomial, or for words beyond LONG_WORD bytes a digest. Texts beyond SLICE are cut behind spaces."""
    if len(text) > SLICE:
        hashes, starts, lo = [], [], 0
        while lo < len(text):
            hi = min(len(text), lo + SLICE)
            if hi < len(text):  # end behind a space
                spaces = np.flatnonzero(SPACE[np.frombuffer(text, np.uint8, hi - lo, lo)])
                if not len(spaces):  # a word longer than a slice
                    hi = next((i for i in range(hi, len(text)) if SPACE[text[i]]), len(text))
                    hashes.append(long_hash(text[lo:hi]))
                    starts.append(np.array([lo]))
                    lo = hi
                    continue
                hi = lo + int(spaces[-1]) + 1
            h, at = word_hashes(text[lo:hi])
            hashes.append(h)
            starts.append(at + lo)
            lo = hi
        return np.concatenate(hashes), np.concatenate(starts)
    raw = np.frombuffer(text, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], SPACE[raw], [True])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * INVERSE[: len(raw)], dtype=np.uint64)))
    hashes = mixed((sums[end] - sums[start]) * POWER[end])
    for i in np.flatnonzero(end - start > LONG_WORD):
        hashes[i] = long_hash(text[start[i] : end[i]])[0]
    return hashes, start


def window_hashes(words: np.ndarray, size: int, base: np.ndarray = WORD_BASE) -> np.ndarray:
    """Rabin-Karp hash of every window of size word hashes, by joining runs of doubling length."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    run, length, power = words, 1, base
    total, have = None, 0
    while True:
        if size & length:  # the next length words of each window
            if total is None:
                total, have = run, length
            else:
                n = min(len(total), len(run) - have)
                total, have = total[:n] * power + run[have : have + n], have + length
        if have == size:
            return mixed(total[: len(words) - size + 1])
        run, power, length = run[:-length] * power + run[length:], power * power, 2 * length


def pack(positions: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of rising numbers as gaps of a byte each; 255 says that the gap goes on. ends: of the rows among the
    numbers. Returns the bytes and where each row ends among them."""
    gaps = np.diff(positions, prepend=0)
    gaps[starts_of(ends)] = positions[starts_of(ends)]
    last = np.cumsum(gaps // 255 + 1)
    out = np.full(int(last[-1]) if len(last) else 0, 255, np.uint8)
    out[last - 1] = gaps % 255
    return out, last[ends - 1]


def unpack(raw: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all rows. starts: of the rows among the bytes; counts: numbers of each row."""
    sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(raw, dtype=np.int64)))
    return sums[1:][raw < 255] - np.repeat(sums[starts], counts)


def starts_of(ends: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.int64), ends[:-1]))[: len(ends)]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return edge[::2], edge[1::2]


#: One row of the packed exchange: windows of one slice (part, slice) in one range of hashes, with the places of the
#: windows in the slice and the hashes; or, where a task has dealt them on, windows of many slices in one narrower range
#: (sub), with part, slice and place of each as 32-bit numbers (origins). A row without hashes describes a slice.
PACKED = "range long, sub long, part long, slice long, at binary, hashes binary, origins binary, id_hashes binary, text_hashes binary, lengths binary"
INT, BIN = pa.int64(), pa.binary()
ARROW = pa.schema([(x.split()[0], INT if x.endswith("long") else BIN) for x in PACKED.split(", ")])


def binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Bytes as an array of rows."""
    offsets = np.concatenate((np.zeros(1, np.int64), ends)).astype(np.int32)
    return pa.Array.from_buffers(BIN, len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def packed_rows(n: int, **columns: pa.Array | np.ndarray | int) -> pa.RecordBatch:
    """n rows of the exchange; columns that are not given are null."""

    def column(f: pa.Field) -> pa.Array:
        x = columns.get(f.name)
        if x is None:
            return pa.nulls(n, f.type)
        return x if isinstance(x, pa.Array) else pa.array(np.full(n, x) if np.isscalar(x) else x, f.type)

    return pa.RecordBatch.from_arrays([column(f) for f in ARROW], schema=ARROW)


def row_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows of a binary column and the ends of its rows among them."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def wide(tails: np.ndarray, width: int) -> np.ndarray:
    """Numbers of width bytes each as 64-bit ones."""
    full = np.zeros((len(tails) // width, 8), np.uint8)
    full[:, :width] = tails.reshape(-1, width)
    return full.view("<u8").ravel()


def unpacked(rows: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of rows that have hashes: the number of each one's row, its hash, and part, slice and place."""
    tails, ends = row_bytes(rows.column("hashes"))
    counts = np.diff(ends, prepend=0) // width
    row = np.repeat(np.arange(rows.num_rows), counts)
    if rows.num_rows and rows.column("origins")[0].is_valid:
        data, _ = row_bytes(rows.column("origins"))
        origins = data.view("<i4").reshape(-1, 3)
    else:
        raw, ends = row_bytes(rows.column("at"))
        places = unpack(raw, starts_of(ends), counts)
        origins = np.stack([rows.column("part").to_numpy()[row], rows.column("slice").to_numpy()[row], places], 1).astype(np.int32)
    return row, wide(tails, width), origins


def layout(size: int) -> tuple[int, int, int]:
    """Of so many bytes of text: the bits of the ranges, those of narrower ranges in each, and bytes of the hash sent."""
    needed = max(4, (size // RANGE_BYTES).bit_length())
    return min(needed, MOST_BITS), max(0, needed - MOST_BITS), 7 if needed <= MOST_BITS else 8


def chunks(b: pa.RecordBatch, size: int) -> Iterator[tuple[int, int]]:
    """Parts of a batch's rows of about so many bytes."""
    step = max(1, int(b.num_rows * size // max(1, b.nbytes)))
    return ((lo, min(b.num_rows, lo + step)) for lo in range(0, b.num_rows, step))


def repeated_spans(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal runs of words that lie in windows occurring more than once.

    Returns kh, th (hashes that name the row: of its id and of its text) and spans, an array of rising,
    disjoint [start, end) word positions, for rows with at least one. Rows with equal id and text have the
    same spans, so they share one result row.

    One task packs the window hashes of about SLICE bytes of text by hash range: 7 bytes a window, besides
    the range, and a byte or two for its place, each hash once a slice, so that a passage that fills a third
    of all documents comes once from each slice. A slice has 2**MOST_BITS rows at most, so the packing holds
    at any input. A range is counted at once, about RANGE_BYTES of text; of larger inputs, a task deals its
    windows into narrower ranges and sorts those. The places of repeated windows go back to their slices,
    which turn them into spans.

    The range comes from one Rabin-Karp hash and the 7 bytes (8 beyond 2**MOST_BITS ranges) from another with
    its own base, so windows are compared by 56 bits and those of the range, whose number follows the input:
    two different windows are taken for equal with a chance of about 1e-11 each. Input rows must come in the
    same order when a task is run again, as they do from files.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.xxhash64(F.col(id_col), F.col(id_col).isNull()).alias("kh"),
        text_hash(F.col(text_col)).alias("th"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"),
    )
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    bits, sub_bits, width = layout(size)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, bytes]]]:
        held, n = [], 0
        for b in batches:
            for kh, th, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                text = t.as_py()
                if held and n + len(text) > SLICE:
                    yield held
                    held, n = [], 0
                held.append((kh, th, text))
                n += len(text) + 1
        if held:
            yield held

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, docs_held in enumerate(slices(batches)):
            words, starts = word_hashes(b" ".join(t for _, _, t in docs_held))
            begins = np.cumsum([0] + [len(t) + 1 for _, _, t in docs_held])
            counts = np.diff(np.searchsorted(starts, begins))
            hashes = window_hashes(words, window)
            last = np.repeat(np.cumsum(counts), counts)[: len(hashes)]
            places = np.flatnonzero(np.arange(len(hashes)) + window <= last)
            hashes, others = hashes[places], window_hashes(words, window, OTHER_BASE)[places]
            order = np.argsort(hashes, kind="stable")
            ranked = hashes[order]
            new = np.ones(len(ranked), bool)
            new[1:] = ranked[1:] != ranked[:-1]
            twice = np.zeros(len(ranked), bool)
            twice[1:] = ~new[1:]
            twice[:-1] |= ~new[1:]
            local = np.sort(places[order[twice]])
            names = [np.array(c, np.int64).view(np.uint8) for c in (*zip(*[(kh, th) for kh, th, _ in docs_held]), counts)]
            kh, th, lengths = (binary(x, np.array([len(x)])) for x in names)
            at = binary(*pack(local, np.array([len(local)]))) if len(local) else pa.array([b""], BIN)
            yield packed_rows(1, range=k * 31 % 2**bits, part=part, slice=k, at=at, id_hashes=kh, text_hashes=th, lengths=lengths)
            first = np.sort(order[new])
            kind = (hashes[first] >> np.uint64(64 - bits)).astype(np.int64)
            by = np.argsort(kind, kind="stable")
            kind, first = kind[by], first[by]
            ends = np.flatnonzero(np.diff(kind, append=-1)) + 1
            if len(ends):
                tails = others[first].view(np.uint8).reshape(-1, 8)[:, :width].ravel()
                yield packed_rows(len(ends), range=kind[ends - 1], part=part, slice=k, at=binary(*pack(places[first], ends)), hashes=binary(tails, ends * width))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows of a task's ranges, dealt into narrower ones by bits of the other hash."""
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            row, values, origins = unpacked(rows, width)
            wanted = rows.column("range").to_numpy()[row]
            sub = (values >> np.uint64(8 * width - sub_bits)).astype(np.int64)
            by = np.lexsort((sub, wanted))
            wanted, sub = wanted[by], sub[by]
            ends = np.flatnonzero((np.diff(wanted, append=-1) != 0) | (np.diff(sub, append=-1) != 0)) + 1
            tails = values[by].view(np.uint8).reshape(-1, 8)[:, :width].ravel()
            yield packed_rows(len(ends), range=wanted[ends - 1], sub=sub[ends - 1], hashes=binary(tails, ends * width), origins=binary(origins[by].view(np.uint8).ravel(), ends * 12))

        for b in batches:
            plain = b.column("hashes").is_null()
            yield b.filter(plain)
            b = b.filter(pc.invert(plain))
            for lo, hi in chunks(b, DEAL_BYTES):
                held.append(b.slice(lo, hi - lo))
                if sum(x.nbytes for x in held) >= DEAL_BYTES:
                    yield from done()
        if held:
            yield from done()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by range; each range's windows are compared at once."""
        now, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            _, values, origins = unpacked(rows, width)
            ranked = np.sort(values)
            again = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
            if not len(again):
                return
            origins = origins[again[np.minimum(np.searchsorted(again, values), len(again) - 1)] == values].astype(np.int64)
            if sub_bits:
                origins = origins[np.lexsort((origins[:, 2], origins[:, 1], origins[:, 0]))]
            ends = np.flatnonzero(np.diff(origins[:, :2], axis=0, append=-1).any(1)) + 1
            yield packed_rows(len(ends), part=origins[ends - 1, 0], slice=origins[ends - 1, 1], at=binary(*pack(origins[:, 2].copy(), ends)))

        for b in batches:
            plain = b.column("hashes").is_null()
            yield b.filter(plain)
            b = b.filter(pc.invert(plain))
            key = np.stack([b.column("range").to_numpy(), b.column("sub").fill_null(0).to_numpy()], 1)
            edges = np.flatnonzero(np.diff(key, axis=0).any(1)) + 1
            for lo, hi in zip([0, *edges], [*edges, b.num_rows]):
                if hi > lo:
                    if now != tuple(key[lo]):
                        yield from done()
                        now = tuple(key[lo])
                    held.append(b.slice(lo, hi - lo))
        yield from done()

    def placed(t: pa.Table) -> pa.Table:
        """The places of one slice as spans of its documents."""
        rows = t.to_pylist()
        base = next(r for r in rows if r["lengths"] is not None)
        counts, kh, th = (np.frombuffer(base[c], np.int64) for c in ("lengths", "id_hashes", "text_hashes"))
        raw = [np.frombuffer(r["at"], np.uint8) for r in rows]
        at = np.unique(np.concatenate([unpack(x, np.zeros(1, np.int64), np.array([(x < 255).sum()])) for x in raw]))
        steps = np.zeros(int(counts.sum()) + 1, np.int32)
        steps[at] += 1
        steps[at + window] -= 1
        mask = np.cumsum(steps)[:-1] > 0
        out, lo = [], 0
        for i, n in enumerate(counts.tolist()):
            if mask[lo : lo + n].any():
                start, end = runs(mask[lo : lo + n])
                out.append((int(kh[i]), int(th[i]), [list(x) for x in zip(start.tolist(), end.tolist())]))
            lo += n
        return pa.table([pa.array([x[k] for x in out], kind) for k, kind in enumerate((INT, INT, pa.list_(pa.list_(pa.int32()))))], names=["kh", "th", "spans"])

    packed = rows.mapInArrow(hashed, PACKED).repartitionById(2**bits, F.col("range").cast("int"))
    packed = packed.mapInArrow(dealt, PACKED).sortWithinPartitions("range", "sub") if sub_bits else packed.sortWithinPartitions("range")
    found = packed.mapInArrow(counted, PACKED)
    spans = found.groupBy("part", "slice").applyInArrow(placed, "kh long, th long, spans array<array<int>>")
    return spans.dropDuplicates(["kh", "th"])


def without_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's words without those in a window that also starts anywhere else, in this or another text.

    Windows are judged on the input: of copies, none keeps the repeated words. Returns per row: id, n_words,
    n_removed, kept (the other words joined by one space). Null, empty and blank texts have no words. A text
    of fewer words than a window loses none. Rows repeated with the same id repeat each other's windows.
    """
    spans = repeated_spans(docs, window, id_col, text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.col(id_col), F.col(id_col).isNull()).alias("kh"),
        text_hash(F.col(text_col)).alias("th"),
        F.col(text_col).cast("binary").alias("text"),
    )
    rows = rows.join(spans, ["kh", "th"], "left").select("id", "text", "spans")
    schema = T.StructType([rows.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for t, spans in zip(b.column(1), b.column(2).to_pylist()):
                words = (t.as_py() or b"").split()
                n_words.append(len(words))
                for lo, hi in reversed(spans or ()):
                    del words[lo:hi]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, INT), pa.array(n_removed, INT), pa.array(kept, BIN).cast(pa.string())], names=schema.names)

    return rows.mapInArrow(task, schema)
