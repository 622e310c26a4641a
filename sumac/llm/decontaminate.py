"""Benchmark decontamination with a generalised suffix automaton of the test items."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, ship, text_hash

WINDOW = 10
#: Item words in one automaton (about 100 MB in a task). More items are dealt into several automata, and the
#: documents pass by each, so the bound costs passes and never drops an item.
ITEM_WORDS = 200_000

ship(__name__)

#: A-Z to a-z; every other ASCII character that is not a letter or digit to a space. Bytes from 0x80 stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normalise(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


class Automaton:
    """Suffix automaton of many word sequences; tells which windows of them end at each word of a stream."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        coded = [(k, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for k, ws in items if ws]
        self.shortest = min((min(window, len(ws)) for _, ws in coded), default=window)
        for _, ws in coded:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        #: by state: the items with this state's suffix of window words; short items that are a suffix of it
        self.of_window: dict[int, set] = {}
        self.of_short: dict[int, list[tuple[int, str | None]]] = {}
        short: dict[int, list[tuple[int, str | None]]] = {}
        for k, ws in coded:
            state = 0
            for i, w in enumerate(ws):
                state = self.next[state][w]
                if i + 1 >= window:
                    self.of_window.setdefault(self.suffix_state(state), set()).add(k)
            if len(ws) < window:
                short.setdefault(state, []).append((len(ws), k))
        for state in sorted(range(len(self.link)), key=self.length.__getitem__) if short else ():
            if found := short.get(state, []) + self.of_short.get(self.link[state], []):
                self.of_short[state] = found

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        twin = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = twin
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def suffix_state(self, state: int) -> int:
        """The state of the last window words of what leads to the state."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def hits(self, words: list[bytes]) -> tuple[np.ndarray | None, set]:
        """Which words lie in an occurrence of a window, or None; and the items with occurring windows."""
        mask, items = None, set()
        known = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        # No match is longer than the run of known words that it lies in.
        edge = np.flatnonzero(np.diff(np.concatenate(([0], known >= 0, [0]))))
        for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if hi - lo < self.shortest:
                continue
            state = size = 0
            for i, w in enumerate(known[lo:hi].tolist(), lo):
                while state and w not in self.next[state]:
                    state = self.link[state]
                    size = self.length[state]
                if w in self.next[state]:
                    state = self.next[state][w]
                    size += 1
                if size < self.shortest:
                    continue
                longest = 0
                if size >= self.window:
                    longest = self.window
                    items |= self.of_window[self.suffix_state(state)]
                for n, k in self.of_short.get(state, ()):
                    if n <= size:
                        longest = max(longest, n)
                        items.add(k)
                if longest:
                    mask = np.zeros(len(words), bool) if mask is None else mask
                    mask[i - longest + 1 : i + 1] = True
        return mask, items


def item_shards(items: DataFrame, item_words: int = ITEM_WORDS, item_id_col: str = "item_id", item_text_col: str = "text") -> list[Broadcast]:
    """The items (id as a string or None, text), dealt into as many broadcasts as keep each at about
    item_words words."""
    tests = cut(items.select(F.col(item_id_col).cast("string").alias("k"), F.col(item_text_col).cast("binary").alias("t")))
    size = tests.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    passes = max(1, -(-size // (2 * item_words)))  # a word has a character and a space at least
    parts = (tests.where(F.pmod(F.xxhash64("k", "t"), F.lit(passes)) == k).collect() for k in range(passes))
    return [items.sparkSession.sparkContext.broadcast([(r["k"], bytes(r["t"] or b"")) for r in part]) for part in parts]


def union(spans: Column) -> Column:
    """Spans in order of their start as disjoint ones: each widens the last or starts anew."""
    joined = lambda acc, x: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.array(F.element_at(acc, -1)[0], F.greatest(F.element_at(acc, -1)[1], x[1]))))
    return F.aggregate(
        F.array_sort(spans),
        F.expr("cast(array() as array<array<int>>)"),
        lambda acc, x: F.when(F.size(acc) == 0, F.array(x)).when(F.element_at(acc, -1)[1] >= x[0], joined(acc, x)).otherwise(F.concat(acc, F.array(x))),
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, item_words: int = ITEM_WORDS, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Where the test items occur in every document.

    Returns per row: id, th (hash of the text), n_words, spans (array of [start, end) word positions that
    lie in a window of window item words, or in a whole item that is shorter), items (ids as strings, sorted).

    Null and blank texts have no words; items without words are skipped; items with a null id mark words
    but are not listed. Rows of equal id and text are equal in the result.
    """
    shards = item_shards(items, item_words, item_id_col, item_text_col)
    rows = docs.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("th"), F.col(text_col).cast("binary").alias("text"))
    schema = rows.drop("text").schema.add("n_words", "long").add("spans", T.ArrayType(T.ArrayType(T.IntegerType()))).add("items", T.ArrayType(T.StringType()))

    def one_pass(shared: Broadcast) -> DataFrame:

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = Automaton([(k, normalise(t)) for k, t in shared.value], window)
            for b in batches:
                n_words, spans, found = [], [], []
                for t in b.column(2):
                    words = normalise(t.as_py())
                    mask, ids = automaton.hits(words)
                    edge = [] if mask is None else np.flatnonzero(np.diff(np.concatenate(([0], mask, [0])))).tolist()
                    n_words.append(len(words))
                    spans.append([list(x) for x in zip(edge[::2], edge[1::2])])
                    found.append(sorted(k for k in ids if k is not None))
                columns = [b.column(0), b.column(1), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(found, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "th", "n_words", "spans", "items"])

        return rows.mapInArrow(task, schema)

    if len(shards) == 1:
        return one_pass(shards[0])
    return _merge([one_pass(x) for x in shards])


def _merge(parts: list[DataFrame]) -> DataFrame:
    """Joins what several automata found. Rows of equal id and text are equal in each part, so they are
    counted once and dealt out again."""
    first, *rest = parts
    every = first.select("id", "th", "n_words", "spans", "items", F.lit(1).alias("copies"))
    for p in rest:
        every = every.unionByName(p.select("id", "th", "n_words", "spans", "items", F.lit(0).alias("copies")))
    both = every.groupBy("id", "th").agg(F.max("n_words").alias("n_words"), F.collect_set("spans").alias("s"), F.flatten(F.collect_set("items")).alias("i"), F.sum("copies").alias("copies"))
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return both.select("id", "th", "n_words", union(F.flatten("s")).alias("spans"), F.array_sort(F.array_distinct("i")).alias("items"), copies.alias("__c")).drop("__c")


def hit_words(spans: str = "spans") -> Column:
    """Number of words that the spans cover."""
    return F.aggregate(F.col(spans), F.lit(0).cast("long"), lambda acc, x: acc + x[1] - x[0])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = 0.0, item_words: int = ITEM_WORDS, text_col: str = "text") -> DataFrame:
    """docs, all columns, without contamination: a document with more than max_coverage of its words in
    windows goes; of any other the contaminated words are cut out of the text, and the rest is joined by
    one space, normalised as matched. Documents without a hit stay as they are, null texts among them.

    With max_coverage 0 every hit document goes, and no text changes. Each automaton looks at a text in
    place, so nothing is shuffled.
    """
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])  # own names of docs may clash
    text = f"c{names.index(text_col)}"

    def spans_in(shared: Broadcast) -> Column:
        @F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
        def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            automaton = Automaton([(k, normalise(t)) for k, t in shared.value], window)

            def one(t: bytes | None) -> list[list[int]]:
                mask, _ = automaton.hits(normalise(t))
                edge = [] if mask is None else np.flatnonzero(np.diff(np.concatenate(([0], mask, [0])))).tolist()
                return [list(x) for x in zip(edge[::2], edge[1::2])]

            for s in batches:
                yield pd.Series([one(t) for t in s], dtype=object)

        return find(F.col(text).cast("binary"))

    shards = item_shards(items, item_words)
    if max_coverage <= 0:
        for x in shards:
            rows = rows.where(F.size(spans_in(x)) == 0)
        return rows.toDF(*names)

    @F.pandas_udf("string")
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(t: str | None, s) -> str | None:
            if t is None or not len(s):
                return t
            words = normalise(t.encode())
            if sum(hi - lo for lo, hi in s) > max_coverage * len(words):
                return None
            for lo, hi in reversed([list(x) for x in s]):
                del words[lo:hi]
            return b" ".join(words).decode()

        return pd.Series([one(t, s) for t, s in zip(texts, spans)], dtype=object)

    rows = rows.withColumns({f"s{i}": spans_in(x) for i, x in enumerate(shards)})
    rows = rows.withColumn("spans", union(F.flatten(F.array(*[f"s{i}" for i in range(len(shards))]))))
    rows = rows.withColumn("left", without(F.col(text), F.col("spans"))).where((F.size("spans") == 0) | F.col("left").isNotNull())
    return rows.select(*[F.col("left" if c == text else c).alias(n) for c, n in zip((f"c{i}" for i in range(len(names))), names)])
