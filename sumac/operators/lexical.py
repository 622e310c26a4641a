"""BM25 over ranges of units: inverted lists that never leave their range, and top-k with bounds that spare most of the scoring."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.shared import bucketed, cut, ship, stored
from .retrieval import tokenize

#: Units of a range, about. A task holds the asked lists of one range.
RANGE = 2048
#: Tokens that a task counts at once, about, or those of one longer text.
TOKENS = 250_000
#: Terms of queries that are sent to every task at once; more queries are asked a block at a time.
BLOCK = 50_000
#: Bounds are widened by it: scores are rounded to nine places, and sums in another order differ by less.
SLACK = 1e-7

ship(__name__)


class Index(NamedTuple):
    """lists: range, term, n, most (largest tf), least (shortest length), gaps, tfs; bucketed by range and sorted by term. gaps are the steps from each
    unit of the list to the next, units being numbered in their range. df: term, n, idf. dl: range, at (number in the range), unit, len. mean: of len.
    lowest: of idf."""

    lists: DataFrame
    df: DataFrame
    dl: DataFrame
    mean: float
    lowest: float


def bm25_index(units: DataFrame, id_col: str, text_col: str, metadata: list[str] | None = None) -> Index:
    """An index of the units' tokens; those of the metadata columns count twice. A negative idf becomes a quarter of the mean idf. Rows of one unit are one.

    A task counts the tokens of its units; these counts meet once, by range, where they are turned into lists. Ranges are by hash of the unit, so they are
    alike in size. Nothing is shuffled by term but a count for each term and range.
    """
    tokens = tokenize(F.col(text_col))
    for c in metadata or []:
        tokens = F.concat(tokens, F.flatten(F.array_repeat(tokenize(F.col(c)), 2)))
    n_ranges = max(1, ceil(units.count() / RANGE))
    unit = F.col(id_col)
    rows = units.select(F.pmod(F.xxhash64(unit), F.lit(n_ranges)).cast("int").alias("range"), unit.alias("unit"), tokens.alias("tokens"))
    kind = rows.schema["unit"].dataType
    arrow = to_arrow_type(kind)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            lengths = whole.column(2).value_lengths().fill_null(0).to_numpy().astype(np.int64)
            piece = (np.cumsum(lengths) - lengths) // TOKENS  # rows of about so many tokens
            for start, stop in zip(edges := np.flatnonzero(np.diff(piece, prepend=-1)), [*edges[1:], len(lengths)]):
                b = whole.slice(start, stop - start)
                tokens = b.column(2)
                coded = tokens.flatten().dictionary_encode()
                size = max(1, len(coded.dictionary))
                row = np.repeat(np.arange(len(tokens)), lengths[start:stop])
                key, n = np.unique(row * size + coded.indices.to_numpy(), return_counts=True)
                ends = pa.array(np.searchsorted(key // size, np.arange(len(tokens) + 1)), pa.int32())
                terms = pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(key % size)).cast(pa.string()))
                tfs = pa.ListArray.from_arrays(ends, pa.array(n, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), terms, tfs], names=["range", "unit", "terms", "tfs"])

    def invert(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        names = sorted(set(own := t.column("unit").to_pylist()), key=lambda u: (u is not None, u))
        number = {u: i for i, u in enumerate(names)}
        terms = t.column("terms").combine_chunks()
        at = np.repeat(np.array([number[u] for u in own], np.int64), terms.value_lengths().to_numpy())
        tf = t.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
        lens = np.bincount(at, tf, len(names)).astype(np.int64)
        coded = terms.flatten().dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        key = rank[coded.indices.to_numpy()] * len(names) + at
        key, same = np.unique(key, return_inverse=True)  # rows of one unit are one
        tf = np.bincount(same, tf, len(key)).astype(np.int32)
        term, at = np.divmod(key, len(names))
        start = np.flatnonzero(np.diff(term, prepend=-1))
        gaps = np.diff(at, prepend=0)
        gaps[start] = at[start]
        n = len(start)
        ends = np.append(start, len(key))
        head = lambda first, rest, kind: pa.concat_arrays([pa.array([first], kind), pa.array(rest, kind)])
        some = lambda v: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32()))
        columns = [
            pa.array(np.full(n + 1, t.column("range")[0].as_py()), pa.int32()),
            pa.concat_arrays([pa.array([None], pa.string()), coded.dictionary.take(pa.array(order)).cast(pa.string())]),
            head(len(names), np.diff(ends), pa.int64()),
            head(None, np.maximum.reduceat(tf, start) if n else [], pa.int32()),
            head(None, np.minimum.reduceat(lens[at], start) if n else [], pa.int64()),
            pa.concat_arrays([pa.array([lens.tolist()], pa.list_(pa.int32())), some(gaps).cast(pa.list_(pa.int32()))]),
            pa.concat_arrays([pa.array([None], pa.list_(pa.int32())), some(tf).cast(pa.list_(pa.int32()))]),
            pa.array([names, *[None] * n], pa.list_(arrow)),
        ]
        return pa.Table.from_arrays(columns, names=["range", "term", "n", "most", "least", "gaps", "tfs", "units"])

    counted = rows.mapInArrow(count, T.StructType([T.StructField("range", T.IntegerType()), T.StructField("unit", kind), T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))]))
    schema = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("term", T.StringType()), T.StructField("n", T.LongType()), T.StructField("most", T.IntegerType()), T.StructField("least", T.LongType()), T.StructField("gaps", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType())), T.StructField("units", T.ArrayType(kind))])
    name = bucketed(counted.groupBy("range").applyInArrow(invert, schema), "range", "term")
    # the row without a term holds a range's units and their lengths
    table = units.sparkSession.table
    dl = table(name).where("term IS NULL").select(F.col("range").alias("range"), F.posexplode(F.arrays_zip("units", "gaps")).alias("at", "x")).select("range", "at", F.col("x.units").alias("unit"), F.col("x.gaps").cast("long").alias("len"))
    lists = table(name).where("term IS NOT NULL").drop("units")
    size = dl.agg(F.count("*").alias("n"), F.avg("len").alias("mean")).first()
    raw = F.log(F.lit(size["n"]) - F.col("n") + 0.5) - F.log(F.col("n") + 0.5)
    df = stored(lists.groupBy("term").agg(F.sum("n").alias("n")).withColumn("raw", raw))
    raws = df.agg(F.avg("raw").alias("mean"), F.min("raw").alias("least")).first()
    idf = F.when(F.col("raw") < 0, 0.25 * F.lit(raws["mean"])).otherwise(F.col("raw"))
    lowest = min(raws["least"] or 0.0, 0.0) and min(0.0, raws["mean"])
    return Index(lists, df.select("term", "n", idf.alias("idf")), dl, size["mean"] or 0.0, lowest)


class Lists:
    """The lists of one range that some queries ask for: places, and what each adds to a score when the term is asked once."""

    def __init__(self, rows: pa.Table, lens: np.ndarray, idf: dict[str, float], k1: float, b: float, mean: float):
        norm = k1 * (1 - b + b * lens / (mean or 1.0))
        self.size, self.lists = len(lens), {}
        for term, gaps, tfs in zip(rows.column("term").to_pylist(), rows.column("gaps"), rows.column("tfs")):
            at, tf = np.cumsum(gaps.values.to_numpy()), tfs.values.to_numpy()
            adds = idf[term] * tf * (k1 + 1) / (tf + norm[at])
            self.lists[term] = (at, adds, max(0.0, float(adds.max())))

    def best(self, asked: list[tuple[str, int]], k: int, least: float, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and scores of all units that may be among the k best with at least `least`, and how many postings were scored.

        Lists come in falling order of the most they can add. A unit whose score so far and all that the lists to come can add do not reach the
        k-th best so far (or `least`) is given up, and its postings in the lists to come are passed over.
        """
        terms = sorted(((times * self.lists[t][2], times, t) for t, times in asked if t in self.lists), reverse=True)
        rest = np.append(np.cumsum([x[0] for x in terms][::-1])[::-1], 0.0)
        score, met, alive, scored = np.zeros(self.size), np.zeros(self.size, bool), allowed.copy(), 0
        for i, (_, times, term) in enumerate(terms):
            if rest[i] < least - SLACK and not met.any():
                break  # nothing here reaches what is asked for
            at, adds, _ = self.lists[term]
            on = alive[at]
            at = at[on]
            score[at] += times * adds[on]
            met[at] = True
            scored += len(at)
            some = score[met]
            if len(some) >= k:
                least = max(least, float(np.partition(some, len(some) - k)[len(some) - k]) - max(0.0, self.loss(terms[i + 1 :])))
            alive &= score + rest[i + 1] >= least - SLACK
        at = np.flatnonzero(met & alive)
        return at, score[at], scored

    def loss(self, terms: list[tuple[float, int, str]]) -> float:
        """The most that lists to come can take from a score: terms with a negative idf."""
        return sum(-times * min(0.0, float(self.lists[t][1].min())) for bound, times, t in terms if bound <= 0)


def first_k(at: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, float]]:
    """The k best of a range: rounded scores, ties to the lesser place, which is the lesser unit."""
    scores = np.round(scores, 9)
    order = np.lexsort((at, -scores))[:k]
    return list(zip(at[order].tolist(), scores[order].tolist()))


def bm25_found(index: Index, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, units: DataFrame | None = None) -> DataFrame:
    """query_id, unit, score, scored: of each query and range the k best units with a common term. scored, on a range's first row for a query, is how many
    postings were scored there. The lists are not exchanged: each range is asked by all queries of a block where it lies.

    A query first asks the range whose largest tf and shortest length promise most; its k-th score there is what units elsewhere have to reach.
    """
    spark = queries.sparkSession
    terms = queries.select("query_id", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    asked = cut(terms.join(index.df, "term").select("query_id", "term", "times", "idf"))
    n = asked.count()
    kinds = {"q": asked.schema["query_id"].dataType, "u": index.dl.schema["unit"].dataType}
    schema = T.StructType([T.StructField("query_id", kinds["q"]), T.StructField("unit", kinds["u"]), T.StructField("score", T.DoubleType()), T.StructField("scored", T.LongType())])
    arrow_q, arrow_u = to_arrow_type(kinds["q"]), to_arrow_type(kinds["u"])
    allowed = index.dl if units is None else index.dl.join(units.select("unit").distinct().withColumn("ok", F.lit(True)), "unit", "left")
    mean = index.mean
    parts = []
    for block in range(max(1, ceil(n / BLOCK))):
        mine = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(max(1, ceil(n / BLOCK)))) == block)
        rows = mine.collect()  # about BLOCK short rows
        by_query: dict = {}
        for r in rows:
            by_query.setdefault(r["query_id"], []).append((r["term"], r["times"]))
        idf = {r["term"]: r["idf"] for r in rows}
        lists = index.lists.join(F.broadcast(mine.select("term").distinct()), "term", "left_semi")
        bound = F.col("times") * F.greatest(F.lit(0.0), F.col("idf") * F.col("most") * (k1 + 1) / (F.col("most") + k1 * (1 - b + b * F.col("least") / F.lit(mean or 1.0))))
        promise = index.lists.select("range", "term", "most", "least").join(F.broadcast(mine), "term").groupBy("query_id", "range").agg(F.sum(bound).alias("bound"))
        best = promise.groupBy("query_id").agg(F.max_by("range", F.struct("bound", "range")).alias("range")).collect()  # a row a query
        home = {r["query_id"]: r["range"] for r in best}

        def ask(queries_of, least: dict):
            def task(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
                out: list[tuple] = []
                mine = queries_of(key[0].as_py())
                if left.num_rows and right.num_rows and mine:
                    at = right.column("at").to_numpy()
                    order = np.argsort(at)
                    names = right.column("unit").to_pylist()
                    lens = right.column("len").to_numpy()[order]
                    ok = np.array(right.column("ok").to_pylist(), object)[order] == True if "ok" in right.column_names else np.ones(len(at), bool)  # noqa: E712
                    lists = Lists(left, lens, idf, k1, b, mean)
                    for q in mine:
                        places, scores, scored = lists.best(by_query[q], k, least.get(q, -np.inf), ok)
                        got = first_k(places, scores, k) or [(None, None)]
                        out += [(q, None if i is None else names[order[i]], s, scored if j == 0 else 0) for j, (i, s) in enumerate(got)]
                q, u, s, c = zip(*out) if out else [()] * 4
                return pa.Table.from_arrays([pa.array(q, arrow_q), pa.array(u, arrow_u), pa.array(s, pa.float64()), pa.array(c, pa.int64())], names=["query_id", "unit", "score", "scored"])

            return lists.groupBy("range").cogroup(allowed.groupBy("range")).applyInArrow(task, schema)

        first = cut(ask(lambda r: [q for q in by_query if home.get(q) == r], {}))
        kth = first.where("unit IS NOT NULL OR score IS NOT NULL").groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
        least = {r["query_id"]: r["least"] for r in kth.collect()}  # a row a query
        parts += [first, ask(lambda r: [q for q in by_query if home.get(q) != r], least)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found if n else spark.createDataFrame([], schema)


def bm25_top(index: Index, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, units: DataFrame | None = None) -> DataFrame:
    """query_id, unit, score, rank: the k best units of each query. queries: query_id, text.

    Repeated terms of a query count again. Scores are rounded to nine places before they are ranked, so sums in
    another order rank alike; ties go to the lesser unit. Units without a common term score 0 and fill up the k.
    units: the only ones to rank (a filter before the cut).
    """
    found = cut(bm25_found(index, queries, k, k1, b, units).where("score IS NOT NULL").select("query_id", "unit", "score"))  # k a query and range
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "unit")
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")
    # every query's k least units stand in with 0: no more than k of them can be needed beside the scored ones
    dl = index.dl if units is None else index.dl.join(units, "unit", "left_semi")
    spare = cut(dl.select("unit").orderBy("unit").limit(k))
    zero = queries.select("query_id").distinct().crossJoin(F.broadcast(spare))  # k rows
    # a spare unit with a common term is no zero. Where no score is negative, one that was not found stands behind k others even so
    scored = spare_hits(index, queries, spare) if index.lowest < 0 else found.select("query_id", "unit")
    zero = zero.join(scored, ["query_id", "unit"], "left_anti").select("query_id", "unit", F.lit(0.0).alias("score"))
    return best.unionByName(zero).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def spare_hits(index: Index, queries: DataFrame, spare: DataFrame) -> DataFrame:
    """query_id, unit: which of a few units have a term of a query. Only the ranges of those units are read."""
    where = cut(index.dl.join(F.broadcast(spare), "unit", "left_semi").select("range", "at", "unit"))
    ranges = [r["range"] for r in where.select("range").distinct().collect()]  # k at most
    terms = cut(queries.select("query_id", F.explode(tokenize(F.col("text"))).alias("term")).distinct())
    near = index.lists.where(F.col("range").isin(ranges)).select("range", "term", "gaps").join(terms.select("term").distinct(), "term", "left_semi")
    places = F.aggregate("gaps", F.struct(F.lit(0).alias("now"), F.lit(False).alias("hit")), lambda a, g: F.struct((a["now"] + g).alias("now"), (a["hit"] | (a["now"] + g == F.col("at"))).alias("hit")))
    return near.join(F.broadcast(where), "range").where(places["hit"]).select("term", "unit").join(terms, "term").select("query_id", "unit").distinct()
