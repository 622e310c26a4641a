"""Exact top-k inner products by best-first search of M-trees: pages of nodes with covering radii and parent distances."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, ship
from .vectors import integer_vectors, matrix

SCALE = 256
#: Distinct vectors of a tree, about: a cell with more is dealt into several by hash.
TREE = 4096
#: Entries of a leaf page, and of an inner one.
LEAF, FAN = 256, 16
#: Cells into which all vectors are dealt, by the nearest of as many sampled ones: what the driver sends of cells is bounded by it.
CELLS = 4096
#: Queries that one task asks one tree at once.
BLOCK = 8192
#: Parts over which the copies of a vector, and the queries that ask for one vector, are dealt.
SALTS = 16

#: Distances may be off by this share of the largest norm (float64 rounding, a thousandfold); bounds are widened by it, so none excludes too much.
SLACK = 1e-6

ship(__name__)

PAGE = "tree long, page int, leaf boolean, vectors binary, parent binary, radius binary, child binary, ids array<array<long>>"


class Space:
    """Inner products as distances: a vector x gets one more component, lift = sqrt(limit - x.x), and a query 0. Then d(q, x)**2 = q.q + limit - 2 q.x, so
    the nearest vectors have the largest inner products, and d is a metric. limit: the largest x.x."""

    def __init__(self, limit: float):
        self.limit, self.slack = limit, SLACK * max(limit, 1.0) ** 0.5

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.limit - (x * x).sum(1), 0))

    def between(self, x: np.ndarray, lift: np.ndarray, p: np.ndarray, p_lift: float) -> np.ndarray:
        """Distances of lifted vectors from one of them."""
        return np.sqrt(((x - p) ** 2).sum(1) + (lift - p_lift) ** 2)

    def nearest(self, x: np.ndarray, lift: np.ndarray, p: np.ndarray, p_lift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest of the vectors p of each x, and its distance."""
        square = 2 * (self.limit - x @ p.T - lift[:, None] * p_lift[None, :])
        k = square.argmin(1)
        return k, np.sqrt(((x - p[k]) ** 2).sum(1) + (lift - p_lift[k]) ** 2)


def products(x: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of integer rows with one vector; in float64 while that is exact, else in whole numbers of any size."""
    return x @ q if exact else (x.astype(object) @ q.astype(object))


def build(x: np.ndarray, space: Space) -> Iterator[dict]:
    """Pages of the tree over distinct vectors, the root as page 0. An inner page's entries are vectors (rows of x) with the radius that covers all below
    them and their distance from the vector above; a leaf's are the vectors themselves with that distance."""
    lift = space.lift(x)
    waiting: list[tuple[int, np.ndarray, int]] = [(0, np.arange(len(x)), -1)]
    pages = 1
    while waiting:
        page, rows, above = waiting.pop()
        parent = lambda r, above=above: space.between(x[r], lift[r], x[above], lift[above]) if above >= 0 else np.zeros(len(r))
        if len(rows) <= LEAF:
            yield {"page": page, "leaf": True, "rows": rows, "parent": parent(rows), "radius": np.zeros(0), "child": np.zeros(0, np.int32)}
            continue
        chosen = rows[np.linspace(0, len(rows) - 1, min(FAN, ceil(len(rows) / LEAF) + 1)).astype(int)]
        near, far = space.nearest(x[rows], lift[rows], x[chosen], lift[chosen])
        if len(np.unique(near)) < 2:  # nothing tells them apart: halve them
            near = (np.arange(len(rows)) * len(chosen)) // len(rows)
            far = np.sqrt(((x[rows] - x[chosen[near]]) ** 2).sum(1) + (lift[rows] - lift[chosen[near]]) ** 2)
        used = np.unique(near)
        child = np.arange(pages, pages + len(used), dtype=np.int32)
        pages += len(used)
        radius = np.array([far[near == k].max() for k in used])
        waiting += [(int(c), rows[near == k], int(chosen[k])) for c, k in zip(child, used)]
        yield {"page": page, "leaf": False, "rows": chosen[used], "parent": parent(chosen[used]), "radius": radius, "child": child}


class Tree:
    """Pages of one tree as read, and the search in them."""

    def __init__(self, pages: pa.Table, n: int, space: Space, exact: bool):
        self.space, self.exact, self.pages = space, exact, {}
        floats = lambda b, kind=np.float64: np.frombuffer(b, kind)
        for r in pages.to_pylist():
            vectors = floats(r["vectors"], np.int64).reshape(-1, n)
            self.pages[r["page"]] = (r["leaf"], vectors.astype(np.float64) if exact else vectors, floats(r["parent"]), floats(r["radius"]), floats(r["child"], np.int32).tolist(), r["ids"])

    def best(self, q: np.ndarray, k: int, least: int | None, own: bool = False) -> tuple[list[tuple], int]:
        """The k entries (-score, id is null, id, own) with the largest scores, ties to the lesser id; none below least. Also how many distances were computed.

        Pages are visited in the order of the least distance that any vector below can have. An entry is passed over, without its
        distance, if the distance of its page's vector and the stored one say that it lies too far."""
        space = self.space
        qq = float((q.astype(np.float64) ** 2).sum())
        q = q.astype(np.float64 if self.exact else np.int64)
        reach = lambda s: np.sqrt(max(qq + space.limit - 2 * float(s), 0.0)) + space.slack
        found: list[tuple] = []  # a heap, the worst entry first
        far = np.inf if least is None else reach(least)
        heap: list[tuple[float, int, float]] = [(0.0, 0, -1.0)]
        computed = 0
        while heap:
            near, page, above = heapq.heappop(heap)
            if near > far:
                break
            leaf, vectors, parent, radius, child, ids = self.pages[page]
            if above >= 0:
                away = np.abs(parent - above)
                at = np.flatnonzero((away if leaf else away - radius) <= far + space.slack)
                vectors = vectors[at]
            else:
                at = np.arange(len(vectors))
            if not len(at):
                continue
            computed += len(at)
            scores = products(vectors, q, self.exact)
            if not leaf:
                d = np.sqrt(np.maximum(qq + space.limit - 2 * scores.astype(np.float64), 0))
                low = d - radius[at] - space.slack
                for i in np.flatnonzero(low <= far).tolist():
                    heapq.heappush(heap, (max(low[i], near), child[at[i]], d[i]))
                continue
            worst = least if len(found) < k else -found[0][0].order[0]
            some = np.flatnonzero(scores >= worst) if worst is not None else np.arange(len(scores))
            for i in some.tolist():
                s = int(scores[i])
                same = own and bool((vectors[i] == q).all())
                for ident in ids[at[i]]:
                    entry = Worst((-s, ident is None, ident or 0, same))
                    if len(found) < k:
                        heapq.heappush(found, (entry,))
                    elif found[0][0] < entry:
                        heapq.heapreplace(found, (entry,))
                    else:
                        break  # ids rise
            if len(found) == k:
                far = min(far, reach(-found[0][0].order[0]))
        return sorted(e.order for (e,) in found), computed


class Worst:
    """Orders entries so that the worst is least."""

    __slots__ = ("order",)

    def __init__(self, order: tuple):
        self.order = order

    def __lt__(self, other: Worst) -> bool:
        return self.order > other.order


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """x and the k least ids of its copies, null last: no other copy can be among the k best of any query."""
    order = [F.col("id").asc_nulls_last()]
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    few = dealt.withColumn("r", F.row_number().over(Window.partitionBy("x", "salt").orderBy(*order))).where(F.col("r") <= k)
    some = few.groupBy("x").agg(F.array_agg(F.struct(F.col("id").isNull().alias("none"), "id")).alias("ids"))  # SALTS * k at most
    return some.select("x", F.transform(F.slice(F.array_sort("ids"), 1, k), lambda e: e["id"]).alias("ids"))


def cell_of(rows: DataFrame, pivots: np.ndarray, space: Space, n: int) -> DataFrame:
    """Adds cell (the nearest pivot) and far (its distance)."""
    p, p_lift = pivots, space.lift(pivots)
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(names.index("x")), n).astype(np.float64)
            near, far = np.zeros(len(x), np.int32), np.zeros(len(x))
            for s in range(0, len(x), 1024):
                part = slice(s, s + 1024)
                near[part], far[part] = space.nearest(x[part], space.lift(x[part]), p, p_lift)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near), pa.array(far)], names=[*names, "cell", "far"])

    return rows.mapInArrow(task, schema)


def trees(dealt: DataFrame, space: Space, n: int) -> DataFrame:
    """The pages of a tree for each value of tree, from rows (tree, x, ids)."""

    def task(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        whole = matrix(t.column("x").combine_chunks(), n)
        order = np.lexsort(whole.T)  # the same tree, however rows come
        whole, ids, tree = whole[order], t.column("ids").to_pylist(), t.column("tree")[0].as_py()
        rows = []
        for p in build(whole.astype(np.float64), space):
            r = p["rows"]
            own = [ids[order[i]] for i in r] if p["leaf"] else []
            rows.append({"tree": tree, "page": p["page"], "leaf": p["leaf"], "vectors": whole[r].tobytes(), "parent": p["parent"].tobytes(), "radius": p["radius"].tobytes(), "child": p["child"].tobytes(), "ids": own})
        return pa.Table.from_pylist(rows, schema=pages_schema())

    return dealt.groupBy("tree").applyInArrow(task, PAGE)


def pages_schema() -> pa.Schema:
    binary = [(c, pa.binary()) for c in ("vectors", "parent", "radius", "child")]
    return pa.schema([("tree", pa.int64()), ("page", pa.int32()), ("leaf", pa.bool_()), *binary, ("ids", pa.list_(pa.list_(pa.int64())))])


FOUND = "q long, computed long, best array<struct<score:long,id:long,own:boolean>>"


def asker(space: Space, n: int, k: int, exact: bool) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """Searches a tree (pages) for a block of queries (q, x, least, home)."""

    def task(key: tuple, pages: pa.Table, queries: pa.Table) -> pa.Table:
        tree = Tree(pages, n, space, exact) if queries.num_rows else None
        rows = []
        for q, x, least, home in zip(*(queries.column(c).to_pylist() for c in ("q", "x", "least", "home"))):
            best, computed = tree.best(np.array(x, np.int64), k, least, home)
            rows.append({"q": q, "computed": computed, "best": [{"score": -s, "id": None if none else i, "own": own} for s, none, i, own in best]})
        entry = pa.struct([("score", pa.int64()), ("id", pa.int64()), ("own", pa.bool_())])
        return pa.Table.from_pylist(rows, schema=pa.schema([("q", pa.int64()), ("computed", pa.int64()), ("best", pa.list_(entry))]))

    return task


def asked(pages: DataFrame, pairs: DataFrame, n_queries: int, task: Callable) -> DataFrame:
    """The answers of pairs (tree, q, x, least, home): each tree's pages meet its queries a block at a time."""
    blocks = max(1, ceil(n_queries / BLOCK))
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)))
    wanted = pairs.select(F.col("tree").alias("t"), F.col("block").alias("b")).distinct()
    there = pages.join(wanted, F.col("tree") == F.col("t")).withColumn("block", F.col("b"))
    return there.groupBy("tree", "block").cogroup(pairs.groupBy("tree", "block")).applyInArrow(task, FOUND)


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, id, score: for each row for which is_query (of the column id) holds, the k other rows with the largest inner products of the
    whole-number vectors floor(256 * x), ties to the lesser id and null ids last. Also computed: distances that the search of its vector took.

    Exact. A query's own row is left out once: copies of it under the same id, if there are any, are other rows. Rows that share an id are rows of their
    own, as queries too. Which vectors take part is said at integer_vectors; an empty table, or one row, gives no row.

    Copies of a vector become one entry with its k + 1 least ids. Vectors are dealt into cells by their nearest of CELLS sampled ones (a bounded sample;
    every vector is in a cell), cells into trees of bounded size, and each tree's pages are written by one task. A query vector asks the tree that holds it, then, with the
    score that it has to beat, the trees of those cells whose covering radius reaches that far.
    """
    rows, n = integer_vectors(vectors, SCALE, 0, id_col, vector_col)
    rows = rows.select(F.col("id").cast("long").alias("id"), "x")
    empty = rows.sparkSession.createDataFrame([], "query_id long, rank int, id long, score long, computed long")
    if not n:
        return empty
    every = cut(distinct_vectors(rows, k + 1))
    norm = F.aggregate("x", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))
    size = every.agg(F.count("*").alias("n"), F.max(norm).alias("limit")).first()
    space = Space(size["limit"] * (1 + 1e-12))
    exact = size["limit"] < 2.0**50  # |x.y| stays below it, so float64 sums are exact
    sample = every.select("x").orderBy(F.xxhash64("x"), "x").limit(min(CELLS, ceil(size["n"] / TREE))).collect()  # CELLS rows at most
    pivots = np.array([r["x"] for r in sample], np.float64)
    placed = cut(cell_of(every, pivots, space, n))
    cells = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()}  # CELLS rows at most
    deals = {c: ceil(r["n"] / TREE) for c, r in cells.items()}
    n_trees = F.element_at(F.create_map(*[F.lit(v) for c, d in deals.items() for v in (c, d)]), F.col("cell"))
    tree_of = lambda i: F.col("cell").cast("long") * (1 << 32) + i
    home = tree_of(F.pmod(F.xxhash64("x"), n_trees))
    pages = cut(trees(placed.select(home.alias("tree"), "x", "ids"), space, n))

    askers = rows.where(is_query)
    vectors_asked = placed.join(askers.select("x").distinct(), "x", "left_semi")
    queries = cut(vectors_asked.select(F.monotonically_increasing_id().alias("q"), "x", "cell", home.alias("tree")))
    count = queries.count()
    task = asker(space, n, k + 1, exact)
    first = cut(asked(pages, queries.select("tree", "q", "x", F.lit(None).cast("long").alias("least"), F.lit(True).alias("home")), count, task))
    # of a query that has found k + 1, only what scores as much as the last of them can count
    least = F.when(F.size("best") > k, F.element_at("best", -1)["score"])
    more = routed(queries.join(first.select("q", least.alias("least")), "q"), cells, pivots, space, n)
    more = more.withColumn("i", F.explode(F.sequence(F.lit(0), n_trees - 1))).withColumn("to", tree_of(F.col("i"))).where(F.col("to") != F.col("tree"))
    rest = cut(asked(pages, more.select(F.col("to").alias("tree"), "q", "x", "least", F.lit(False).alias("home")), count, task))
    found = first.unionByName(rest)
    spent = found.groupBy("q").agg(F.sum("computed").alias("computed"))
    entries = found.select("q", F.explode("best").alias("e")).select("q", "e.*")
    w = Window.partitionBy("q").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "own")
    best = entries.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    lists = best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "id", "score", "own"))).alias("best"))  # k + 1
    lists = lists.join(spent, "q").join(queries.select("q", "x"), "q").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    askers = askers.withColumn("salt", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    mine = F.transform(F.filter("best", lambda e: e["own"] & (e["id"] == F.col("query_id"))), lambda e: e["r"])
    others = F.slice(F.filter("best", lambda e: e["r"] != F.coalesce(F.get(mine, F.lit(0)), F.lit(0))), 1, k)
    got = askers.withColumnRenamed("id", "query_id").join(lists, ["x", "salt"]).select("query_id", "computed", F.posexplode(others).alias("i", "e"))
    return got.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("e.id").alias("id"), F.col("e.score").alias("score"), "computed")


def routed(queries: DataFrame, cells: dict, pivots: np.ndarray, space: Space, n: int) -> DataFrame:
    """Queries (q, x, tree, least) with each cell whose covering radius lets it hold an entry that scores least or more."""
    names = sorted(cells)
    p = pivots[names]
    radius = np.array([cells[c]["radius"] for c in names])
    labels = np.array(names, np.int32)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), n).astype(np.float64)
            least = np.array([-np.inf if v is None else float(v) for v in b.column(3).to_pylist()])
            qq = (x * x).sum(1)
            for i in range(len(x)):
                d = np.sqrt(np.maximum(qq[i] + space.limit - 2 * (p @ x[i]), 0))
                reach = np.sqrt(max(qq[i] + space.limit - 2 * least[i], 0.0))
                to = labels[d - radius <= reach + 2 * space.slack]
                rows = b.slice(i, 1).take(pa.array(np.zeros(len(to), np.int64)))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(to)], names=["q", "x", "tree", "least", "cell"])

    return queries.select("q", "x", "tree", "least").mapInArrow(task, "q long, x array<long>, tree long, least long, cell int")
