"""Exact top-k search, whitening and phrase mining against plain versions, on rows with nulls, repeats, ties and odd vectors."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sumac.llm import mtree, phrases
from sumac.llm.automata import Automaton, Union, build, compose, union
from sumac.llm.mtree import Space, Tree, search
from sumac.llm.phrases import collocations
from sumac.llm.whitening import deviations, eigen, products, whiten, Model

VECTORS = "vec_id long, embedding array<float>, label int, id string, x string, q string, cell string, w string, n string"


def made_vectors(spark, n=700, dims=8, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    rows = [(i, (centres[i % 6] + 0.3 * rng.normal(size=dims)).tolist()) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(200)]  # one vector as a fifth of all rows
    rows += [(7, rows[7][1]), (50, rows[50][1]), (50, rows[3][1]), (None, rows[9][1]), (None, rows[9][1])]  # repeated and null ids
    rows += [(2000, None), (2050, []), (2100, [1.0] * 7 + [None]), (2150, [math.nan] * 8), (2200, [math.inf] * 8), (2250, [1.0] * 3), (2300, [1e30] * 8)]
    frame = spark.createDataFrame([(i, v, 1, "c", "c", "c", "c", "c", "c") for i, v in rows], VECTORS).repartition(5)
    return [(i, v) for i, v in rows if v and len(v) == dims and all(c is not None and math.isfinite(c) and abs(c) < 1e20 for c in v)], frame


def whole(rows, scale, shift=0):
    return np.array([[math.floor(scale * float(np.float32(c))) + shift for c in v] for _, v in rows], np.int64)


def plain_top(rows, k, every):
    x = whole(rows, 256)
    out = []
    for i, (ident, _) in enumerate(rows):
        if ident is not None and ident % every == 0:
            best = sorted(((-int(s), other is None, other or 0) for j, (s, (other, _)) in enumerate(zip(x @ x[i], rows)) if j != i))[:k]
            out += [(ident, r + 1, None if none else o, -s) for r, (s, none, o) in enumerate(best)]
    return Counter(out)


@pytest.mark.parametrize("size", [4096, 40])
def test_top_k_is_that_of_all_pairs(spark, monkeypatch, size):
    """With one tree, and with many cells, of which the hot ones are several trees."""
    monkeypatch.setattr(mtree, "TREE", size)
    monkeypatch.setattr(mtree, "CELLS", 5)
    monkeypatch.setattr(mtree, "LEAF", 8)
    rows, frame = made_vectors(spark)
    got = search(frame, F.col("id") % 50 == 0).collect()
    assert Counter((r["query_id"], r["rank"], r["id"], r["score"]) for r in got) == plain_top(rows, 5, 50)
    assert max(r["computed"] for r in got) < len({tuple(v) for _, v in rows})  # bounds spared some distances of every query


def test_top_k_of_few_rows(spark):
    rows, frame = made_vectors(spark)
    assert search(frame.limit(0), F.col("id") % 50 == 0).count() == 0
    assert search(frame.where("vec_id = 100"), F.col("id") % 50 == 0).count() == 0
    assert search(frame.where("vec_id = 101"), F.col("id") % 50 == 0).count() == 0
    assert search(frame.where("vec_id IN (100, 101, 102)"), F.col("id") % 50 == 0).count() == 2  # fewer than five


@pytest.mark.parametrize("scale", [1, 10**9])
def test_tree_search_and_its_bounds(scale):
    """Every page's entries lie within its radius; best-first search gives what a scan does, in whole numbers of any size."""
    rng = np.random.default_rng(5)
    x = np.unique(np.floor(scale * 20 * (rng.integers(0, 9, (900, 1)) + rng.normal(size=(900, 4)))), axis=0)
    space = Space(float((x * x).sum(1).max()))
    lift = space.lift(x)
    pages = {p["page"]: p for p in mtree.build(x, space)}

    def below(p):
        return set(p["rows"].tolist()) if p["leaf"] else set().union(*(below(pages[c]) for c in p["child"]))

    assert below(pages[0]) == set(range(len(x)))
    for p in pages.values():
        for r, radius, child in zip(p["rows"], p["radius"], p["child"]):
            under = list(below(pages[child]))
            assert space.between(x[under], lift[under], x[r], lift[r]).max() <= radius + space.slack
            assert len(p["rows"]) <= mtree.FAN
    tree = Tree.__new__(Tree)
    tree.space, tree.exact = space, scale == 1
    whole = x.astype(np.int64)
    tree.pages = {k: (p["leaf"], (x if scale == 1 else whole)[p["rows"]], p["parent"], p["radius"], p["child"].tolist(), [[int(r)] for r in p["rows"]]) for k, p in pages.items()}
    spent = 0
    for i in range(0, len(x), 17):
        want = sorted((-int(s), False, j, False) for j, s in enumerate(whole.astype(object) @ whole[i].astype(object)))[:6]
        got, computed = tree.best(whole[i], 6, None)
        assert got == want
        assert tree.best(whole[i], 6, -want[-1][0])[0] == want  # entries that tie with the score to beat are kept
        spent += computed
    assert spent < 0.7 * len(x) * len(range(0, len(x), 17))


# whitening


def test_whitening(spark):
    rows, frame = made_vectors(spark, dims=8)
    got = whiten(frame, most=5).collect()
    x = whole(rows, 64, 1_000_000)
    distinct = np.unique(x, axis=0)
    n, s = len(distinct), distinct.sum(0)
    values, vectors = np.linalg.eigh(np.cov(distinct.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    by = defaultdict(list)
    for r in got:
        by[r["component"]].append(r)
    assert sorted(by) == [1, 2, 3, 4, 5] and {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1
    assert got[0]["identity_error"] < 1e-9
    for k, own in by.items():
        want = (x - s / n) @ vectors[:, k - 1] / np.sqrt(values[k - 1])
        want = Counter((i, d, round(float(w), 8) + 0.0) for (i, _), d, w in zip(rows, ((n * x - s) ** 2).sum(1).tolist(), want))
        signs = [Counter((r["id"], r["deviation"], round(sign * r["whitened"], 8) + 0.0) for r in own) for sign in (1, -1)]
        assert want in signs
        assert abs(own[0]["explained"] - values[k - 1] / values.sum()) < 1e-12


def test_whitening_without_variance(spark):
    _, frame = made_vectors(spark)
    for rows in (frame.limit(0), frame.where("vec_id = 5"), frame.where("vec_id >= 700 AND vec_id < 900")):
        assert whiten(rows).count() == 0
    two = frame.where("vec_id IN (5, 6)")
    assert sorted((r["component"], round(abs(r["whitened"]), 9)) for r in whiten(two).collect()) == [(1, 1.0), (1, 1.0)]  # only one direction varies


def spectrum(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values),) * 2))[0].astype(np.longdouble)
    for _ in range(3):
        q = q @ (1.5 * np.eye(len(q)) - 0.5 * q.T @ q)
    a = q @ np.diag(np.array(values, np.longdouble)) @ q.T
    return (a + a.T) / 2, q


@pytest.mark.parametrize("values", [range(1, 31), [1, 2, 3] * 8, [1 + 1e-9 * i for i in range(15)] + [2, 3, 4], [1 + 1e-14 * i for i in range(15)] + [0] * 9, [10.0**-i for i in range(20)], [0] * 5])
def test_refined_eigenvectors(values):
    """Residual and right angles at double precision, for clusters and multiple eigenvalues too; float32 alone is far from it."""
    a, q = spectrum(list(values))
    found, x = eigen(a)
    scale = max(1e-300, float(np.abs(a).max()))
    assert np.all(np.diff(found) <= 0)
    assert np.abs(np.sort(np.array(values, float)) - np.sort(found)).max() <= 1e-15 * scale
    assert np.abs(x.T @ x - np.eye(len(x))).max() < 2e-15
    assert float(np.abs(a @ x - x * found).max()) < 5e-16 * scale or scale == 1e-300
    if len(set(values)) == len(values) and min(abs(np.diff(sorted(values)))) >= 1e-9:  # vectors are told apart: float64 has lost nine digits here
        order = np.argsort(-np.array(values, float), kind="stable")
        assert float(np.abs(np.abs((q[:, order] * x).sum(0)) - 1).max()) < 1e-14


def test_sums_are_exact_at_any_size():
    big = np.array([[3 << 40, -5], [(1 << 50) + 1, 7]], np.int64)
    assert products(big).tolist() == (big.astype(object).T @ big.astype(object)).tolist()
    small = np.arange(3000).reshape(-1, 3)
    assert products(small).tolist() == (small.T @ small).tolist()
    model = Model(10**6, [0, 0], [1, 2], np.eye(2), np.ones(2), 2.0)
    assert deviations(np.array([[1, 2], [1 << 50, 0]]), model) == [(10**6 - 1) ** 2 + (2 * 10**6 - 2) ** 2, None]  # beyond 64 bits: null


# phrases


def made_texts(seed=1):
    rng = random.Random(seed)
    names = ["new york", "new york city", "der Hund", "ünï cöde", "a a a", "of the", "state of the art"]
    texts = []
    for _ in range(300):
        parts = [rng.choice(names) if rng.random() < 0.4 else "w%d" % min(int(rng.expovariate(0.1)), 80) for _ in range(rng.randint(0, 60))]
        texts.append("".join(p + rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", "  "]) for p in parts))
    texts += [None, "", " \t ", "...", "One", " ".join(["very long"] * 3000), texts[0], texts[0], "New YORK!new york"]
    return [(rng.choice(["en", "de", None, "und", "fr x"]), t) for t in texts]


def plain_phrases(rows, least, best, longest=5):
    count, n = Counter(), Counter()
    for lang, t in rows:
        lang = "und" if lang is None else lang
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", t):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    count[lang, tuple(w[i : i + m])] += 1
    candidates = {k: a for k, a in count.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in candidates.items():
        if any(k[0] == lang and len(k[1]) > len(p) and 100 * f >= 100 * a and any(k[1][i : i + len(p)] == p for i in range(len(k[1]))) for k, f in candidates.items()):
            continue
        s, _, le, r = min((1000 * a * n[lang] // (count[lang, p[:k]] * count[lang, p[k:]]), k, count[lang, p[:k]], count[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, -s, -a, " ".join(p).encode(), le, r, n[lang]))
    result = []
    for lang in n:
        own = sorted(x for x in out if x[0] == lang)[:best]
        result += [(lang, i + 1, p.decode(), -a, le, r, m, -s) for i, (_, s, a, p, le, r, m) in enumerate(own)]
    return Counter(result)


@pytest.mark.parametrize("shard, bits, table", [(24 << 20, 16, 22), (2000, 17, 22), (2000, 17, 16)])
def test_collocations(spark, monkeypatch, shard, bits, table):
    """One shard a task and many; a filter of one slice and of two, added up in tables or sorted."""
    monkeypatch.setattr(phrases, "TABLE_BITS", table)
    monkeypatch.setattr(phrases, "SHARD", shard)
    monkeypatch.setattr(phrases, "LEAST_BITS", bits)
    rows = made_texts()
    frame = spark.createDataFrame([(t, lang, i, "c", "c", "c", "c") for i, (lang, t) in enumerate(rows)], "text string, lang string, n int, phrase string, a string, score string, range string").repartition(4)
    for least, best in ((20, 2000), (5, 7), (300, 50)):
        got = Counter(map(tuple, collocations(frame, least=least, best=best).collect()))
        assert got == plain_phrases(rows, least, best) and got


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert collocations(empty).count() == 0
    assert collocations(spark.createDataFrame([(None, None), ("", "en"), ("a b", "en")], "text string, lang string")).count() == 0


def test_filter_turns_down_nothing_frequent():
    """Whatever the buckets: n-grams whose words, pairs and triples pass are all counted, exactly."""
    w = phrases.Words("en", [b"a b c. a b c! a b d", b"x a b c"])
    full, none = np.full(1 << 13, 255, np.uint8), np.zeros(1 << 13, np.uint8)
    filters = lambda a, b: [phrases.Filter(16, (1, 2), a), phrases.Filter(16, (3,), b)]
    counted = lambda fs: {tuple(labels[i] for i in row if i >= 0): c for labels, table, counts in [phrases.grams(w, fs, 5)] for row, c in zip(table.tolist(), counts.tolist())}
    got = counted(filters(full, full))
    assert got[(b"a", b"b", b"c")] == 3 and got[(b"x", b"a", b"b", b"c")] == 1 and (b"c", b"a") not in got and len(got) == 13
    assert max(map(len, counted(filters(full, none)))) == 2
    assert not counted(filters(none, none))


def test_automata():
    rng = random.Random(2)
    items = [Counter({tuple(rng.choice([b"a", b"b", b"\xff", b"", b"a b"]) for _ in range(rng.randint(1, 5))): rng.randint(1, 3) for _ in range(k)}) for k in (0, 1, 50, 400, 400)]
    autos = [Automaton.loads(build(sorted(x.items())).dumps()) for x in items]
    for auto, want in zip(autos, items):
        assert list(auto) == sorted(want.items())
        states = list(zip(auto.counts[:-1], auto.arcs[:-1]))
        assert len(states) == len(set(states))  # minimal: no two states are equal
    assert len(autos[-1].counts) < len(items[-1])  # and equal ends are shared
    total = sum(items, Counter())
    assert list(union(autos)) == sorted(total.items())
    assert list(union(autos, least=3)) == sorted((k, v) for k, v in total.items() if v >= 3)
    many = Union()
    for _ in range(40):
        for a in autos:
            many.add(a)
    assert list(many.result()) == sorted((k, 40 * v) for k, v in total.items())
    assert dict(compose(autos[3], autos[4])) == {k: items[4][k] for k in items[3] if k in items[4]}
