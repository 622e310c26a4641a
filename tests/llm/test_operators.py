"""Each operator against a plain version in Python, on rows with nulls, blanks, repeats, ties and long texts."""

import hashlib
import json
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sumac.llm import decontaminate, html, lines, mixing, quality, quality_rules, simhash, substring, tokens, urls
from sumac.llm.common import connected_components, new_path

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, th string, fp string, size string, spans string, rank string"


def words(t):
    return WORD.findall(t or "")


def made(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)] + ["the", "der", "Ünï", "x,", "A"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 120))) for _ in range(n)]
    for i in range(0, n, 7):  # copies, near copies and shared passages
        texts[i] = texts[0]
    texts[5] = texts[4] + " end"
    texts[8] = texts[9][:200] + "\n" + texts[9][200:]
    texts += [None, "", "  \n\t ", "one", " ".join(rng.choices(vocabulary, k=6000)), "\n".join(["same line here"] * 9), texts[2]]
    return [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[3]), (None, texts[1]), (None, None), (4, "another text of four")]


def frame(spark, rows, parts=3):
    full = [(i, t, ["en", "de", None][k % 3], ["a", "b", "c", None, "hot", "hot", "hot"][k % 7], len(t) if t else None, "c", "c", "c", "c", "c", "c") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, made()).persist()


def bag(rows):
    return Counter(map(tuple, rows))


# op1


def page(body, title="T"):
    return f'<!DOCTYPE html><html><head><title>{title}</title><script>var a="</p>";</script></head><body><nav><ul><li>menu {title}</ul></nav>{body}<footer>&copy; us</footer></body></html>'


def test_main_text(spark):
    rows = [(i, "https://h.example/%d" % i, page(f'<div class="ad">buy {i}</div><article><h1>Title {i}</h1><p class=share>Share this</p><p><b>Body&nbsp;&amp; {i}<br>more<p>second   part {i}<section class="comments"><p>nice</p></section></article>')) for i in range(8)]
    rows += [(20, None, page("<main><p>only <i>ma</i>in</p><form>name</form></main>")), (21, "https://x.example/", None), (22, "https://x.example/", ""), (23, "no url", page("<div><p>plain text of the page</p><p><a href=x>all link</a></p></div><aside>side</aside>"))]
    rows += [(0, *rows[0][1:])]
    df = spark.createDataFrame([(*r, "c", "c") for r in rows], "page_id long, url string, html string, host string, reference string")
    got = bag((r.id, r.text) for r in html.extract(df).collect())
    want = Counter()
    for i, _, h in rows:
        if i < 20:
            want[i, f"Title {i} Body & {i} more second part {i}"] += 1  # what all pages share, "Share this", is template
    want.update([(20, "only main"), (21, ""), (22, ""), (23, "plain text of the page")])
    assert got == want
    assert html.extract(df.limit(0)).count() == 0


def test_copies_of_a_page_are_no_template(spark):
    body = page("<article><p>the whole article</p></article>")
    df = spark.createDataFrame([(i, "http://a.example/%d" % i, body) for i in range(9)], "page_id long, url string, html string")
    assert {r.text for r in html.extract(df).collect()} == {"the whole article"}


@pytest.mark.parametrize(
    "body, want",
    [
        ("<header>site</header><article><header><h1>T</h1></header><p>a</p><aside>no</aside></article><div id=comments><article>reader</article></div>", "T a"),
        ("<div id='header'>site</div><div class='post'><h1>T</h1><p>a<ul><li>b<li>c</ul></div><div class='cookie-notice'>no</div>", "T a b c"),
        ("<div role=main><p>a &lt;b&gt; &#233;</div><div class='sidebar left'>no</div><div class='comment-list'>no</div>", "a <b> é"),
        ("<div class=wrap><p>one text here</p><ul><li><a href=x>link one</a><li><a href=y>link two</a></ul><div style='display: none'>no</div></div>", "one text here"),
        ("<table><tr><td>a<td>b<tr><td>c</table><textarea>no</textarea><!-- no --><noscript>no</noscript>", "a b c"),
        ("<article><p>a<b>b</b>c <i>d</i>\n\n e<br>f</p>g<div class=ad>no</div></article>", "abc d e f g"),
    ],
)
def test_content(body, want):
    assert html.content(html.parse(f"<html><body>{body}</body></html>")[0], set()) == want


def plain_matching(a, b):
    """The most nodes of two trees, child by child."""
    if a.kind != b.kind:
        return 0
    best = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children):
        for j, y in enumerate(b.children):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + plain_matching(x, y))
    return 1 + best[-1][-1]


def test_matching_is_the_largest(monkeypatch):
    rng = random.Random(9)

    def tree(depth):
        kind = rng.choice(["div", "p", "ul"])
        inside = "".join(tree(depth - 1) if depth and rng.random() < 0.7 else "<p>" + rng.choice("abcdef") for _ in range(rng.randint(0, 6)))
        return f"<{kind}>{inside}</{kind}>"

    for cells in (1 << 20, 4):  # the second: tables are kept in part
        monkeypatch.setattr(html, "CELLS", cells)
        for _ in range(60):
            a, b = html.parse(tree(3))[0], html.parse(tree(3))[0]
            n, pairs = html.matching(a, b)
            assert n == len(pairs) == plain_matching(a, b)
            assert all(x.kind == y.kind for x, y in pairs) and len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == n


def test_constant_line_after_a_varying_number_of_lines(spark):
    body = lambda i: "".join(f"<p>own {i} {k}</p>" for k in range(1 + i % 4)) + "<p>All rights reserved</p>" + "<p>and more</p>" * (i == 99)
    rows = [(i, "http://c.example/%d" % i, page(f"<article><h1>T {i}</h1>{body(i)}</article>")) for i in range(12)]
    got = {r.id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: " ".join([f"T {i}", *(f"own {i} {k}" for k in range(1 + i % 4))]) for i in range(12)}
    long = lambda i: html.parse("<article>" + "".join(f"<p>{i} {k}</p>" for k in range(1500 + i)) + "<p>end</p><p>last</p></article>")[0]
    assert ("end", "end") in [(x.text, y.text) for x, y in html.matching(long(0), long(7))[1]]


def test_varying_element_is_the_content(spark):
    text = lambda i: f"<h1>Title {i}</h1><div class=x><p>long own text {i} of this page</p><p>and {i} more of it</p></div><p>Follow us</p>"
    rows = [(i, "http://v.example/%d" % i, page(f"<article class=teaser><p>see {i}</p></article><div class=y>{text(i)}</div>")) for i in range(9)]
    rows += [(i, "http://w.example/%d" % i, page(f"<article><h1>T {i}</h1><div><p>body {i}</p><p>long body text {i}</p></div></article><div>sold {i}</div>")) for i in range(20, 29)]
    got = {r.id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i} long own text {i} of this page and {i} more of it" for i in range(9)} | {i: f"T {i} body {i} long body text {i}" for i in range(20, 29)}


def test_wrappers_of_layouts_and_of_few_pages(spark):
    own = lambda i: f"<h1>T {i}</h1><p>long own text {i} of this page {i}</p>"
    lines = ["<p>line of layout a</p>", "<p>line of layout b</p>", "<p>line of layout c</p>"]
    rows = [(i, "http://l.example/%d" % i, page(f"<article class={'abc'[i % 3]}>{own(i)}{lines[i % 3]}</article>")) for i in range(36)]
    rows += [(i, "http://two.example/%d" % i, page(f"<article>{own(i)}<p>Share</p></article>")) for i in (50, 51)]
    rows += [(i, "http://m%d.example/%d" % (i % 6, i), page(f"<article>{own(i)}{'<h2>Most pages say this</h2>' if i % 5 < 3 else ''}</article>")) for i in range(100, 280)]
    rows += [(i, "http://n.example/%d" % i, page(f"<article>{own(9)}<p>near copy {i}</p></article>")) for i in (95, 96)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.id: r.text for r in html.extract(df).collect()}
    want = {i: f"T {i} long own text {i} of this page {i}" for i, _, _ in rows}
    assert got == want | {i: f"T 9 long own text 9 of this page 9 near copy {i}" for i in (95, 96)}


def neutral(h):
    """A page whose elements are all div without classes, paragraphs that the page leaves open closed first."""
    h = h.replace("<br><p>", "<br></p><p>").replace("<br></article>", "<br></p></article>")
    return re.sub(r"<(/?)(?:nav|ul|li|article|h1|p|footer|div)\b[^>]*>", r"<\1div>", h)


def test_wrapper_alone_finds_the_text(spark, monkeypatch):
    given = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    hosts = "regexp_extract(url, '://([^/?#]*)', 1) IN ('www.ththin.example.net', 'therat.example.net', 'blog.tionsh.example.com')"
    rows = [(r.page_id, r.url, r.html) for r in given.where(hosts).collect()]
    assert len(rows) > 300
    tagged = spark.createDataFrame(rows, "page_id long, url string, html string")
    plain = spark.createDataFrame([(i, u, neutral(h)) for i, u, h in rows], "page_id long, url string, html string")
    want = {i: " ".join(html.content(html.parse(h[h.index("<article>") : h.index("</article>")] + "</article>")[0], set()).split()) for i, _, h in rows}
    assert {r.id: r.text for r in html.extract(tagged).collect()} == want
    assert {r.id: r.text for r in html.extract(plain).collect()} == want
    none = html.wrappers(html.with_references(plain.limit(0).withColumns({"host": F.lit(""), "layout": F.lit(0).cast("long")}), html.references(plain.limit(0).withColumns({"host": F.lit(""), "layout": F.lit(0).cast("long")}))))
    monkeypatch.setattr(html, "wrappers", lambda pages: none)
    without = {r.id: r.text for r in html.extract(plain).collect()}
    assert not [i for i in want if without[i] == want[i]]


def test_deep_and_long_pages(spark):
    deep = lambda i: page("<div>" * 4000 + f"<h1>T {i}</h1><p>own deep text {i} of page {i}</p>" + f"<p>more {i}</p>" * (i % 3) + "<p>Share this</p>")
    long = lambda i: page("<div>" + "".join(f"<p>line {k} of page {i}</p>" for k in range(4000 + i)) + "</div>")
    rows = [(i, "http://deep.example/%d" % i, deep(i)) for i in range(12)] + [(i, "http://long.example/%d" % i, long(i)) for i in range(20, 32)]
    got = {r.id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        assert got[i] == " ".join([f"T {i} own deep text {i} of page {i}", *[f"more {i}"] * (i % 3)])
    for i in range(20, 32):
        assert got[i] == " ".join(f"line {k} of page {i}" for k in range(4000 + i))
    html.parse("<x>" * 100_000 + "</y>" * 100_000 + "<i>" * 100_000)


def test_nested_pages_take_time_in_proportion(spark):
    """40,000 headers in one another, and 4,000 unclosed levels of two children each that differ at the bottom: quadratic walks took minutes."""
    headers = lambda i: page("<article>" + "<header>" * 40_000 + f"<h1>T {i}</h1><p>text {i}</p>")
    levels = lambda i: page("".join(f"<div><p>level {k}" for k in range(4000)) + f"<div><p>bottom {i}")
    start = time.perf_counter()
    root, _ = html.parse(headers(1))
    assert html.content(root, set()) == "T 1 text 1"
    a, b = html.parse(levels(1))[0], html.parse(levels(2))[0]
    n, pairs = html.matching(a, b)
    assert n == len(pairs) == len(html.in_order(a))
    assert time.perf_counter() - start < 10
    rows = [(i, "http://head.example/%d" % i, headers(i)) for i in range(4)] + [(i, "http://levels.example/%d" % i, levels(i)) for i in range(10, 14)]
    got = {r.id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].endswith(f"text {i}") for i in range(4)) and all(got[i].endswith(f"bottom {i}") for i in range(10, 14))


def test_broken_html():
    for text in ("<", "<p", "<p class='a", "a < b & c &amp", "<!-- open", "<script>x", "</p></div>text", "<p>a<p>b</b>", "<" * 5000, "<div>" * 3000 + "deep"):
        root, _ = html.parse(text)
        assert isinstance(html.content(root, set()), str)


# op2


def test_quality_classifier(spark):
    rng = random.Random(3)
    good = [" ".join(rng.choices(["fine%d" % i for i in range(60)], k=60)) for _ in range(300)]
    rows, labels = [], []
    for i, t in enumerate(good):
        kind = i % 5
        text = t if kind < 3 else t + " awful awful2" if kind == 3 else " ".join(w + "***" for w in t.split())
        rows.append((i, text, "c", "c"))
        labels.append((i, 0 if kind == 4 else 1, 1 if kind == 3 else 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, good string, expected_grade string")
    lab = spark.createDataFrame([*labels[:200], (None, 1, 1), (7, None, 1), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(df, lab)
    assert model.grades == [0, 1, 2] and model.cuts[0] < model.cuts[1]
    again = quality.train(df.repartition(7), lab)
    assert np.array_equal(model.weights, again.weights)
    kept = {r.doc_id for r in quality.select_good(df, model).collect()}
    held_out = range(200, 300)
    assert sum((i in kept) == (i % 5 < 3) for i in held_out) >= 90  # from 200 labels
    assert quality.select_good(df, model).columns == df.columns
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "fine1 " * 50000)], "doc_id long, text string")
    rated = quality.score(odd, model).collect()
    assert all(0 <= r.good <= 1 and 0 <= r.expected_grade <= 2 for r in rated)
    assert quality.score(odd.limit(0), model).count() == 0
    one = quality.train(df, lab.where("quality = 1 AND toxic = 0"))
    assert {r.good for r in quality.score(odd, one).collect()} == {1.0}


def plain_probabilities(score, cuts):
    """P(grade = k) of a cumulative-link model."""
    below = [0.0] + [1 / (1 + np.exp(score - c)) for c in cuts] + [1.0]
    return [b - a for a, b in zip(below, below[1:])]


def test_scores_are_those_of_the_plain_model(spark):
    rng = np.random.default_rng(2)
    weights = np.zeros(quality.BUCKETS)
    texts = ["good plain words here", "BAD bad*** bad*** text", "one", "", None, "a b c d e f g " * 200]
    for t in texts:
        weights[quality.features((t or "").encode())] = rng.normal(size=len(quality.features((t or "").encode())))
    model = quality.Model([0, 1, 2], np.array([-0.7, 0.4]), weights)
    rated = quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in rated:
        p = plain_probabilities(sum(np.float32(weights[b]) for b in quality.features((r.text or "").encode())), model.cuts)
        assert r.good == pytest.approx(p[2], abs=1e-5) and r.expected_grade == pytest.approx(p[1] + 2 * p[2], abs=1e-5)
    kept = {r.doc_id for r in quality.select_good(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert kept == {r.doc_id for r in rated if r.good >= 0.5}


def test_fit_reaches_the_plain_likelihood():
    rng = np.random.default_rng(5)
    x = rng.random((900, 6)) < 0.4
    true = np.array([2.0, -1.5, 1.0, 0.0, -0.5, 0.8])
    y = np.digitize(x @ true + rng.logistic(size=900), [-0.3, 1.2])  # three grades of about one size, so all weigh the same

    def mean_log(weights, cuts):
        return float(np.mean([np.log(plain_probabilities(s, cuts)[k]) for s, k in zip(x @ weights, y)]))

    # the plain likelihood, climbed by numeric gradients
    at = np.concatenate((np.zeros(6), [-0.5, 0.5]))
    value = lambda v: mean_log(v[:6], v[6:])
    for _ in range(60):
        slope = np.array([(value(at + e) - value(at - e)) / 2e-4 for e in np.eye(8) * 1e-4])
        at = at + 4 * slope
    model = quality.fit([np.flatnonzero(r) for r in x], y, buckets=6, shrink=0.0)
    assert mean_log(model.weights, model.cuts) > value(at) - 0.01
    assert np.abs(model.weights - at[:6]).max() < 0.3 and np.abs(model.cuts - at[6:]).max() < 0.3


# op3


def plain_fingerprint(t):
    ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").translate({}) if t else ""
    ws = WORD.findall(ws)
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [" ".join(ws)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, distance=3):
    roots = list(range(len(fps)))

    def root(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                roots[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


def test_near_duplicates(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    fps = [plain_fingerprint(t) for _, t in rows]
    group = classes(fps)
    least = {}
    for (i, _), g in zip(rows, group):
        least[g] = min((x for x in (i, least.get(g)) if x is not None), default=None)
    want = bag((i, f, least[g]) for (i, _), f, g in zip(rows, fps, group))
    got = simhash.near_duplicates(docs).collect()
    assert bag((r.id, r.fp & (2**64 - 1), r.component_id) for r in got) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert len(set(group)) == kept.count()
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_close_links_find_dense_balls_in_tiles(spark):
    rng = random.Random(5)
    center = rng.getrandbits(64)
    fps = {center ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(0, 64, 9)} | {rng.getrandbits(64) for _ in range(300)}
    far = rng.getrandbits(64)
    fps |= {far, far ^ 0b111, far ^ 0b111111, far ^ (0b1111 << 30)}  # a chain, and one four bits off
    fps = [f - 2**64 if f >= 2**63 else f for f in sorted(fps)]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = classes([f & (2**64 - 1) for f in fps])
    for tile in (16, 4096):
        got = {r.node: r.root for r in connected_components(simhash.close_links(df, tile=tile)).collect()}
        mine = [got.get(f, f) for f in fps]
        assert len(set(zip(mine, want))) == len(set(want)) == len(set(mine))


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(70)] + [(200, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and 200 not in got
    assert all(got[a] == got[b] <= min(a, b) for a, b in edges if a != b)


# op4


def test_mix(spark, docs):
    rows = mixing.mix(docs).collect()
    size = {True: 0}
    by = defaultdict(int)
    for r in docs.collect():
        by[r.source] += len(words(r.text))
    order = sorted((s for s in by if s is not None)) + ([None] if None in by else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    budget, full = 1.5 * sum(by.values()), set()
    while True:
        level = (budget - sum(2 * by[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        new = {s for s in order if s not in full and weight[s] * level > 2 * by[s]}
        if not new:
            break
        full |= new
    target = {s: 2.0 * by[s] if s in full else weight[s] * level for s in order}
    taken = defaultdict(int)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == by[r.source]
        assert r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) < 1 + 1e-6 for s in order)
    assert bag((r.id, r.th, r.size) for r in rows).total() == docs.count() and size
    assert bag(rows) == bag(mixing.mix(docs.repartition(5)).collect())
    assert all((r.taken >= r.size) == (r.finish <= 1) for r in rows if r.finish is not None and r.size)
    assert mixing.mix(docs.limit(0)).count() == 0
    one_id = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert sum(r.taken for r in mixing.mix(one_id).collect()) == sum(taken.values())


def test_budget_ends_by_the_global_order(spark):
    rng = random.Random(4)
    for n, times in ((300, 1000), (300, 6), (1, 1)):
        given = [(rng.randint(1, times) / 7, rng.randint(1, 50)) for _ in range(n)]
        queue = spark.createDataFrame(given, "finish double, words long").repartition(5)
        for budget in (0, 10, sum(w for _, w in given) // 3, sum(w for _, w in given) - 1, 10**6):
            upto = {t: sum(w for x, w in given if x <= t) for t, _ in given}
            assert mixing.end_of_budget(queue, budget) == max((t for t in upto if upto[t] <= budget), default=None)
    assert mixing.end_of_budget(queue.limit(0), 5) is None


def test_other_finish_times_change_the_mix(spark, docs, monkeypatch):
    want = bag((r.id, r.th, r.taken) for r in mixing.mix(docs).collect())
    plain = mixing.packets
    monkeypatch.setattr(mixing, "packets", lambda most: F.transform(plain(most), lambda x: F.struct((F.lit(2.0) - x["finish"]).alias("finish"), x["words"].alias("words"))))
    assert bag((r.id, r.th, r.taken) for r in mixing.mix(docs).collect()) != want


def test_mixed_rows(spark, docs):
    unique = docs.dropDuplicates(["doc_id", "text"])
    out = mixing.mixed(unique)
    assert out.columns == docs.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text)
    want = defaultdict(int)
    for r in mixing.mix(unique).collect():
        want[r.id] += r.taken
    assert {k: v for k, v in want.items() if v} == dict(got)


# op5


def folded(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def plain_contamination(text, items, window=10):
    ws, hit, found = folded(text), set(), set()
    for k, t in items:
        iw = folded(t)
        n = min(window, len(iw))
        for j in range(len(iw) - n + 1 if n else 0):
            for i in range(len(ws) - n + 1):
                if ws[i : i + n] == iw[j : j + n]:
                    hit.update(range(i, i + n))
                    found.add(str(k)) if k is not None else None
    return len(ws), len(hit), sorted(found)


ITEMS = [(1, "w1 w2 W3, w4"), (2, "a b a b a b a b a b a b a"), (3, None), (4, "..."), (10, "b a b a b a b a b a"), (None, "Ünï w9"), (12, "one"), (7, " ".join("w%d" % i for i in range(40, 58)))]


@pytest.mark.parametrize("item_words", [200_000, 8])
def test_contamination(spark, docs, item_words):
    rows = [(100, "x w1, W2 w3 w4 y w1 w2 w3"), (101, "z a b a b a b a b a b a b a b q"), (102, " ".join("w%d" % i for i in range(35, 70))), (103, "Ünï\nw9 ünï"), (104, "one two ONE")]
    df = frame(spark, rows).unionByName(docs)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.contamination(df, items, item_words=item_words).collect()
    want = bag((r.doc_id, *plain_contamination(r.text, ITEMS)[:2], tuple(plain_contamination(r.text, ITEMS)[2])) for r in df.collect())
    assert bag((r.id, r.n_words, sum(b - a for a, b in r.spans), tuple(r["items"])) for r in got) == want
    assert all(s == sorted(s) and all(a[1] < b[0] for a, b in zip(s, s[1:])) for s in (r.spans for r in got))
    clean = decontaminate.decontaminate(df, items, item_words=item_words)
    assert clean.columns == df.columns
    assert bag(map(tuple, clean.collect())) == bag(tuple(r) for r in df.collect() if not plain_contamination(r.text, ITEMS)[1])
    assert decontaminate.contamination(df.limit(0), items).count() == 0
    assert decontaminate.decontaminate(df, items.limit(0)).count() == df.count()


def test_cutting_spans(spark):
    df = frame(spark, [(1, "x y w1 w2 w3 w4 z Q"), (2, "w1 w2 w3 w4"), (3, "nothing Here"), (4, None)])
    items = spark.createDataFrame([(1, "w1 w2 w3 w4")], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.decontaminate(df, items, max_coverage=0.6).collect()}
    assert got == {1: "x y z q", 3: "nothing Here", 4: None}


def test_automaton_on_random_streams():
    rng = random.Random(9)
    for _ in range(150):
        items = [(k, [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 14))]) for k in range(4)]
        stream = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(80)]
        mask, found = decontaminate.Automaton(items, 5).hits(stream)
        n, hit, names = plain_contamination(b" ".join(stream).decode(), [(k, b" ".join(t).decode()) for k, t in items], 5)
        assert (0 if mask is None else int(mask.sum())) == hit and sorted(map(str, found)) == names


# op6


def plain_repeats(texts, size):
    all_words = [words(t) for t in texts]
    count = Counter(tuple(w[i : i + size]) for w in all_words for i in range(len(w) - size + 1))
    out = []
    for w in all_words:
        gone = {i + k for i in range(len(w) - size + 1) if count[tuple(w[i : i + size])] > 1 for k in range(size)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("size", [35, 4, 1])
def test_without_repeats(spark, docs, size):
    rows = docs.collect()
    want = bag((r.doc_id, *p) for r, p in zip(rows, plain_repeats([r.text for r in rows], size)))
    for df in (docs, docs.coalesce(1)):
        assert bag(map(tuple, substring.without_repeats(df, size).collect())) == want
    assert substring.without_repeats(docs.limit(0), size).count() == 0


def test_window_hashes_and_packing():
    rng = np.random.default_rng(1)
    for size in (1, 2, 3, 35, 64):
        w = rng.integers(0, 2**63, 200).astype(np.uint64)
        base = int(substring.WORD_BASE[0])
        plain = [sum(int(x) * pow(base, size - 1 - k, 1 << 64) for k, x in enumerate(w[i : i + size])) % 2**64 for i in range(200 - size + 1)]
        assert np.array_equal(substring.window_hashes(w, size), substring.mixed(np.array(plain, np.uint64)))
    places = np.concatenate([np.cumsum(rng.integers(1, 2000, n)) for n in (500, 1, 30)])
    data, ends = substring.pack(places, np.array([500, 501, 531]))
    assert np.array_equal(substring.unpack(data, substring.starts_of(ends), np.array([500, 1, 30])), places)


def test_narrower_ranges_give_the_same(spark, docs, monkeypatch):
    for size in (0, 1 << 20, 1 << 30, 1 << 40, 100 << 40):
        bits, sub_bits, width = substring.layout(size)
        assert bits <= substring.MOST_BITS and size >> (bits + sub_bits) <= substring.RANGE_BYTES and width == (8 if sub_bits else 7)
    want = bag(map(tuple, substring.without_repeats(docs, 4).collect()))
    for most, length, held in ((2, 1 << 8, 1 << 25), (1, 1 << 12, 1)):
        monkeypatch.setattr(substring, "MOST_BITS", most)
        monkeypatch.setattr(substring, "RANGE_BYTES", length)
        monkeypatch.setattr(substring, "DEAL_BYTES", held)
        monkeypatch.setattr(substring, "SLICE", 5000)
        assert substring.layout(1 << 15)[1] > 1
        assert bag(map(tuple, substring.without_repeats(docs, 4).collect())) == want


def test_long_texts_hash_alike(monkeypatch):
    text = ("ab cd  efg\n" * 50 + "x" * 300 + " tail").encode()
    whole, starts = substring.word_hashes(text)
    monkeypatch.setattr(substring, "LONG_WORD", 60)
    whole, starts = substring.word_hashes(text)
    for size in (64, 300, 310, 400):
        monkeypatch.setattr(substring, "SLICE", size)
        parts, at = substring.word_hashes(text)
        assert np.array_equal(starts, at) and np.array_equal(whole, parts)
    word = b"y" * (1 << 20)  # as long as a slice, alone and in a longer text
    monkeypatch.undo()
    assert substring.word_hashes(word)[0][0] == substring.word_hashes(b"a " + word + b" b")[0][1]


# op7


def plain_lines(rows, window=3, long=10):
    keyed = sorted({(i is not None, i or 0, h, t or "") for i, h, t in rows})
    seen, gone = set(), {}
    for notnull, i, h, t in keyed:
        ls = [x.strip(" \t\n\x0b\x0c\r") for x in t.split("\n")]
        ls = [x for x in ls if x]
        n = min(window, len(ls))
        mine = set()
        runs = [(s, n) for s in range(len(ls) - n + 1 if n else 0)]
        runs += [(s, 1) for s in range(len(ls)) if n > 1 and len(ls[s].split()) >= long]
        for s, k in sorted(runs):
            run = tuple(ls[s : s + k])
            if run in seen:
                mine.update(range(s, s + k))
            seen.add(run)
        gone[notnull, i, h] = mine
    return gone


def test_line_dedup(spark, docs):
    rng = random.Random(4)
    pool = ["line %d of the pool" % i for i in range(12)] + [" ".join(f"w{i}x{k}" for k in range(n)) for i, n in enumerate((9, 10, 11, 40))] + ["a\tb  c d e f g h i\x0bj"]
    rows = [(i, "\n".join(rng.choices([*pool, "", "  own %d" % rng.randint(0, 10**6)], k=rng.randint(0, 30)))) for i in range(50)]
    rows += [(60, rows[0][1]), (60, rows[0][1]), (None, rows[1][1]), (61, None), (62, "\n\n"), (63, "a  \nb"), (64, "\n a\nb")]
    df = frame(spark, rows)
    hashed = df.select("doc_id", F.xxhash64("text", F.col("text").isNull()).alias("h"), "text").collect()
    gone = plain_lines([(r.doc_id, r.h, r.text) for r in hashed])
    want = Counter()
    for r in hashed:
        mine, out, k = gone[r.doc_id is not None, r.doc_id or 0, r.h], [], -1
        for x in (r.text or "").split("\n"):
            k += bool(x.strip(" \t\n\x0b\x0c\r"))
            if not x.strip(" \t\n\x0b\x0c\r") or k not in mine:
                out.append(x)
        want[r.doc_id, k + 1, len(mine), r.text if not mine else "\n".join(out)] += 1
    assert bag(map(tuple, lines.drop_later_runs(df).collect())) == want
    assert lines.drop_later_runs(docs.limit(0)).count() == 0


def test_later_copies_of_long_lines_go(spark):
    """Of the given lines of ten words and more, every later copy; lines that no text had before stay, however long the text."""
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    gone = {r.id: r for r in lines.drop_later_runs(given).collect()}
    first, later, left = {}, 0, 0
    for r in sorted(given.where("text IS NOT NULL").select("doc_id", "text").collect()):
        kept = Counter(x.strip() for x in (gone[r.doc_id].kept or "").split("\n"))
        for line in (x.strip() for x in (r.text or "").split("\n")):
            if len(line.split()) >= lines.LONG:
                if line in first:
                    later += 1
                    left += kept[line] > (first[line] == r.doc_id)
                first.setdefault(line, r.doc_id)
    assert later > 20 and left == 0
    text = "\n".join(f"{i} " + "word " * 12 for i in range(40_000))
    rows = [(1, text), (2, "own line\n" + f"{39_999} " + "word " * 12 + "\nother"), (3, "")]
    found = {r.id: (r.n_lines, r.n_removed, r.kept) for r in lines.drop_later_runs(frame(spark, rows)).collect()}
    assert found == {1: (40_000, 0, text), 2: (3, 1, "own line\nother"), 3: (0, 0, "")}


# op8


def plain_base(t):
    w = words(t)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(5)}
    ls = [x for x in (t or "").split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t or "")), len(ls) - len(set(ls)), len(covered), failed


def test_quality_rules(spark, docs):
    df = docs.unionByName(frame(spark, [(900, "a b c d e " * 9), (901, "The of and to " * 40), (902, "*** ### " * 200), (903, "a\nb\na\n\n \na"), (904, "Ünï%%\u3000x " * 30)]))
    got = quality_rules.judge_quality(df).collect()
    want = bag((r.doc_id, *plain_base(r.text)) for r in df.collect())
    assert bag((r.id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(not (r.base_failed and r.kept) for r in got)
    assert all(r.kept != r.base_failed for r in got if r.lang is None)  # no reference, so the base decides
    assert quality_rules.judge_quality(df.limit(0)).count() == 0


def test_divergence(spark):
    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m) if a)
    df = spark.createDataFrame([(p, q)], "p array<double>, q array<double>")
    assert df.select(quality_rules.js_distance(F.col("p"), F.col("q"))).first()[0] == pytest.approx(((kl(p) + kl(q)) / 2) ** 0.5)


def test_odd_text_diverges_and_clean_text_stays(spark):
    rng = random.Random(8)
    common = quality_rules.COMMON["en"]
    text = lambda: " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choices("abcdefgh", k=6)) for _ in range(200))
    rows = [(i, text(), "en") for i in range(60)] + [(100, " ".join("%%%" + str(i) + "###" for i in range(300)), "en"), (101, " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(300)), "en")]
    got = {r.id: r.kept for r in quality_rules.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got[100] and not got[101] and all(got[i] for i in range(60))


# op9


def test_tokens(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    out = new_path(spark, "test")
    got = tokens.token_table(docs, out, path).collect()
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    ids = {r.text: plain.encode(r.text or "", add_special_tokens=False).ids + [2] for r in docs.collect()}
    assert bag((r.id, r.n_tokens, r.crc) for r in got) == bag((r.doc_id, len(ids[r.text]), crc(ids[r.text])) for r in docs.collect())
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ordered = [r.id for r in sorted(got, key=lambda r: r.start)]
    assert ordered == sorted(ordered, key=lambda i: (i is not None, i or 0))
    some = tokens.read_tokens(spark, out, [2, 5]).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.id: list(r.tokens) for r in some} == {i: ids[texts[i]] for i in (2, 5)}
    assert bag((r.id, r.start, r.n_tokens) for r in tokens.read_counts(spark, out).collect()) == bag((r.id, r.start, r.n_tokens) for r in got)
    assert tokens.token_table(docs.limit(0), new_path(spark, "test"), path).count() == 0


def test_encoder_is_exact(spark, monkeypatch):
    text = open(public_tokenizers.path("byte_bpe_50k.json")).read()
    plain = Tokenizer.from_str(text)
    monkeypatch.setattr(tokens, "CACHE", 50)
    encoder = tokens.Encoder(text, 2)
    rng = random.Random(1)
    pieces = ["a", "The", "é", "ñ", "1", ".", ",", "!", "'s", "-", " ", "  ", "\n", " \n", "\n\n", "\n\n\n", "\t", "\xa0", "\u3000", "\x1c", "漢", "<|endoftext|>", "🙂", "e\u0301", "_", "\r\n", ". ", ", ", ".\n", "\x01", "\x04"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 14))) for _ in range(4000)] + ["plain words, and more. Yes.\nNext line, too"]
    for lo in range(0, len(texts), 500):
        for t, got in zip(texts[lo : lo + 500], encoder.encode(pa.array(texts[lo : lo + 500])).to_pylist()):
            assert got == plain.encode(t, add_special_tokens=False).ids + [2], repr(t)
    assert encoder.by_piece and pc.match_substring_regex(pa.array(texts), tokens.ODD).to_pylist()[-1] is False
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").select("text").toPandas()["text"].tolist()
    want = [c.ids + [2] for c in plain.encode_batch_fast(given, add_special_tokens=False)]
    assert encoder.encode(pa.array(given)).to_pylist() == want


# op10


def plain_verdict(url, rules, blocked):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = lambda h, p: (host == h or host.endswith("." + h)) and path.startswith(p)
    best = max(((len(h + p), len(h), a, h + p) for h, p, a in rules if fits(h, p)), default=None)
    bad = any(fits(h, p) for h, p in blocked)
    return host, path, best and best[3], best[2] if best else "block" if bad else "allow"


def test_urls(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("tie.com", "/a", "allow"), ("tie.com", "/a", "block"), ("deep.example.com", "/de/x", "allow")]
    blocked = [("spam.example.com", "/"), ("spam.example.org", "/"), ("page.com", "/only/this")]
    listed = ["http://WWW.Example.NET/en/1?x#y", "https://example.net/de", "http://net/", "http://xnet/", "https://a.b.deep.example.com/de/xyz", "https://deep.example.com/de/a", "http://x.org/fr/", "http://spam.example.com/q", "http://notspam.example.com/q", "http://spam.example.org/fr/1", "http://page.com/only/this/too", "http://page.com/only", "http://tie.com/abc", "nothing", "", None, "://", "http://", "http://h?q=http://net/", "http://é.net/p", "HTTP://A:80/b://c", "http://x.net", "https://spam.example.com#top", "http://net/" + "y" * 5000]
    rows = [(i, u, "c", "c", "c") for i, u in enumerate(listed + listed[:3])]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule string, key string")
    args = spark.createDataFrame(rules, "host string, path string, action string"), spark.createDataFrame(blocked, "host string, path string")
    got = bag((r.id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, *args).collect())
    assert got == bag((i, *plain_verdict(u, rules, blocked)) for i, u, *_ in rows)
    none = urls.judge(df, args[0].limit(0), args[1].limit(0)).collect()
    assert {r.verdict for r in none} == {"allow"} and len(none) == len(rows)
    assert urls.judge(df.limit(0), *args).count() == 0


def test_long_hosts_and_long_lists(spark):
    long = "http://" + "a." * 40_000 + "spam7.example.com/p/" + "y" * 20_000
    urls_given = [long, long.replace("spam7", "clean"), "http://x.spam99.example.com/list/99/a", "http://spam99.example.com/list/98", "http://spam99.example.com", "http://.com/", "http://./"]
    df = spark.createDataFrame(list(enumerate(urls_given)), "page_id long, url string")
    blocked = spark.range(100_000).select(F.concat(F.lit("spam"), "id", F.lit(".example.com")).alias("host"), F.when(F.col("id") == 7, "/p").otherwise(F.concat(F.lit("/list/"), "id")).alias("path"))
    blocked = blocked.unionByName(spark.createDataFrame([(None, "/"), ("x.com", None)], "host string, path string"))
    rules = spark.createDataFrame([("com", "/", "allow")], "host string, path string, action string")
    got = {r.id: (r.listed, r.rule, r.verdict) for r in urls.judge(df, rules, blocked).collect()}
    assert got == {0: (True, "com/", "allow"), 1: (False, "com/", "allow"), 2: (True, "com/", "allow"), 3: (False, "com/", "allow"), 4: (False, None, "allow"), 5: (False, "com/", "allow"), 6: (False, None, "allow")}
    assert {r.id for r in urls.judge(df, rules.limit(0), blocked).where("verdict = 'block'").collect()} == {0, 2}


def test_list_from_pages(spark):
    given = ["http://www.bad-x.example.com/de/1.html", "http://bad-x.example.com/de/1/", "https://m.bad-x.example.com", "http://good.example.com/de/1", "http://notbad-x.example.com/", None]
    found = urls.sites_named(spark.createDataFrame(list(enumerate(given)), "page_id long, url string"), ("bad-x",))
    assert bag((r.host, r.path) for r in found.collect()) == Counter([("bad-x.example.com", "/de/1"), ("bad-x.example.com", "")])


def test_bloom_has_no_false_negative(spark):
    keys = spark.range(3000).select(F.concat(F.lit("host"), "id", F.lit("/")).alias("key"))
    bloom = urls.bloom_blocks(keys, 128)
    block, bits = urls.probe(F.col("key"), 128)
    every = F.forall(F.zip_with("bits", "filter", lambda b, f: b.bitwiseAND(f) == b), lambda x: x)
    hits = lambda k: k.withColumn("block", block).withColumn("bits", bits).join(bloom, "block").where(every).count()
    assert hits(keys) == 3000
    assert hits(keys.select(F.concat("key", F.lit("x")).alias("key"))) < 150


def test_digests(spark, docs):
    from sumac.llm.registry import QUERIES

    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert hashlib.sha256(b"").hexdigest() and json
