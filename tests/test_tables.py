"""Ingest, samples, retrieval, faults, attribution, certificates, statistics and runs on small tables."""

import hashlib
import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sumac.operators import aggregates as A
from sumac.operators import attribution, cells, corpus, coverage, extraction, faults, lexical, retrieval, runs, sketches, stats
from sumac.operators import predicates as P
from sumac.plans import templates, workload
from sumac.sources import ingest, readers, sinks
from sumac.streaming import ingest as stream


def raw(**fields):
    return json.dumps({"asin": "B000000001", "title": "A title", "main_category": "Books", "average_rating": 4.5, "rating_number": 3, "price": "$1,234.50", "timestamp": "2021-05-01T10:00:00Z"} | fields)


RAW = [
    raw(),
    raw(),
    raw(asin="B2", timestamp="yesterday"),
    raw(asin="B3", price=None),
    raw(asin=""),
    raw(asin="B4", title="Größe ✓", surprise=1),
    raw(asin="B5", title="x" * 368),
    raw(asin="B6", average_rating=6.5),
    raw(asin="B7", main_category=None),
    "{not json",
]


def lines(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "row_index long, line string")


def test_ingest_counts(spark):
    got = ingest.ingest(readers.parse_lines(lines(spark, RAW)))
    r = got["report"].first()
    assert (r.rows_read, r.accepted, r.duplicates, r.rejected, r.malformed) == (10, 5, 1, 4, 1)
    assert r.accepted + r.duplicates + r.rejected == r.rows_read
    assert {x.reason: x.n for x in got["reasons"].collect()} == {"json_parse_error": 1, "missing_or_empty_asin": 1, "malformed_timestamp": 1, "invalid_rating": 1}
    by = {x.product_id: x for x in got["records"].collect()}
    assert by["B7"].category == "Office Products" and by["B3"].price is None and len(by["B5"].title) == 368
    assert by["B4"].attributes["extra_field_count"] == "1" and float(by["B000000001"].price) == 1234.5
    assert by["B000000001"].record_id == "amz_d_B000000001_00000000"
    assert "text" not in got["rejects"].columns and "line" not in got["rejects"].columns


def test_times_tell_numbers_from_texts(spark):
    rows = [raw(asin=f"T{i}", timestamp=t) for i, t in enumerate([1609459200, "1609459200", "2021-01-01 00:00:00", "2021-01-01", "2021-01-01T02:00:00+02:00", None, 1e30, True])]
    got = {r.product_id: r.event_time for r in ingest.canonicalize(readers.parse_lines(lines(spark, rows))).collect()}
    assert [got[f"T{i}"] is not None for i in range(8)] == [True, False, True, True, True, False, False, False]
    assert len({got[f"T{i}"] for i in (0, 2, 3, 4)}) == 1


def test_values(spark):
    rows = [raw(asin=f"V{i}", **x) for i, x in enumerate([{"price": "-1"}, {"price": "abc"}, {"verified_purchase": "Yes"}, {"verified_purchase": False}, {"rating_number": "7.9"}, {"rating_number": -5}, {"title": " "}, {"brand": " ", "store": "S"}, {"main_category": "x", "categories": ["Books", "y"]}])]
    got = {r.product_id: r for r in ingest.canonicalize(readers.parse_lines(lines(spark, rows))).collect()}
    assert got["V0"].price is None and got["V1"].price is None
    assert [got[f"V{i}"].verified_purchase for i in (0, 2, 3)] == [True, True, False]
    assert (got["V4"].helpful_votes, got["V5"].helpful_votes) == (7, 0)
    assert got["V6"].title == "[No Title] V6" and got["V7"].brand == "S" and got["V8"].category == "Books"


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(RAW) + "\n\n")
    assert readers.load_raw(spark, str(tmp_path / "a.jsonl")).count() == 10
    with pytest.raises(readers.TooLarge):
        readers.load_raw(spark, str(tmp_path / "a.jsonl"), max_bytes=100)
    with pytest.raises(ValueError):
        readers.load_raw(spark, str(tmp_path / "a.xml"))
    with pytest.raises(ValueError):
        readers.load_worlds(spark, {"scales": [50, 10]})
    assert readers.load_worlds(spark, {"scales": [10, 50]}).count() == 2
    (tmp_path / "q.jsonl").write_text(json.dumps({"query_id": "q", "scope": P.to_dict(P.Eq("brand", "x"))}))
    assert readers.load_queries(spark, str(tmp_path / "q.jsonl"))[0]["scope"] == P.Eq("brand", "x")


@pytest.mark.parametrize("size", ["64b", "1mb"])
def test_rows_are_numbered_by_file_and_line(spark, tmp_path, size):
    """However the files are split."""
    given = [[f'{{"asin": "{f}{k}"}}' for k in range(40)] for f in "abc"]
    for f, rows in zip("abc", given):
        (tmp_path / f"{f}.jsonl").write_text("\n".join(rows) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = {r.row_index: r.asin for r in readers.load_raw(spark, str(tmp_path), "json").collect()}
        plain = readers.load_raw(spark, str(tmp_path), "csv").agg(F.count("*"), F.count_distinct("row_index"), F.max("row_index")).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {k: json.loads(line)["asin"] for k, line in enumerate(sum(given, []))}
    assert plain[0] == plain[1] == plain[2] + 1


def test_edges_join_neighbours_of_a_group(spark):
    rng = random.Random(5)
    rows = [(f"r{i:04d}", rng.choice(["hot", "hot", "hot", "b", None])) for i in range(500)]
    want = {g: sorted(i for i, x in rows if x == g) for g in ("hot", "b", None)}
    got = retrieval.consecutive_edges(spark.createDataFrame(rows, "record_id string, g string").repartition(7), "g").collect()
    assert Counter(map(tuple, got)) == Counter(p for ids in want.values() for p in zip(ids, ids[1:]))


def test_stream_equals_batch(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    rng = random.Random(1)
    rows = [raw(asin=f"S{rng.randint(0, 60)}", average_rating=rng.choice([3, 4, 9])) for _ in range(150)]
    for k in range(3):
        (source / f"{k}.txt").write_text("\n".join(rows[50 * k : 50 * k + 50]))
    for _ in range(2):  # the second start finds nothing new
        stream.start(stream.read_lines(spark, str(source), 1), out, str(tmp_path / "state")).awaitTermination()
    got = sorted(r.product_id for r in spark.read.parquet(f"{out}/records").collect())
    want = sorted(r.product_id for r in ingest.ingest(readers.parse_lines(lines(spark, rows)))["records"].collect())
    assert got == want


def test_stream_keeps_ids_as_state(spark, tmp_path):
    """Later files meet the ids of earlier ones without their output, which is moved away; a batch that runs again gives the same."""
    source, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    source.mkdir()
    ids = lambda: sorted(r.product_id for r in spark.read.parquet(str(out / "records")).collect())
    run = lambda: stream.start(stream.read_lines(spark, str(source)), str(out), str(state)).awaitTermination()
    run()  # no file yet
    (source / "a.txt").write_text("\n".join(raw(asin=f"A{i % 20}", title=f"t{i}") for i in range(40)))
    run()
    assert ids() == sorted(f"A{i}" for i in range(20)) and {r.title for r in spark.read.parquet(str(out / "records")).collect()} == {f"t{i}" for i in range(20)}
    (out / "records").rename(tmp_path / "moved")
    (out / "staged" / "epoch=0").rename(tmp_path / "staged")
    (source / "b.txt").write_text("\n".join(raw(asin=f"A{i}") for i in range(15, 25)))
    run()
    assert ids() == sorted(f"A{i}" for i in range(20, 25))
    commits = sorted((p for p in (state / "accepted" / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    run()
    assert ids() == sorted(f"A{i}" for i in range(20, 25))


def test_bundle_notices_changes(spark, tmp_path):
    path = str(tmp_path / "bundle")
    sinks.write_bundle(spark.range(5), path)
    assert {r.state for r in sinks.verify_bundle(spark, path).collect()} == {"ok"}
    name = next((tmp_path / "bundle/metrics").glob("part-*"))
    for crc in (tmp_path / "bundle/metrics").glob(".*.crc"):
        crc.rename(tmp_path / crc.name)
    name.write_text(name.read_text() + "99\n")
    (tmp_path / "bundle/metrics/part-extra.csv").write_text("id\n1\n")
    assert {r.state for r in sinks.verify_bundle(spark, path).collect()} >= {"changed", "unlisted"}


@pytest.fixture(scope="module")
def made(spark):
    return corpus.synthetic(spark, 600).persist()


def test_samples(spark, made):
    ids = lambda df: {r.record_id for r in df.select("record_id").collect()}
    small, large = corpus.nested_sample(made, 50), corpus.nested_sample(made, 300)
    assert ids(small) < ids(large) and ids(corpus.nested_sample(made.repartition(9), 50)) == ids(small)
    assert [r.nested for r in corpus.verify_nesting([("s", small), ("l", large), ("all", made)]).collect()] == [True, True]
    broken = corpus.verify_nesting([("l", large), ("s", small)]).first()
    assert broken.missing == 250 and len(broken.sample.split(",")) == 5
    want = {r.category: math.ceil(0.1 * r["count"]) for r in made.groupBy("category").count().collect()}
    assert {r.category: r["count"] for r in corpus.stratified_sample(made, 0.1).groupBy("category").count().collect()} == want
    assert not ids(corpus.fraction_sample(made, 0.8)) & ids(corpus.holdout(made, 0.2))
    assert ids(corpus.synthetic(spark, 100)) < ids(made)
    d = corpus.divergence(made, made.where("category <> 'Books'")).first()
    assert d.new_categories == 1 and d.new_rows + d.preserved_rows == 600
    assert corpus.checksum(made).first() == corpus.checksum(made.repartition(5)).first()
    for name, f in corpus.SLICES.items():
        assert ids(f(made)) <= ids(made), name


@pytest.mark.parametrize("part", [10_000, 3])
def test_samples_by_counting(spark, monkeypatch, part):
    """Against a plain sort: a hot stratum, a null one, strata of one row; few rounds and many; more wanted than there are; none."""
    monkeypatch.setattr(corpus, "PART_ROWS", part)
    monkeypatch.setattr(corpus, "TOP_ROWS", 10)
    rows = [(f"r{i}", "hot" if i % 10 else (None if i % 20 else f"c{i % 7}")) for i in range(4000)] + [("alone", "one")]
    df = spark.createDataFrame(rows, "record_id string, category string").repartition(5).persist()
    key = lambda x: (hashlib.sha256(f"42|{x[0]}".encode()).hexdigest(), x[0])
    order = sorted(rows, key=key)
    assert sorted(map(tuple, corpus.nested_sample(df, 700).collect())) == sorted(order[:700])
    assert corpus.nested_sample(df, 9999).count() == 4001 and corpus.nested_sample(df.where("FALSE"), 50).count() == 0
    want = [x for g in {c for _, c in rows} for s in [[x for x in order if x[1] == g]] for x in s[: math.ceil(0.05 * len(s))]]
    sample = corpus.stratified_sample(df, 0.05)
    assert Counter(map(tuple, sample.collect())) == Counter(want)
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort " not in plan
    assert corpus.stratified_sample(df, 0.0).count() == 0


def test_rows_of_one_id_stay_together(spark, monkeypatch):
    """Also where the part cannot become small because all its rows have one id."""
    monkeypatch.setattr(corpus, "PART_ROWS", 3)
    df = spark.createDataFrame([("same", "a")] * 20 + [("other", "a")], "record_id string, category string")
    assert corpus.stratified_sample(df, 0.01).groupBy("record_id").count().collect() in ([("same", 20)], [("other", 1)])


def test_distinct_sketches_merge(spark):
    """Within three standard errors; sketches by day, by week and of all rows at once unite to the same estimate; nulls do not count."""
    rows = spark.range(60_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 70).alias("day"), F.when(F.col("id") % 5 > 0, F.col("id") % 20_000).alias("v"))
    exact = {r.g: r.n for r in rows.groupBy("g").agg(F.count_distinct("v").alias("n")).collect()}
    by_day = sketches.distinct_sketches(rows, {"g": F.col("g"), "day": F.col("day")}, "v")
    by_week = sketches.merged(by_day.withColumn("week", F.floor(F.col("day") / 7)), ["g", "week"]).drop("estimate")
    whole = sketches.distinct_sketches(rows, {"g": F.col("g")}, "v")
    got = [{r.g: r.estimate for r in sketches.merged(x, ["g"]).collect()} for x in (by_day, by_week, whole)]
    assert got[0] == got[1] == got[2]
    assert all(abs(x[g] - n) <= sketches.ERROR * n for x in got for g, n in exact.items())
    few = sketches.merged(sketches.distinct_sketches(rows.where("v < 20"), {"g": F.col("g")}, "v"), ["g"])
    assert {r.estimate for r in few.collect()} == {16}


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "red apple"), (2, "red red car"), (3, "blue car"), (4, ""), (5, None)], "doc long, text string")
    asked = spark.createDataFrame([(1, "red apple"), (2, ""), (3, "nothing here")], "query_id long, text string")
    top = lexical.bm25_top(lexical.bm25_index(docs, "doc", "text"), asked, 3).collect()
    by = {q: [(r.unit, r.score) for r in sorted(top, key=lambda r: r.rank) if r.query_id == q] for q in (1, 2, 3)}
    assert by[1][0][0] == 1 and by[1][0][1] > by[1][1][1] and [u for u, _ in by[2]] == [1, 2, 3] and {s for _, s in by[3]} == {0.0}
    cand = spark.createDataFrame([(1, "a", 1, 60), (1, "b", 2, 50), (1, "c", 3, 40), (1, "d", 4, 1)], "query_id long, unit string, rank int, tokens long")
    packed = retrieval.pack_context(cand, 100).first()
    assert (packed.units, packed.tokens, packed.dropped) == ("a,c", 100, 2)  # b does not fit and is skipped
    pieces = retrieval.chunk(spark.createDataFrame([("abcdefghij",), ("abc",), ("",)], "text string"), 4, 1).collect()
    assert [r.chunk_text for r in pieces] == ["abcd", "defg", "ghij", "abc", ""]
    with pytest.raises(ValueError):
        retrieval.chunk(docs, 4, 4)
    numbered = retrieval.row_numbers(spark.range(1000).repartition(7), ["id"]).collect()
    assert all(r.id == r.row for r in numbered)
    vec = docs.select(retrieval.hash_embedding(F.col("text")).alias("v")).first().v
    assert sum(x * x for x in vec) == pytest.approx(1) and len(vec) == 16


def near_pairs(df):
    return {(r.query_id, r.unit) for r in df.collect()}


def test_cells_find_nine_in_ten(spark):
    """Against all pairs: the given vectors, with little structure, and clustered ones, where a small part is enough."""
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rng = random.Random(4)
    middles = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(30)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in middles[0 if i % 3 == 0 else i % 30]]) for i in range(3000)]  # a third in one place
    clustered = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for df, most in ((given, 0.8), (clustered, 0.6)):
        q = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
        index = cells.cell_index(df)
        want, got = near_pairs(retrieval.dense_top(df, q, 10)), near_pairs(cells.cell_top(index, q, 10))
        assert len(got & want) >= 0.9 * len(want) and len(got) == len(want)
        assert index.share < most and index.rows.count() == df.count()
        assert near_pairs(cells.cell_top(index, q, 10, share=1.0)) == want


def test_cells_of_odd_tables(spark, monkeypatch):
    """Nulls, other lengths, repeated rows, one row, none; slices of a hot cell; more probes than are sent."""
    odd = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [1.0]), (6, [0.0, 1.0]), (None, [0.5, 0.5])]
    df = spark.createDataFrame(odd, "vec_id long, embedding array<double>")
    q = df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")).where("vec_id = 6 OR vec_id = 2 OR vec_id = 5")
    top = lambda d, k=10: [(r.query_id, r.unit, r.score) for r in cells.cell_top(cells.cell_index(d), q, k).orderBy("query_id", "rank").collect()]
    assert [x for x in top(df) if x[0] == 6] == [(6, 6, 1.0), (6, None, 0.5), (6, 1, 0.0), (6, 1, 0.0)]
    assert top(df.where("vec_id = 6")) == [(6, 6, 1.0)] and top(df.where("vec_id = 99")) == []
    monkeypatch.setattr(cells, "SLICE_ROWS", 3)
    monkeypatch.setattr(cells, "SENT_ROWS", 1)
    same = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(40)], "vec_id long, embedding array<double>")
    assert [x[1:] for x in top(same, 5)] == [(i, 1.0) for i in (1, 3, 5, 7, 9)]


def plain_bm25(units, asked, k, allowed=None):
    """Every unit scored for every query, by the formula."""
    tokens = lambda t: [x for x in re.split("[^a-z0-9]+", (t or "").lower()) if len(x) > 1]
    docs: dict = {}
    for u, t in units:
        docs.setdefault(u, Counter()).update(tokens(t))
    n, mean = len(docs), sum(c.total() for c in docs.values()) / len(docs)
    df = Counter(t for c in docs.values() for t in c)
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    low = 0.25 * sum(raw.values()) / len(raw)
    out = {}
    for q, text in asked:
        scores = []
        for u, c in docs.items():
            if allowed is None or u in allowed:
                s = sum(times * (low if raw[t] < 0 else raw[t]) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * c.total() / mean)) for t, times in Counter(tokens(text)).items() if c[t])
                scores.append((-round(s, 9), u))
        out[q] = [(u, -s) for s, u in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("size, common", [(4096, 0.0), (16, 0.0), (16, 0.9)])
def test_bm25_is_that_of_all_pairs(spark, monkeypatch, size, common):
    """One range and many, ties, repeated units, a filter; with words in most units the mean idf is negative and so are scores."""
    monkeypatch.setattr(lexical, "RANGE", size)
    rng = random.Random(4)
    vocabulary = ["w%d" % i for i in range(300)] if not common else ["aa", "bb", "cc"]
    line = lambda: " ".join(vocabulary[min(int(rng.expovariate(0.02)), len(vocabulary) - 1)] for _ in range(rng.randint(1, 40)) if not common or rng.random() < common)
    units = [(i, line()) for i in range(200)] + [(5, "again w1 w2"), (300, None), (301, ""), (302, "w1 w2 w3"), (303, "w1 w2 w3")]
    asked = [(1, "w1 w2 w3 w3"), (2, "w250 aa"), (3, ""), (4, None), (5, "nothing like it"), (6, line()), (7, "W100 w5! bb")]
    frame = spark.createDataFrame(units, "unit long, text string").repartition(3)
    queries = spark.createDataFrame(asked, "query_id long, text string")
    index = lexical.bm25_index(frame, "unit", "text")
    for allowed in (None, set(range(0, 400, 3))):
        only = None if allowed is None else spark.createDataFrame([(u,) for u in allowed], "unit long")
        got = {}
        for r in sorted(lexical.bm25_top(index, queries, 7, units=only).collect(), key=lambda r: r.rank):
            got.setdefault(r.query_id, []).append((r.unit, round(r.score, 9) + 0.0))
        want = plain_bm25(units, asked, 7, allowed)
        assert {q: [(u, round(s, 7)) for u, s in v] for q, v in got.items()} == {q: [(u, round(s, 7) + 0.0) for u, s in v] for q, v in want.items()}


def test_bm25_spares_postings(spark, monkeypatch):
    """Of queries with rare and very common terms less than a third of the postings are scored, and the lists are not exchanged."""
    monkeypatch.setattr(lexical, "RANGE", 500)
    rng = random.Random(8)
    word = lambda: "w%d" % int(1.2 ** rng.uniform(0, 45))
    units = spark.createDataFrame([(i, f"r{i % 97} " + " ".join(word() for _ in range(30))) for i in range(3000)], "unit long, text string")
    asked = [(q, f"r{q} r{q + 40} w1 w2 w3 {word()}") for q in range(20)]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    index = lexical.bm25_index(units, "unit", "text")
    found = lexical.bm25_found(index, queries, 3)
    scored = found.agg(F.sum("scored")).first()[0]
    terms = queries.select("query_id", F.explode(retrieval.tokenize(F.col("text"))).alias("term")).distinct()
    every = index.lists.join(terms, "term").agg(F.sum("n")).first()[0]
    assert 0 < 3 * scored < every
    plan = index.lists.groupBy("range").cogroup(index.dl.groupBy("range")).applyInArrow(lambda k, a, b: a, "range int")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_extraction(spark):
    attempts = spark.createDataFrame([("a", 0, False, "x"), ("a", 1, True, "y"), ("b", 0, True, "z"), ("c", 0, False, "n"), ("c", 3, True, "late")], "batch string, attempt int, ok boolean, result string")
    got = {r.batch: (r.result, r.repairs, r.failed) for r in extraction.first_good(attempts).collect()}
    assert got == {"a": ("y", 1, False), "b": ("z", 0, False), "c": (None, 0, True)}
    responses = spark.createDataFrame([("g", json.dumps({"records": [{"record_id": "1", "in_scope": True, "price": 2.5}, {"record_id": "2"}]})), ("bad", "{oops"), ("none", None)], "batch string, response string")
    rows, failed = extraction.parse(responses, {"price": "double"})
    assert rows.count() == 2 and {r.batch for r in failed.collect()} == {"bad", "none"} and extraction.in_scope(rows).count() == 1


def test_faults_repeat(spark, made):
    q = [A.Query("n", A.Count(), P.Eq("category", "Books")), A.Query("top", A.TopK("brand", 3)), A.Query("m", A.Mean("rating"), P.Range("rating", 2.0, 4.0))]
    key = lambda df: sorted(map(str, df.collect()))
    assert key(faults.run_pipelines(made, q)) == key(faults.run_pipelines(made.repartition(11), q))
    bad = faults.fact_fault(made, faults.FACTS)
    assert bad.columns == made.columns and bad.where("rating < 1 OR rating > 5 OR price < 0").count() == 0
    both = made.select("record_id", "verified_purchase").join(bad.select("record_id", F.col("verified_purchase").alias("v")), "record_id")
    assert 0.2 < both.where("v <> verified_purchase").count() / 600 < 0.4
    assert bad.where("price IS NULL").count() == made.where("price IS NULL").count()
    assert faults.scope_fault(P.And((P.Eq("brand", "a"), P.IsNull("price"))), "q", "b") == P.Eq("brand", "a")
    assert faults.scope_fault(P.Eq("category", "Books"), "q", "Sports") == P.Eq("category", "Sports")
    assert len(faults.scope_fault(P.In("brand", ("a", "b", "c")), "q").values) == 2
    drawn = [faults.other_values(made, [A.Query(f"q{i}", A.Count(), P.Eq("category", "Books"))])[f"q{i}"] for i in range(12)]
    assert "Books" not in drawn and len(set(drawn)) > 2
    scores = attribution.interventions(made, q, ["clean", "wrong_scope", "wrong_aggregation"])
    for r in attribution.shapley(scores, ["pipeline_id", "query_id"]).collect():
        assert r.phi_r + r.phi_e + r.phi_a + r.interaction == pytest.approx(r.recoverable, abs=1e-4)
        if r.pipeline_id == "clean":
            assert r.dominant == "none"
        elif r.loss > 0:
            assert r.dominant == {"wrong_scope": "scope", "wrong_aggregation": "aggregation"}[r.pipeline_id]


def test_shapley_of_one_wrong_stage(spark):
    rows = spark.createDataFrame([("x", s, 0.0 if "R" in s else 1.0) for s in attribution.SUBSETS], "run string, subset string, loss double")
    r = attribution.shapley(rows, ["run"]).first()
    assert (r.phi_r, r.phi_e, r.phi_a, r.interaction, r.dominant) == (1.0, 0.0, 0.0, 0.0, "scope")


def test_losses(spark):
    gold = spark.createDataFrame([("s", 1, None, 10.0), ("n", 1, None, None), ("t", 1, "a", 1.0), ("t", 2, "b", 1.0)], "query_id string, rank int, key string, value double")
    kind = F.when(F.col("query_id") == "t", "TopK").otherwise("Mean")
    answers = spark.createDataFrame([("r", "s", 1, None, 8.0), ("r", "n", 1, None, None), ("r", "t", 1, "b", 1.0), ("r", "t", 2, "c", 1.0), ("e", "s", 1, None, None)], "run_id string, query_id string, rank int, key string, value double")
    got = {(r.run_id, r.query_id): (round(r.loss, 6), r.status) for r in attribution.losses(answers, gold, kind).collect()}
    assert got == {("r", "s"): (0.2, "scored"), ("r", "n"): (0.0, "scored"), ("r", "t"): (0.666667, "scored"), ("e", "s"): (1.0, "abstained")}


def test_certificates(spark):
    rows = [("full", 10, 10, 10, 0, 0, 0, True), ("nine", 10, 10, 9, 0, 0, 0, True), ("unknown", None, 10, 10, 0, 0, 0, True), ("empty", 0, 0, 0, 0, 0, 0, True), ("silent", 10, 10, 10, 0, 0, 0, False), ("unclear", 200, 200, 200, 0, 40, 0, True)]
    seen = spark.createDataFrame(rows, "run_id string, eligible long, retrieved long, extracted long, with_null long, ambiguous long, repairs long, has_answer boolean")
    got = {r.run_id: (r.decision, list(r.reasons)) for r in coverage.certify(seen, coverage.policy_table(spark, [coverage.Policy("strict")])).collect()}
    assert got == {
        "full": ("certified", []), "nine": ("abstain", ["EXTRACTION_ROWS_MISSING"]), "unknown": ("uncertified", ["SCOPE_UNKNOWN"]),
        "empty": ("certified", []), "silent": ("abstain", []), "unclear": ("abstain", ["EXTRACTION_AMBIGUOUS"]),
    }


def test_statistics(spark):
    pair = lambda a, b: spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(a, b))], "i long, a double, b double")
    same = stats.effect(pair([1.0, 2.0], [1.0, 2.0])).first()
    assert (same.mean_difference, same.cohens_d) == (0.0, 0.0)
    assert stats.effect(pair([1.0] * 5, [0.0] * 5)).first().mean_difference == 1.0
    rng = random.Random(1)
    b = stats.bootstrap_interval(pair([rng.gauss(1, 1) for _ in range(200)], [0.0] * 200), ["i"], 300).first()
    assert b.low < b.mean_difference < b.high and 0.15 < b.high - b.low < 0.45
    few = pair([3.0, 1.0, 4.0, 1.0, 5.0], [0.0] * 5)
    e, p = stats.resampled_interval(few, ["i"], 400).first(), stats.bootstrap_interval(few, ["i"], 400).first()
    assert e == stats.resampled_interval(few.repartition(3), ["i"], 400).first() and e.mean_difference == pytest.approx(2.8)
    draw = lambda r, k: int(int(hashlib.sha256(f"42|{r}|{k}".encode()).hexdigest()[:13], 16) / 16**13 * 5)
    means = sorted(sum([3.0, 1.0, 4.0, 1.0, 5.0][draw(r, k)] for k in range(5)) / 5 for r in range(1, 401))
    at = lambda q: means[int(q * 399)] + (q * 399 - int(q * 399)) * (means[int(q * 399) + 1] - means[int(q * 399)])
    assert (e.low, e.high) == (pytest.approx(at(0.025)), pytest.approx(at(0.975))) and max(e.low, p.low) < min(e.high, p.high)
    assert tuple(stats.resampled_interval(few.where("FALSE"), ["i"], 10).first()) == (None, None, None)
    tests = spark.createDataFrame([("a", 0.005), ("b", 0.012), ("c", 0.045), ("d", 0.230)], "test string, p double")
    assert [r.reject for r in stats.holm(tests).orderBy("rank").collect()] == [True, True, False, False]
    k = stats.cohens_kappa(spark.createDataFrame([(1, 1), (0, 0), (1, 0), (None, 1)], "a int, b int"), "a", "b").first()
    assert k.n == 3 and k.kappa == pytest.approx(0.4)
    assert stats.cohens_kappa(spark.createDataFrame([], "a int, b int"), "a", "b").first().kappa == 0.0
    ratings = spark.createDataFrame([(i, r, x) for i, xs in enumerate([(1, 1), (0, 0), (1, 0), (1, None)]) for r, x in enumerate(xs)], "item_id long, rater_id long, label int")
    assert stats.krippendorff_alpha(ratings).first().alpha == pytest.approx(1 - (2 / 6) / (18 / 30), abs=1e-6)
    assert [r.conflict for r in stats.annotation_progress(ratings).orderBy("item_id").collect()] == [False, False, True, False]


def test_runs(spark):
    jobs = spark.createDataFrame([("a",), ("b",), ("c",)], "job_id string")
    done = spark.createDataFrame([("a", "completed"), ("b", "failed")], "job_id string, status string")
    assert {r.job_id for r in runs.to_do(jobs, done).collect()} == {"b", "c"}
    assert [r.id for r in runs.page(spark.range(10), ["id"], 2, 3).collect()] == [3, 4, 5]
    with pytest.raises(ValueError):
        runs.page(spark.range(3), ["id"], 0, 10)


def test_workload(spark, made):
    ts = templates.TEMPLATES
    assert len(ts) == 100 == len({t.template_id for t in ts}) and {t.template_id for t in ts} == set(templates.MAKERS)
    assert Counter(t.family for t in ts) == {"count": 20, "mean": 15, "proportion": 20, "comparison": 15, "topk": 15, "trend": 15}
    queries = workload.workload(made)
    assert len({A.spec_hash(q) for q in queries}) == len(queries) > 100
    assert {q.query_id for q in workload.workload(made.repartition(3))} == {q.query_id for q in queries}
    assert {workload.split_of(A.spec_hash(q)) for q in queries} == {"dev", "val", "test"}
    df = workload.with_shares(made)
    some = queries[::9]
    assert {r.query_id for r in A.evaluate_batch(df, some).collect()} <= {q.query_id for q in some}
    assert all("{" not in q.tags["question"] for q in queries)
    text = templates.Draws("cmp_q1_q2_count", 0, 42, {"category": ("Books", "Sports"), "year": ("2021", "2022")})
    spec, scope = templates.MAKERS["cmp_q1_q2_count"](text)
    assert spec.a == P.Range("event_time", "2021-01-01T00:00:00Z", "2021-04-01T00:00:00Z", high_open=True) and scope.parts[0] == P.Eq("category", "Books")
    assert workload.build(templates.TEMPLATES[1], templates.Draws("cnt_cat_verified", 0, 42, {})) is None
    assert workload.workload(made.limit(0)) and not [q for q in workload.workload(made.limit(0)) if q.tags["template_id"] != "cnt_empty_scope"]


def test_pack_counts_agreement(spark):
    """Of queries that agree, that differ, and that no side has a row of."""
    kinds = "query_id string, spec_hash string, split string, template_id string, family string, difficulty string, question string"
    table = spark.createDataFrame([(f"q{i}", "h", "dev", "t", "mean", "easy", "?") for i in range(4)], kinds)
    states = spark.createDataFrame([("q0", "agreed"), ("q1", "agreed"), ("q2", "disagreed"), ("other", "agreed")], "query_id string, status string")
    found = {(r.dimension, r["key"]): r.n for r in workload.pack(table, states).collect()}
    assert {k: n for k, n in found.items() if k[0] == "agreement"} == {("agreement", "agreed"): 2, ("agreement", "disagreed"): 1, ("agreement", "no_rows"): 1}
    assert found["split", "dev"] == found["family", "mean"] == 4
