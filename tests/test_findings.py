"""What a review of the queries on larger tables found."""

import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from sumac.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def rows_of(spark, name, sf_dir=SF):
    return sorted(map(tuple, QUERIES[name](spark, str(sf_dir)).collect()), key=str)


def rows_by_sql(name, sf_dir=SF):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        path = f"{sf_dir}/{f}"
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return sorted(con.execute(SQL[name]).fetchall(), key=str)


def test_queries_read_what_they_wrote_at_any_size(spark, monkeypatch):
    """folders beyond the limit of bytes for files from outside."""
    from sumac.sources import readers

    monkeypatch.setattr(readers, "input_bytes", lambda *_: readers.MAX_BYTES + 1)
    for name in ("s04_json_lines", "s05_json_gz", "s06_csv", "s07_parquet_raw", "s08_reader_by_extension"):
        assert rows_of(spark, name) == rows_by_sql(name)


def test_inspect_counts_files_whatever_the_layout_of_its_input(spark, tmp_path):
    """the statement said one file, and a table in several files had more."""
    spark.range(-1500, 3500).selectExpr("id AS doc_id", "'t' AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert rows_of(spark, "i19_inspect", tmp_path) == rows_by_sql("i19_inspect", tmp_path) == [(6, 5000)]


def test_inner_products_by_matrices_are_those_by_pairs(spark, monkeypatch):
    """nulls, other lengths, copies, ties, infinite and huge components, more queries than a block."""
    import random
    from functools import cmp_to_key

    from sumac.operators import inner, retrieval

    monkeypatch.setattr(retrieval, "SENT_ROWS", 7)
    monkeypatch.setattr(inner, "ROWS", 16)
    monkeypatch.setattr(inner, "QUERIES", 3)
    monkeypatch.setattr(inner, "PAIRS", 10)
    rng = random.Random(3)
    vectors = [(i, [rng.choice([-1.0, -0.5, 0.1, 0.7, 1.3]) for _ in range(4)]) for i in range(300)]
    vectors += [(300 + i, [1.3] * 4) for i in range(50)] + [(400, None), (401, [1.0, None, 1.0, 1.0]), (402, [1.0] * 3), (403, [float("inf"), 0.0, 0.0, 1.0]), (404, [float("nan")] * 4), (405, [1e200] * 4), (406, [])]
    some = [(i, v) for i, v in vectors if i % 20 == 0 or i > 398]
    got = retrieval.dense_top(spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3), spark.createDataFrame(some, "query_id long, vector array<double>"), 5)
    want = []
    bigger = lambda a, b: (a != a) - (b != b) or (a > b) - (a < b)
    for query_id, q in some:
        pairs = []
        for unit, v in vectors:
            score = None
            if v is not None and q is not None and len(v) == len(q) and None not in v and None not in q:
                score = 0.0
                for a, b in zip(v, q):
                    score += a * b
                score = score if score != score or abs(score) > 1e15 else round(score, 9)
            pairs.append((score, unit))
        order = lambda x, y: (x[0] is None) - (y[0] is None) or (0 if x[0] is None else -bigger(x[0], y[0])) or (x[1] > y[1]) - (x[1] < y[1])
        want += [(query_id, unit, repr(score), rank + 1) for rank, (score, unit) in enumerate(sorted(pairs, key=cmp_to_key(order))[:5])]
    assert sorted((r.query_id, r.unit, repr(r.score), r.rank) for r in got.collect()) == sorted(want)


def test_dense_search_does_not_sum_pairs_in_the_plan(spark):
    """no product of vectors and queries as rows."""
    for name in ("r09_dense_top", "r09_dense_cells"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "zip_with" not in plan and "Join Cross" not in plan


def test_the_join_behind_the_records_is_done_once_for_all_stages(spark):
    """Every pass over right or wrong records joined lineitem and part again, and drew the wrong facts again."""
    for name in ("p05_p07_pipelines", "l01_l05_run_scores", "l06_interventions", "t08_run_matrix"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in plan


def test_stages_are_right_where_queries_name_few_columns(spark):
    from sumac.operators import aggregates as A
    from sumac.operators import faults
    from sumac.operators import predicates as P
    from sumac.operators.records import records

    df = records(spark, SF)
    queries = [A.Query("ids", A.Count("record_id")), A.Query("n", A.Count(), P.IsNull("price"))]
    got = faults.stage_answers(df, queries)
    same = lambda a, b: sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    wrong = [A.Query(q.query_id, q.aggregation, faults.scope_fault(q.scope, q.query_id)) for q in queries]
    bad = faults.fact_fault(df, faults.FACTS)
    assert same(got[""], A.evaluate_batch(df, queries)) and same(got["R"], A.evaluate_batch(df, wrong))
    assert same(got["E"], A.evaluate_batch(bad, queries)) and same(got["RE"], A.evaluate_batch(bad, wrong))


def test_tokens_are_counted_in_pieces_of_bounded_size(spark, monkeypatch):
    """A task counted the tokens of all rows that came at once, up to 10,000."""
    from sumac.operators import lexical

    docs = spark.createDataFrame([(i, None if i % 7 == 0 else " ".join(f"w{j % 11}" for j in range(i % 40))) for i in range(200)], "doc_id long, text string").coalesce(1)
    found = lambda: sorted(map(tuple, (x := lexical.bm25_index(docs, "doc_id", "text")).df.collect())) + sorted(map(tuple, x.dl.collect()), key=str)
    whole = found()
    monkeypatch.setattr(lexical, "TOKENS", 50)
    assert found() == whole and len(whole) == 11 + 200


def test_trees_are_compared_without_an_exchange_of_entries(spark):
    """entries had hashes of 64 digits, were written twice and met again by hash."""
    from sumac.operators import hashtree

    df = spark.range(3000).selectExpr("id", "CAST(id % 7 AS DOUBLE) AS x", "CASE WHEN id % 5 > 0 THEN concat('w', id % 11) END AS word")
    a = hashtree.build(df, ["id", "word"], block=64)
    b = hashtree.build(df.where("id <> 17").unionAll(df.where("id = 18")), ["id", "word"], depth=a.depth)
    assert dict(spark.table(a.entries).dtypes)["__place"] == "binary"
    found = hashtree.differences(a, b)
    assert sorted(map(tuple, found.collect())) == [(17, "w6", 1, 0, "only_a"), (18, "w7", 1, 2, "changed")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = hashtree.differences(a, b)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan and "Bucketed: false" not in plan and not re.search(r"hashpartitioning\(__block#\d+, ", plan.replace(f", {spark.conf.get('spark.sql.shuffle.partitions')})", ")"))


def test_stream_state_is_kept_without_python(spark, tmp_path):
    """a Python call for each id. Of an id in several epochs of one batch the first counts."""
    import json

    from sumac.streaming import ingest as stream

    (tmp_path / "keys").mkdir()
    seen = stream.first_seen(spark.readStream.schema(stream.KEY).parquet(str(tmp_path / "keys")))
    assert seen.isStreaming and "Pandas" not in seen._jdf.queryExecution().analyzed().toString()
    (tmp_path / "in").mkdir()
    line = lambda f, i: json.dumps({"asin": f"A{i}", "title": f"{f}", "average_rating": 4, "timestamp": "2021-05-01T10:00:00Z"})
    for f in range(4):
        (tmp_path / "in" / f"{f}.txt").write_text("\n".join(line(f, i) for i in [*range(f * 5, f * 5 + 10), f * 5]))
        os.utime(tmp_path / "in" / f"{f}.txt", (1_700_000_000 + f, 1_700_000_000 + f))
    for _ in range(2):
        stream.start(stream.read_lines(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = sorted((int(r.product_id[1:]), r.title) for r in spark.read.parquet(str(tmp_path / "out" / "records")).collect())
    assert got == [(i, str(max(0, i // 5 - 1))) for i in range(25)]


def test_layout_has_files_of_bounded_rows(spark, tmp_path, monkeypatch):
    """the number of files was fixed, so a task sorted ever more rows; and the texts of all files' rows were sorted for their ends."""
    from sumac.sources import layout

    monkeypatch.setattr(layout, "FILE_ROWS", 100)
    df = spark.range(3000).selectExpr("id", "CASE WHEN id % 9 > 0 THEN concat('t', id % 13) END AS t", "id % 17 AS k")
    layout.write_layout(df, str(tmp_path / "x"), ["t", "k"], 4)
    files = {r.file: r for r in spark.read.parquet(str(tmp_path / "x" / "files")).collect()}
    assert len(files) >= 25 and max(r.rows for r in files.values()) <= 300
    rows = spark.read.parquet(str(tmp_path / "x" / "rows")).selectExpr("_metadata.file_name AS file", "*").toPandas()
    for name, mine in rows.groupby("file"):
        texts = mine.t.dropna()
        assert tuple(files[name]) == (name, len(mine), texts.min() if len(texts) else None, texts.max() if len(texts) else None, mine.t.isna().sum(), mine.k.min(), mine.k.max(), 0)


def test_lines_are_parsed_once_for_a_filter(spark):
    """the filter of accepted rows came to lie below the parsed fields and parsed a line again for each of them."""
    from sumac.sources import ingest, readers

    rows = readers.parse_lines(spark.createDataFrame([(0, "{}")], "row_index long, line string"))
    plan = ingest.missingness(ingest.ingest(rows)["records"])._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.lower().count("parse_json(") + plan.lower().count("parsejson(") <= 2
    odd = ["{}", " \t\r\n{\"asin\": 1}", "[{}]", "null", "\"{\"", "1", "{", "{} {}", "\u00a0{}", "", None]
    got = readers.parse_lines(spark.createDataFrame(list(enumerate(odd)), "row_index long, line string")).orderBy("row_index").collect()
    old = [spark.sql("SELECT coalesce(schema_of_variant(try_parse_json(:x)) LIKE 'OBJECT%', FALSE)", args={"x": x}).first()[0] for x in odd if x is not None] + [False]
    assert [not r.malformed for r in got] == old and old[:3] == [True, True, False]


def test_blocks_of_files_are_numbered_without_an_exchange_of_lines(spark, tmp_path):
    """rows met the first numbers of their blocks by an exchange, a task for each block."""
    from sumac.sources import readers

    (tmp_path / "x").write_text("a\nb\n")
    plan = readers.in_file_order(readers.placed(spark.read.text(str(tmp_path / "x"))))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_catalogue_joins_the_records_once(spark):
    """each pipeline joined lineitem and part again."""
    plan = QUERIES["p07_catalogue"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan
    near = lambda rows: [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows]
    assert near(rows_of(spark, "p07_catalogue")) == near(rows_by_sql("p07_catalogue"))


def test_workload_is_asked_of_classes_of_records(spark):
    """F16: some 200 conditions were tested on every record, three times over; now each way adds up the classes that they tell apart."""
    from sumac.operators import agree
    from sumac.operators import aggregates as A
    from sumac.operators import predicates as P
    from sumac.operators.condense import condense, condense_text, passes, within_passes

    rows = [(None if i % 11 == 0 else f"b{i % 4}", None if i % 7 == 0 else (i * 37 % 50) / 4, None if i % 5 == 0 else float("nan") if i % 23 == 0 else float(i % 9), i % 3 == 0, f"20{10 + i % 4}-{1 + i % 12:02d}-01 00:00:0{i % 3}") for i in range(400)]
    df = spark.createDataFrame(rows, "brand string, price double, rating double, verified_purchase boolean, t string").selectExpr("* EXCEPT (t)", "CASE WHEN price IS NULL OR price > 1 THEN CAST(t AS timestamp) END AS event_time")
    b, cheap, year = P.Eq("brand", "b1"), P.Range("price", high=5.0, high_open=True), P.Range("event_time", low="2011-01-01T00:00:01Z", high="2012-01-01T00:00:00Z")
    specs = [
        (A.Count(), None), (A.Count(), P.Or((P.Neq("price", 2.5, null_matches=True), b))), (A.Count("brand"), cheap), (A.Count("price"), b), (A.Sum("price"), P.Eq("brand", "nobody")), (A.Sum("price"), year),
        (A.Mean("price", "as_zero"), P.And((year, b))), (A.Mean("price"), P.NotIn("rating", (1.0, 2.0))), (A.Mean("price", "as_zero"), P.IsNull("price")), (A.Mean("verified_purchase"), cheap), (A.Mean("price"), P.Range("rating", low=3.0)),
        (A.Proportion(P.IsNull("price")), P.Neq("brand", "b1", null_matches=True)), (A.Proportion(cheap), P.Eq("brand", "nobody")), (A.Comparison(b, P.IsNull("brand"), "mean", "price"), cheap), (A.Comparison(year, cheap, "sum", "price"), None),
        (A.TopK("brand", 2), year), (A.TopK("price", 3, "mean", "rating", False, "all"), P.NotNull("rating")), (A.Trend("month", "mean", "price", nulls="as_zero"), b), (A.Trend("quarter"), cheap), (A.Trend("year", "sum", "price"), year),
    ]
    queries = [A.Query(f"q{n}", *spec) for n, spec in enumerate(specs)]
    assert max(len(fields) for fields, _ in passes(queries)) <= 3
    classes, asked = condense(df, queries), within_passes(queries)
    df.createOrReplaceTempView("to_condense")
    condense_text(spark, queries, "to_condense").createOrReplaceTempView("condensed_by_text")
    plain = A.evaluate_batch(df, queries)
    for way in (A.evaluate_batch(classes, asked), agree.evaluate_text(spark, asked, "condensed_by_text", condensed=True)):
        cells = agree.compare(plain, way.where("NOT isnan(value) OR value IS NULL")).where("NOT (isnan(value_a) <=> true)")
        assert cells.where("NOT same").collect() == [] and cells.count() > 30
    assert condense(df.unionAll(df), queries).count() == classes.count()
    plan = QUERIES["q14_pack"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    read = re.findall(r"(?<!Local)Relation \[[^\n]*", plan)
    assert read and all("__pass#" in x for x in read)
    assert {r["key"] for r in QUERIES["q14_pack"](spark, SF).collect() if r["dimension"] == "agreement"} <= {"agreed", "no_rows"}


def test_start_tags_are_read_once_for_each_spelling(monkeypatch):
    """op1_main_text: class names and roles were taken apart again at every element."""
    from sumac.llm import html

    calls, real = [], html.meaning
    monkeypatch.setattr(html, "meaning", lambda *x: calls.append(x) or real(*x))
    monkeypatch.setattr(html, "TAGS", {})
    page = "<div class='ad'>no</div>" + "<div class='post'><p id=x>yes</p></div>" * 50 + f"<div class='{'z' * 300}'>long</div>" * 2
    root, leaves = html.parse(page)
    assert len(calls) == 5 and all(len(a) <= 200 for _, a in html.TAGS)
    assert [c.dropped for c in root.children] == [True] + [False] * 52 and [c.main for c in root.children] == [False] + [True] * 50 + [False] * 2
    assert len(leaves) == 53 and html.content(root, set()) == "yes"
    monkeypatch.setattr(html, "TAGS", {("a", str(i)): ("a", False, False, False) for i in range(4096)})
    assert html.opened("div", " class='post'").main and len(html.TAGS) == 1


def test_catalogue_asks_its_questions_without_an_index(spark, monkeypatch):
    """F1 of round 4: six questions made an index of all records, vectors were made by Spark's lists, twice, and each of eight passes read the records."""
    from sumac.operators import lexical, pipelines, retrieval

    made = []
    monkeypatch.setattr(lexical, "bm25_index", lambda *_: made.append("index"))
    own = retrieval.dense_top
    monkeypatch.setattr(retrieval, "dense_top", lambda vectors, *rest: made.append(dict(vectors.dtypes)["v"]) or own(vectors, *rest))
    near = lambda rows: [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows]
    assert near(rows_of(spark, "p07_catalogue")) == near(rows_by_sql("p07_catalogue"))
    assert made == ["string"]  # the digests, once; their vectors are made in the tasks
    monkeypatch.undo()
    monkeypatch.setattr(pipelines.LS, "TERMS", 3)  # too many questions for a pass
    assert near(rows_of(spark, "p07_catalogue")) == near(rows_by_sql("p07_catalogue"))


@pytest.mark.parametrize("common", [0.0, 0.9])
def test_bm25_of_a_pass_is_that_of_all_pairs(spark, monkeypatch, common):
    """Ties, repeated units, null and empty texts, few candidates held, texts in pieces; with words in most units the mean idf is negative."""
    from sumac.operators import lexical_scan as LS
    from test_tables import plain_bm25

    rng = random.Random(4)
    vocabulary = ["w%d" % i for i in range(300)] if not common else ["aa", "bb", "cc"]
    line = lambda: " ".join(vocabulary[min(int(rng.expovariate(0.02)), len(vocabulary) - 1)] for _ in range(rng.randint(1, 40)) if not common or rng.random() < common)
    units = [(i, line()) for i in range(200)] + [(5, "again w1 w2"), (300, None), (301, ""), (302, "w1 w2 w3"), (303, "w1 w2 w3"), (302, "W1,w2"), (302, None)]
    asked = [(1, "w1 w2 w3 w3"), (2, "w250 aa"), (3, ""), (4, None), (5, "nothing like it"), (6, line()), (7, "W100 w5! bb")]
    frame = spark.createDataFrame(units, "unit long, text string").repartition(3)
    queries = spark.createDataFrame(asked, "query_id long, text string")

    def found(frame=frame, queries=queries):
        out = {}
        for r in sorted(LS.bm25_scan(frame, "unit", "text", LS.asked_terms(queries), queries, 7).collect(), key=lambda r: r.rank):
            out.setdefault(r.query_id, []).append((r.unit, round(r.score, 7) + 0.0))
        return out

    want = {q: [(u, round(s, 7) + 0.0) for u, s in v] for q, v in plain_bm25(units, asked, 7).items()}
    assert found() == want
    for name, size in (("CELLS", 100), ("BYTES", 200), ("HASHES", 10)):
        monkeypatch.setattr(LS, name, size)
    assert found() == want
    names = spark.createDataFrame([(str(u), t) for u, t in units], "unit string, text string").coalesce(1)
    assert found(names) == {q: [(u, round(s, 7) + 0.0) for u, s in v] for q, v in plain_bm25([(str(u), t) for u, t in units], asked, 7).items()}
    assert found(frame.where("unit < 0")) == {}
    assert found(queries=queries.where("query_id IN (3, 4)")) == {q: want[q] for q in (3, 4)}
    assert LS.asked_terms(queries.select("query_id", F.concat_ws(" ", F.transform(F.sequence(F.lit(10), F.lit(200)), lambda i: i.cast("string"))).alias("text"))) is None


def test_words_are_those_of_the_tokenizer(spark):
    """Also where capitals outside ASCII have a lower case inside, and where one text ends and the next begins."""
    import pyarrow as pa

    from sumac.operators import lexical_scan as LS
    from sumac.operators import retrieval

    texts = ["Ab c de-FG9 @[`{/:", "", "x yy", "éabcKELVIN K", "zz", "zz", "İstanbul AİB ıIſs ÅÅK", "a" * 40 + "B", "ﬁne \U0001d400bc"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", retrieval.tokenize(F.col("text")).alias("t")).orderBy("i").collect()
    for part in (slice(None), slice(2, 5), slice(1, 2), slice(0, 0)):
        given = pa.array(texts, pa.string())[part]
        tokens, lengths = LS.words(given)
        assert tokens.to_pylist() == [t for r in rows[part] for t in r.t] and lengths.tolist() == [len(r.t) for r in rows[part]]


def test_vectors_of_digests_are_the_hash_embedding(spark):
    import pyarrow as pa

    from sumac.operators import inner, retrieval

    rows = spark.range(300).selectExpr("CAST(id * id AS STRING) AS text").select(F.sha2("text", 256).alias("d"), retrieval.hash_embedding(F.col("text")).alias("v")).collect()
    digests = pa.array([r.d for r in rows])
    assert inner.hash_vectors(digests).to_pylist() == [r.v for r in rows] and inner.hash_vectors(digests.slice(7, 2)).to_pylist() == [r.v for r in rows[7:9]]
    assert inner.hash_vectors(digests.slice(0, 0)).to_pylist() == []


def test_classes_keep_columns_apart(spark, monkeypatch):
    """What extraction read is asked of the classes: the answers and counts are those over the records."""
    from sumac.operators import aggregates as A
    from sumac.operators import pipelines
    from sumac.operators.condense import within_passes
    from sumac.operators.evidence import eligible_counts
    from sumac.operators.records import records
    from sumac.queries.experiments import ASKED

    monkeypatch.setattr(pipelines, "ATTEMPTS", 1)
    df = records(spark, SF).withColumn("product_id", F.when(F.col("helpful_votes") > 0, F.col("product_id")))
    classes = pipelines.extracted_classes(df, ASKED)
    got = df.where(pipelines.read_within(pipelines.ATTEMPTS))
    assert 0 < got.count() < df.where("helpful_votes > 0").count() and classes.where("__pass = 0").agg(F.sum("__n")).first()[0] == df.count()
    near = lambda rows: sorted([tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows.collect()], key=str)
    for few, rows in ((classes, df), (classes.where(pipelines.READ), got)):
        assert near(A.evaluate_batch(few, within_passes(ASKED))) == near(A.evaluate_batch(rows, ASKED))
        assert near(eligible_counts(few, within_passes(ASKED))) == near(eligible_counts(rows, ASKED))
