"""Predicates, aggregates, evidence and agreement on small tables: nulls, empty groups, ties, time."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sumac.operators import aggregates as A
from sumac.operators import agree, evidence
from sumac.operators import predicates as P
from sumac.operators.records import RECORD

T0 = dt.datetime(2021, 12, 31, 23, 59, 59)


@pytest.fixture(scope="module")
def df(spark):
    """20 records: 8 Electronics, 7 Books, 5 Sports; four without a price."""
    rows = []
    for i in range(20):
        category = "Electronics" if i < 8 else "Books" if i < 15 else "Sports"
        price = None if i % 5 == 4 else float(10 + i)
        rows.append((f"r{i:02d}", f"p{i}", category, f"b{i % 3}", f"t{i}", 1.0 + i % 5, i % 4, i % 2 == 0, T0 + dt.timedelta(seconds=i if i < 3 else 40 * 86400 * i), price))
    return spark.createDataFrame(rows, RECORD).persist()


def one(frame):
    return [(r.key, r.value) for r in frame.orderBy("rank").collect()]


def ask(df, spec, scope=None):
    q = A.Query("q", spec, scope)
    df.createOrReplaceTempView("golden")
    a, b, c = A.evaluate(df, q), A.evaluate_batch(df, [q]), df.sparkSession.sql(A.to_sql(q, "golden"))
    assert one(a) == one(b) == one(c)  # three paths, one meaning
    return one(a)


def test_predicates(df):
    n = lambda p: ask(df, A.Count(), p)[0][1]
    assert n(P.Eq("category", "Books")) == 7
    assert n(P.Neq("price", 10.0)) == 15 and n(P.Neq("price", 10.0, null_matches=True)) == 19
    assert n(P.Eq("price", None)) == n(P.IsNull("price")) == 4 and n(P.Neq("price", None)) == 16
    assert n(P.NotIn("price", (10.0, 11.0))) == 14 and n(P.NotIn("price", (10.0, 11.0), True)) == 18
    assert n(P.Range("rating", 2.0, 4.0)) == 12 and n(P.Range("rating", 2.0, 4.0, True, True)) == 4
    assert n(P.Range("event_time", low="2022-01-01T00:00:00Z")) == 19
    assert n(P.Range("event_time", low="2022-01-01T00:00:00Z", low_open=True)) == 18
    # the scope's or stays one operand of what is added to it
    either = P.Or((P.Eq("category", "Books"), P.Eq("category", "Sports")))
    assert ask(df, A.Mean("price"), either) == ask(df, A.Mean("price"), P.In("category", ("Books", "Sports")))


@pytest.mark.parametrize("bad", [P.Eq("x; drop", 1), P.Eq("nope", 1), P.In("brand", ()), P.In("brand", ("a", None)), P.Range("rating"), P.And((P.Eq("brand", "a"),)), P.Eq("brand", object())])
def test_invalid_predicates(df, bad):
    with pytest.raises(P.InvalidPredicate):
        P.compile(bad, df)


def test_round_trip():
    p = P.Or((P.And((P.Eq("a", 1), P.NotIn("b", ("x", "y"), True))), P.Range("c", low=1, high_open=True), P.IsNull("d")))
    assert P.from_dict(P.to_dict(p)) == p
    with pytest.raises(P.InvalidPredicate):
        P.from_dict({"kind": "like", "field": "a"})


def test_injection(df):
    assert ask(df, A.Count(), P.Eq("brand", "b0' OR '1'='1")) == [(None, 0.0)]


def test_aggregates(df):
    nobody = P.Eq("brand", "nobody")
    assert ask(df, A.Count("brand")) == [(None, 3.0)]
    assert ask(df, A.Sum("rating"), nobody) == [(None, 0.0)]
    assert ask(df, A.Mean("rating"), nobody) == [(None, None)]
    assert ask(df, A.Mean("price"), P.IsNull("price")) == [(None, None)]
    assert ask(df, A.Mean("price", "as_zero"), P.IsNull("price")) == [(None, 0.0)]
    assert ask(df, A.Mean("verified_purchase")) == [(None, 0.5)]
    assert ask(df, A.Proportion(P.Eq("category", "Books"))) == [(None, 0.35)]
    assert ask(df, A.Proportion(P.Eq("category", "Books")), nobody) == [(None, None)]
    books, sports = P.Eq("category", "Books"), P.Eq("category", "Sports")
    assert ask(df, A.Comparison(books, sports)) == [("difference", 2.0), ("ratio", 1.4)]
    for measure in ("count", "mean", "sum"):
        assert ask(df, A.Comparison(books, nobody, measure, "rating")) == [("difference", None), ("ratio", None)]


def test_top_and_trend(df, spark):
    assert ask(df, A.TopK("category", 2)) == [("Electronics", 8.0), ("Books", 7.0)]
    assert ask(df, A.TopK("category", 1, descending=False)) == [("Sports", 5.0)]
    even = df.where("record_id < 'r15'")  # three brands of five records each
    assert ask(even, A.TopK("brand", 2)) == [("b0", 5.0), ("b1", 5.0)]
    assert ask(even, A.TopK("brand", 2, ties="all")) == [("b0", 5.0), ("b1", 5.0), ("b2", 5.0)]
    assert [k for k, _ in ask(df, A.Trend("quarter"), P.Range("event_time", high="2022-04-01T00:00:00Z", high_open=True))] == ["2021-Q4", "2022-Q1"]
    assert ask(df, A.Trend("year", "mean", "price"), P.IsNull("price")) == []
    holes = spark.createDataFrame([("a", None, 1.0), ("b", "x", None), ("c", "y", None), ("d", "y", 2.0)], "record_id string, brand string, price double").withColumn("event_time", F.lit(None).cast("timestamp"))
    assert ask(holes, A.TopK("brand", 5, "mean", "price")) == [("y", 2.0)]
    assert ask(holes, A.TopK("brand", 5, "sum", "price")) == [("y", 2.0), ("x", 0.0)]
    assert ask(holes, A.Trend("month")) == []
    with pytest.raises(ValueError):
        A.evaluate(df, A.Query("q", A.TopK("brand", 101)))


def test_partitions_do_not_matter(df):
    specs = [A.Query("a", A.Mean("price")), A.Query("b", A.TopK("brand", 2, "mean", "rating")), A.Query("c", A.Trend("month")), A.Query("d", A.Count("category"), P.Eq("verified_purchase", True))]
    first = sorted(map(tuple, A.evaluate_batch(df.repartition(1), specs).collect()), key=str)
    for n in (8, 64):
        assert sorted(map(tuple, A.evaluate_batch(df.repartition(n), specs).collect()), key=str) == first


def test_batch_is_one_pass_a_group(df):
    specs = [A.Query(f"s{i}", A.Mean("rating"), P.Range("rating", low=float(i % 5))) for i in range(12)] + [A.Query(f"t{i}", A.TopK("brand", i + 1)) for i in range(5)]
    plan = A.evaluate_batch(df, specs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") == 2


def test_sql_text_is_one_statement_a_group(df, spark):
    specs = [A.Query(f"s{i}", A.Mean("rating"), P.Range("rating", low=float(i % 5))) for i in range(12)] + [A.Query(f"t{i}", A.TopK("brand", i + 1, ties=("first", "all")[i % 2])) for i in range(5)]
    specs += [A.Query("c", A.Comparison(P.Eq("brand", "b0"), P.Eq("brand", "b1"), "mean", "rating")), A.Query("y", A.Trend("year", "sum", "helpful_votes"))]
    df.createOrReplaceTempView("asked_by_text")
    assert len(A.batch_sql(specs, "asked_by_text")) == 3
    text = agree.evaluate_text(spark, specs, "asked_by_text")
    assert {r.status for r in agree.status(agree.compare(A.evaluate_batch(df, specs), text)).collect()} == {"agreed"}


def test_spec_hash_ignores_names():
    q = A.Query("a", A.Count(), P.Eq("brand", "x"))
    assert A.spec_hash(q) == A.spec_hash(A.Query("b", A.Count(), P.Eq("brand", "x"), tags={"t": 1}))
    assert A.spec_hash(q) != A.spec_hash(A.Query("a", A.Count(), P.Eq("brand", "y")))


def test_evidence(df):
    q = A.Query("q", A.Comparison(P.Eq("brand", "b0"), P.Range("rating", low=1.0)))
    rows = evidence.contributing(df, q)
    assert rows.count() == df.where("brand = 'b0'").count() + 20
    h = lambda d: d.agg(*evidence.fingerprint(F.col("record_id"))).first()
    assert h(df) == h(df.repartition(7)) != h(df.limit(19))
    scope = evidence.enumerate_scope(df, A.Query("q", A.Count(), P.Eq("brand", "nobody"))).first()
    assert (scope.eligible, scope.excluded, scope.failure) == (0, 20, "EMPTY_SCOPE")
    assert evidence.stored_ids(rows, 3).count() == 3


def test_agreement(df):
    specs = [A.Query("a", A.Mean("price")), A.Query("b", A.TopK("brand", 2)), A.Query("c", A.Mean("rating"), P.Eq("brand", "nobody"))]
    good = A.evaluate_batch(df, specs)
    bad = good.withColumn("value", F.when(F.col("query_id") == "a", F.col("value") + 1).otherwise(F.col("value"))).where("query_id <> 'c'")
    status = {r.query_id: r.status for r in agree.status(agree.compare(good, bad)).collect()}
    assert status == {"a": "disagreed", "b": "agreed", "c": "single_engine"}
    assert agree.report(agree.status(agree.compare(good, good))).first().agreed == 3


def test_projection(df):
    out = agree.project(df, ["brand", "nope"], {"y": ("year", "event_time"), "l": ("log1p", "title")})
    assert out.columns == ["record_id", "brand", "y", "l"] and out.where("l IS NOT NULL").count() == 0
