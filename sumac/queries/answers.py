"""Queries of predicates, projections, aggregates, evidence and agreement."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import shared
from ..operators import aggregates as A
from ..operators import agree, evidence, hashtree
from ..operators import predicates as P
from ..operators import sketches as S
from ..operators.records import RECORDS_SQL, records
from .base import query

WITH = f"WITH records AS ({RECORDS_SQL}) "

verified = P.Eq("verified_purchase", True)
cheap = P.Range("price", high=1000.0, high_open=True)
steel = P.In("category", ("STANDARD", "ECONOMY", "PROMO"))
brand11 = P.Eq("brand", "Brand#11")
brand12 = P.Eq("brand", "Brand#12")
nobody = P.Eq("brand", "no such brand")
recent = P.Range("event_time", low="1996-01-01T00:00:00Z", high="1998-01-01T00:00:00Z", high_open=True)

SPECS: dict[str, A.Query] = {}


def spec(name: str, aggregation, scope=None, facts=()) -> None:
    q = A.Query(name, aggregation, scope, facts)
    SPECS[name] = q
    query(name, WITH + A.to_sql(q, "records"))(lambda spark, sf_dir: A.evaluate(records(spark, sf_dir), q))


# predicates, each as the scope of a count
spec("f01_eq", A.Count(), brand11)
spec("f01_eq_null", A.Count(), P.Eq("price", None))
spec("f02_neq", A.Count(), P.Neq("price", 901.0))
spec("f02_neq_null_matches", A.Count(), P.Neq("price", 901.0, null_matches=True))
spec("f02_neq_null", A.Count(), P.Neq("price", None))
spec("f03_in", A.Count(), P.In("brand", ("Brand#11", "Brand#23")))
spec("f04_not_in", A.Count(), P.NotIn("brand", ("Brand#11", "Brand#23")))
spec("f04_not_in_null_matches", A.Count(), P.NotIn("price", (901.0, 902.0), null_matches=True))
spec("f05_range_closed", A.Count(), P.Range("rating", low=2.0, high=4.0))
spec("f05_range_open_low", A.Count(), P.Range("rating", low=2.0, high=4.0, low_open=True))
spec("f05_range_open_high", A.Count(), P.Range("rating", low=2.0, high=4.0, high_open=True))
spec("f05_range_low_only", A.Count(), P.Range("helpful_votes", low=3))
spec("f05_range_time", A.Count(), recent)
spec("f06_is_null", A.Count(), P.IsNull("price"))
spec("f06_not_null", A.Count(), P.NotNull("price"))
spec("f07_and_or", A.Count(), P.Or((P.And((verified, cheap)), P.And((brand12, P.Or((P.IsNull("price"), P.Eq("rating", 5.0))))))))
# aggregates
spec("a01_count", A.Count())
spec("a01_count_empty", A.Count(), nobody)
spec("a02_distinct", A.Count("brand"), verified)
spec("a03_sum_price", A.Sum("rating"), verified)
spec("a03_sum_as_zero", A.Sum("helpful_votes", nulls="as_zero"), brand11)
spec("a03_sum_empty", A.Sum("rating"), nobody)
spec("a04_mean_rating", A.Mean("rating"), cheap)
spec("a04_mean_price", A.Mean("price", places=2), brand11)
spec("a04_mean_price_as_zero", A.Mean("price", nulls="as_zero", places=2), brand11)
spec("a04_mean_price_as_null", A.Mean("price", nulls="as_null", places=2), brand11)
spec("a04_mean_boolean", A.Mean("verified_purchase"))
spec("a04_mean_empty", A.Mean("rating"), nobody)
spec("a05_proportion", A.Proportion(P.Range("rating", low=4.0)), verified)
spec("a05_proportion_empty", A.Proportion(verified), nobody)
spec("a06_comparison_count", A.Comparison(brand11, brand12))
spec("a06_comparison_mean", A.Comparison(brand11, brand12, "mean", "rating"))
spec("a06_comparison_sum", A.Comparison(brand11, brand12, "sum", "helpful_votes", "difference"))
spec("a06_comparison_empty", A.Comparison(brand11, nobody, "sum", "rating"))
spec("a07_trend_month_count", A.Trend("month"), recent)
spec("a07_trend_quarter_mean", A.Trend("quarter", "mean", "rating"))
spec("a07_trend_year_sum", A.Trend("year", "sum", "helpful_votes"), verified)
spec("a07_trend_mean_as_zero", A.Trend("year", "mean", "helpful_votes", "as_zero"))
spec("a08_topk_brand_count", A.TopK("brand", 5))
spec("a08_topk_brand_mean", A.TopK("brand", 5, "mean", "rating"), verified)
spec("a08_topk_brand_mean_ties_all", A.TopK("helpful_votes", 2, "mean", "rating", ties="all"), P.Eq("rating", 5.0))
spec("a08_topk_category_sum_ascending", A.TopK("category", 3, "sum", "helpful_votes", descending=False))
spec("a08_topk_random_stable", A.TopK("brand", 7, ties="random_stable"), steel)

#: Predicates by name, some of which no check lets through: an unknown field, no plain name, and values without a literal.
CHECKED = {
    "known": P.Eq("brand", "Brand#11"), "unknown": P.Eq("colour", "red"), "injected": P.Eq("brand = brand OR brand", "x"), "quoted": P.Neq("title", "it's; --"), "time": recent,
    "number": P.Eq("rating", 4), "boolean": P.Neq("verified_purchase", False), "null": P.Eq("price", None), "set": P.Eq("brand", {"x"}), "null_in_list": P.In("brand", ("x", None)), "one_operand": P.And((verified,)),
}
PASSED = {"known", "quoted", "time", "number", "boolean", "null"}


@query("f08_f09_checks", WITH + " UNION ALL ".join(f"SELECT '{k}' AS name, {k in PASSED} AS valid, " + (f"(SELECT COUNT(*) FROM records WHERE {P.to_sql(p)})" if k in PASSED else "NULL") + " AS eligible" for k, p in CHECKED.items()))
def checks(spark, sf_dir):
    """Which predicates pass the check of fields and literals, and the records of those that do."""
    df = records(spark, sf_dir)

    def valid(p: P.Predicate) -> bool:
        try:
            P.check(p, df.columns)
        except P.InvalidPredicate:
            return False
        return True

    passed = {k: valid(p) for k, p in CHECKED.items()}
    counts = evidence.eligible_counts(df, [A.Query(k, A.Count(), CHECKED[k]) for k, ok in passed.items() if ok])
    table = spark.createDataFrame(list(passed.items()), "name string, valid boolean")
    return table.join(counts.withColumnRenamed("query_id", "name"), "name", "left")


DISPATCHED = {"count": A.Count(), "distinct": A.Count("brand"), "sum": A.Sum("rating"), "mean": A.Mean("price", places=2), "proportion": A.Proportion(verified), "comparison": A.Comparison(brand11, brand12), "topk": A.TopK("brand", 2), "trend": A.Trend("year")}


@query("a09_dispatch", WITH + " UNION ALL ".join(f"SELECT kind, rank, key, value FROM (SELECT '{type(x).__name__}' AS kind, * FROM ({A.to_sql(A.Query(k, x), 'records')}) q)" for k, x in DISPATCHED.items()))
def dispatch(spark, sf_dir):
    """Each kind of specification by the one way in, under the name of its kind."""
    df = records(spark, sf_dir)
    first, *rest = [A.evaluate(df, A.Query(k, x)).select(F.lit(type(x).__name__).alias("kind"), "rank", "key", "value") for k, x in DISPATCHED.items()]
    for x in rest:
        first = first.unionByName(x)
    return first


FLAGSHIP = A.Query("top_brands", A.TopK("brand", 5, "mean", "rating", ties="all"), verified)
query("flagship", WITH + A.to_sql(FLAGSHIP, "records"))(lambda spark, sf_dir: A.evaluate(records(spark, sf_dir), FLAGSHIP))


@query("a10_batch", WITH + " UNION ALL ".join(f"SELECT * FROM ({A.to_sql(q, 'records')}) x" for q in SPECS.values()))
def batch(spark, sf_dir):
    return A.evaluate_batch(records(spark, sf_dir), list(SPECS.values()), once=True)


@query("f10_filtered_page", WITH + "SELECT record_id, brand, rating FROM records WHERE brand = 'Brand#11' AND rating BETWEEN 3.0 AND 5.0 AND verified_purchase ORDER BY record_id LIMIT 20 OFFSET 40")
def page(spark, sf_dir):
    from ..operators.runs import page as paged

    df = records(spark, sf_dir)
    kept = df.where(P.compile(P.And((brand11, P.Range("rating", 3.0, 5.0), verified)), df)).select("record_id", "brand", "rating")
    return paged(kept, ["record_id"], 3, 20)


@query("f11_projection", WITH + "SELECT record_id, brand, price FROM records")
def projection(spark, sf_dir):
    return agree.project(records(spark, sf_dir), ["brand", "price", "no_such_field"])


@query(
    "f12_derived",
    WITH + "SELECT record_id, year(event_time) AS y, month(event_time) AS m, quarter(event_time) AS q, round(ln(1 + helpful_votes), 6) AS votes_log, rating AS same FROM records",
)
def derived(spark, sf_dir):
    made = {"y": ("year", "event_time"), "m": ("month", "event_time"), "q": ("quarter", "event_time"), "votes_log": ("log1p", "helpful_votes"), "same": ("identity", "rating")}
    return agree.project(records(spark, sf_dir), [], made).withColumn("votes_log", F.round("votes_log", 6))


@query("f13_scope", WITH + f"SELECT COUNT(*) FILTER ({P.to_sql(cheap)}) AS eligible, COUNT(*) - COUNT(*) FILTER ({P.to_sql(cheap)}) AS excluded, COUNT(*) AS total, CAST(NULL AS STRING) AS failure FROM records")
def scope(spark, sf_dir):
    return evidence.enumerate_scope(records(spark, sf_dir), A.Query("s", A.Count(), cheap)).select("eligible", "excluded", "total", "failure")


@query("f14_numeric_coercion", "SELECT COUNT(TRY_CAST(lang AS DOUBLE)) AS from_text, COUNT(TRY_CAST(CAST(doc_id AS STRING) AS DOUBLE)) AS from_digits FROM documents")
def coercion(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.agg(F.count(F.col("lang").try_cast("double")).alias("from_text"), F.count(F.col("doc_id").cast("string").try_cast("double")).alias("from_digits"))


EVIDENCE = [
    A.Query("scope", A.Mean("rating"), P.And((brand11, verified))),
    A.Query("proportion", A.Proportion(P.Eq("rating", 5.0)), brand12),
    A.Query("comparison", A.Comparison(P.Eq("rating", 1.0), P.Eq("rating", 5.0)), P.And((brand11, P.Eq("helpful_votes", 0)))),
]
IDS = WITH + ", e AS (" + " UNION ALL ".join(
    [
        f"SELECT 'scope' AS query_id, record_id FROM records WHERE {P.to_sql(EVIDENCE[0].scope)}",
        f"SELECT 'proportion', record_id FROM records WHERE {P.to_sql(EVIDENCE[1].scope)} AND rating = 5.0",
        f"SELECT 'comparison', record_id FROM records WHERE {P.to_sql(EVIDENCE[2].scope)} AND rating = 1.0",
        f"SELECT 'comparison', record_id FROM records WHERE {P.to_sql(EVIDENCE[2].scope)} AND rating = 5.0",
    ]
) + ") "


def all_evidence(spark, sf_dir):
    df = records(spark, sf_dir)
    first, *rest = [evidence.contributing(df, q) for q in EVIDENCE]
    for x in rest:
        first = first.unionAll(x)
    return first


@query("e01_eligible", WITH + " UNION ALL ".join(f"SELECT '{q.query_id}' AS query_id, COUNT(*) AS eligible FROM records WHERE {P.to_sql(q.scope)}" for q in EVIDENCE))
def eligible(spark, sf_dir):
    return evidence.eligible_counts(records(spark, sf_dir), EVIDENCE)


query("e02_contributing", IDS + "SELECT * FROM e")(all_evidence)


@query("e03_stored_ids", IDS + "SELECT query_id, record_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY record_id) AS n FROM e) WHERE n <= 500")
def stored(spark, sf_dir):
    return evidence.stored_ids(all_evidence(spark, sf_dir))


@query("e04_exact_hash", IDS + "SELECT query_id, substr(sha256(string_agg(record_id, '|' ORDER BY record_id)), 1, 32) AS evidence_hash FROM e GROUP BY query_id")
def exact(spark, sf_dir):
    return all_evidence(spark, sf_dir).groupBy("query_id").agg(evidence.exact_hash(F.col("record_id")).alias("evidence_hash"))


TREE_COLUMNS = ["brand", "helpful_votes", "record_id", "verified_purchase"]
PLACE = " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), 'n')" for c in TREE_COLUMNS)
NODE = "SELECT {0} AS level, substr(prefix, 1, {0}) AS prefix, SUM(rows) AS rows, sha256(string_agg(prefix || ':' || digest, ',' ORDER BY prefix)) AS digest FROM l{1} GROUP BY ALL"


@query(
    "e04_hash_tree",
    WITH
    + f""", p AS (SELECT sha256({PLACE}) AS place, COUNT(*) AS copies FROM records GROUP BY 1),
    l2 AS (SELECT 2 AS level, substr(place, 1, 2) AS prefix, SUM(copies) AS rows, sha256(string_agg(place || ':' || copies, ',' ORDER BY place)) AS digest FROM p GROUP BY ALL),
    l1 AS ({NODE.format(1, 2)}), l0 AS ({NODE.format(0, 1)})
    SELECT level, prefix, CAST(rows AS BIGINT) AS rows, digest FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2)""",
)
def hash_tree(spark, sf_dir):
    """All nodes of the records' tree of depth 2."""
    return hashtree.build(records(spark, sf_dir).select(TREE_COLUMNS), ["record_id"], depth=2).nodes()


@query(
    "e04_tree_differences",
    WITH
    + """, s AS (SELECT record_id, CASE WHEN brand = 'Brand#11' AND helpful_votes = 6 THEN 'only_a' WHEN brand = 'Brand#12' AND helpful_votes = 5 THEN 'changed'
    WHEN brand = 'Brand#13' AND helpful_votes = 4 THEN 'only_b' END AS state FROM records)
    SELECT record_id, state, CAST(COUNT(*) FILTER (state <> 'only_b') AS BIGINT) AS copies_a, CAST(COUNT(*) FILTER (state <> 'only_a') AS BIGINT) AS copies_b FROM s WHERE state IS NOT NULL GROUP BY ALL""",
)
def tree_differences(spark, sf_dir):
    """The records against a copy from which some are gone, in which some have another brand and to which some have come."""
    df = shared.stored(records(spark, sf_dir).select(TREE_COLUMNS))
    new = F.expr("brand = 'Brand#13' AND helpful_votes = 4")
    a = hashtree.build(df.where(~new), ["record_id"])
    other = df.where("NOT (brand = 'Brand#11' AND helpful_votes = 6)").withColumn("brand", F.expr("CASE WHEN brand = 'Brand#12' AND helpful_votes = 5 THEN 'Other' ELSE brand END"))
    return hashtree.differences(a, hashtree.build(other, ["record_id"], depth=a.depth))


@query("e05_fingerprint", IDS + f"SELECT query_id, {evidence.fingerprint_sql('record_id')} FROM e GROUP BY query_id")
def fingerprint(spark, sf_dir):
    return all_evidence(spark, sf_dir).groupBy("query_id").agg(*evidence.fingerprint(F.col("record_id"))).withColumn("hash_sum", F.col("hash_sum").cast("string"))


EVERY = " UNION ALL ".join(f"SELECT * FROM ({A.to_sql(q, 'records')}) x" for q in SPECS.values())
LINE = "lpad(CAST(rank AS STRING), 10, '0') || ':' || coalesce(key, '') || ':' || coalesce(format('{:,.6f}', value), 'null')"


@query("e06_answer_hash", WITH + f"SELECT query_id, substr(sha256(string_agg(line, '|' ORDER BY line)), 1, 32) AS answer_hash FROM (SELECT query_id, {LINE} AS line FROM ({EVERY})) GROUP BY query_id")
def answer_hash(spark, sf_dir):
    return evidence.answer_hashes(batch(spark, sf_dir))


COLUMNS = ["brand", "category", "event_time", "helpful_votes", "price", "product_id", "rating", "record_id", "title", "verified_purchase"]


@query("e07_table_hash", WITH + f"SELECT {evidence.fingerprint_sql(*COLUMNS)} FROM records")
def table_hash(spark, sf_dir):
    return evidence.table_fingerprint(records(spark, sf_dir)).withColumn("hash_sum", F.col("hash_sum").cast("string"))


PATHS = [q for q in SPECS.values() if not q.query_id.startswith("f")]
#: What the second path is asked: one query with another scope, one with a lesser k, and one is left out.
SECOND = [{"a01_count": replace(q, scope=verified), "a08_topk_brand_count": replace(q, aggregation=A.TopK("brand", 4))}.get(q.query_id, q) for q in PATHS if q.query_id != "a03_sum_empty"]
UNION = lambda queries: " UNION ALL ".join(f"SELECT * FROM ({A.to_sql(q, 'records')}) x" for q in queries)
CELLS = WITH + f""", a AS (SELECT query_id, rank, coalesce(key, '') AS key, value AS value_a, TRUE AS in_a FROM ({UNION(PATHS)})),
    b AS (SELECT query_id, rank, coalesce(key, '') AS key, value AS value_b, TRUE AS in_b FROM ({UNION(SECOND)})),
    c AS (SELECT query_id, rank, key, value_a, value_b, coalesce(in_a, FALSE) AS in_a, coalesce(in_b, FALSE) AS in_b,
      coalesce(in_a AND in_b, FALSE) AND (value_a IS NOT DISTINCT FROM value_b OR coalesce(abs(value_a - value_b) <= 1e-6, FALSE)) AS same FROM a FULL JOIN b USING (query_id, rank, key)),
    s AS (SELECT query_id, CASE WHEN NOT (bool_or(in_a) AND bool_or(in_b)) THEN 'single_engine' WHEN bool_and(same) THEN 'agreed' ELSE 'disagreed' END AS status FROM c GROUP BY query_id) """


def two_paths(spark, sf_dir):
    """The Column path beside the SQL-text path, which is asked something else for three queries."""
    df = records(spark, sf_dir)
    df.createOrReplaceTempView("sumac_records")
    return agree.compare(A.evaluate_batch(df, PATHS), agree.evaluate_text(spark, SECOND, "sumac_records"))


@query("v01_compare", CELLS + "SELECT * FROM c")
def compare(spark, sf_dir):
    return two_paths(spark, sf_dir)


@query("v02_status", CELLS + "SELECT query_id, status FROM s")
def status(spark, sf_dir):
    return agree.status(two_paths(spark, sf_dir)).select("query_id", "status")


@query("v03_report", CELLS + "SELECT COUNT(*) AS total, COUNT(*) FILTER (status = 'agreed') AS agreed, COUNT(*) FILTER (status = 'disagreed') AS disagreed, COUNT(*) FILTER (status = 'single_engine') AS single_engine FROM s")
def report(spark, sf_dir):
    return agree.report(agree.status(two_paths(spark, sf_dir)))


@query("v04_disagreements", CELLS + "SELECT substr(query_id, 1, 3) AS family, COUNT(*) AS total, COUNT(*) FILTER (status <> 'agreed') AS disagreed, ROUND(AVG((status <> 'agreed')::INT), 4) AS rate FROM s GROUP BY 1")
def disagreements(spark, sf_dir):
    statuses = agree.status(two_paths(spark, sf_dir))
    return agree.disagreements(statuses, statuses.select("query_id", F.substring("query_id", 1, 3).alias("family")))


@query("v05_stage_oracles", WITH + f"SELECT COUNT(*) AS r, COUNT(price) AS e, CAST(ROUND(AVG(price), 4) AS DOUBLE) AS a FROM records WHERE {P.to_sql(verified)}")
def oracles(spark, sf_dir):
    o = agree.stage_oracles(records(spark, sf_dir), A.Query("o", A.Mean("price"), verified, ("price",)))
    r = o["R"].agg(F.count("*").alias("r"))
    e = o["E"].agg(F.count("price").alias("e"))
    return r.crossJoin(e).crossJoin(o["A"].select(F.col("value").alias("a")))  # single rows


@query("a02_distinct_sketches", WITH + "SELECT brand, COUNT(DISTINCT record_id) AS exact, COUNT(DISTINCT date_trunc('month', event_time)) AS parts, TRUE AS close FROM records GROUP BY brand")
def distinct_sketches(spark, sf_dir):
    """Sketches by brand and month, united by brand: how many, and whether the estimate is within the stated error of the exact count."""
    df = records(spark, sf_dir)
    fine = S.distinct_sketches(df, {"brand": F.col("brand"), "month": F.date_trunc("month", F.col("event_time"))}, "record_id")
    coarse = S.merged(fine, ["brand"]).join(fine.groupBy("brand").agg(F.count("*").alias("parts")), "brand")
    exact = df.groupBy("brand").agg(F.count_distinct("record_id").alias("exact"))
    return coarse.join(exact, "brand").select("brand", "exact", "parts", (F.abs(F.col("estimate") - F.col("exact")) <= S.ERROR * F.col("exact")).alias("close"))
