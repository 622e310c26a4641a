"""Queries of samples, slices, summaries and nesting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.draws import uniform_sql
from ..operators import corpus
from ..operators.evidence import fingerprint_sql
from ..operators.records import records
from .answers import COLUMNS, WITH
from .base import query

H = "sha256('42|' || record_id)"


@query("h01_nested_sample", WITH + f"SELECT record_id FROM records ORDER BY {H}, record_id LIMIT 1000")
def nested(spark, sf_dir):
    return corpus.nested_sample(records(spark, sf_dir), 1000).select("record_id")


@query("h02_stratified_sample", WITH + f"SELECT record_id, category FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY category ORDER BY {H}, record_id) AS r, COUNT(*) OVER (PARTITION BY category) AS n FROM records) WHERE r <= ceil(0.05 * n)")
def stratified(spark, sf_dir):
    return corpus.stratified_sample(records(spark, sf_dir), 0.05).select("record_id", "category")


@query("h03_holdout", WITH + f"SELECT record_id FROM records WHERE {uniform_sql(chr(39) + '42' + chr(39), 'record_id')} >= 0.9")
def holdout(spark, sf_dir):
    return corpus.holdout(records(spark, sf_dir), 0.1).select("record_id")


@query("h04_null_heavy", WITH + f"SELECT record_id FROM records WHERE price IS NULL ORDER BY {H}, record_id LIMIT 50")
def null_heavy(spark, sf_dir):
    return corpus.null_heavy(records(spark, sf_dir)).select("record_id")


TIES = """, s AS (SELECT brand, COUNT(*) AS n FROM records GROUP BY brand),
m AS (SELECT n FROM (SELECT n, COUNT(*) AS b FROM s GROUP BY n ORDER BY b DESC, n LIMIT 1) WHERE b >= 2),
t AS (SELECT brand FROM s JOIN m USING (n) ORDER BY brand LIMIT 5) """


@query("h05_tie_heavy", WITH + TIES + "SELECT record_id, brand FROM records WHERE brand IN (SELECT brand FROM t)")
def tie_heavy(spark, sf_dir):
    return corpus.tie_heavy(records(spark, sf_dir)).select("record_id", "brand")


@query("h06_rare_category", WITH + "SELECT record_id, category FROM records WHERE category = (SELECT category FROM records GROUP BY category ORDER BY COUNT(*), category LIMIT 1)")
def rare(spark, sf_dir):
    return corpus.rare_category(records(spark, sf_dir)).select("record_id", "category")


@query("h07_date_boundary", WITH + "SELECT record_id, event_time FROM records WHERE day(event_time) <= 2 OR day(event_time) >= 28")
def boundary(spark, sf_dir):
    return corpus.date_boundary(records(spark, sf_dir)).select("record_id", "event_time")


NEAR = """, m AS (SELECT category, AVG(rating) AS mean FROM records GROUP BY category),
g AS (SELECT category, lag(category) OVER (ORDER BY mean, category) AS before, mean - lag(mean) OVER (ORDER BY mean, category) AS gap FROM m),
p AS (SELECT * FROM g WHERE before IS NOT NULL ORDER BY gap, category LIMIT 1) """


@query("h08_near_equal", WITH + NEAR + "SELECT record_id, category FROM records WHERE category IN (SELECT category FROM p UNION ALL SELECT before FROM p)")
def near(spark, sf_dir):
    return corpus.near_equal(records(spark, sf_dir)).select("record_id", "category")


@query("h09_checksum", WITH + f"SELECT {fingerprint_sql(*COLUMNS)} FROM (SELECT * FROM records ORDER BY {H}, record_id LIMIT 5000)")
def checksum(spark, sf_dir):
    """The checksum of a sample of 5,000 records."""
    return corpus.checksum(corpus.nested_sample(records(spark, sf_dir), 5000)).withColumn("hash_sum", F.col("hash_sum").cast("string"))


@query(
    "h10_summary",
    WITH
    + """SELECT COUNT(*) AS n, COUNT(DISTINCT brand) AS brands, ROUND(AVG(rating), 4) AS mean_rating, ROUND(AVG(CAST(verified_purchase AS INT)), 4) AS verified_ratio,
    ROUND(AVG(CAST(price IS NULL AS INT)), 4) AS missing_price_ratio, ROUND(AVG(helpful_votes), 4) AS mean_votes, MIN(event_time) AS first_time, MAX(event_time) AS last_time FROM records""",
)
def summary(spark, sf_dir):
    return corpus.summary(records(spark, sf_dir))


@query("h10_counts", WITH + " UNION ALL ".join(f"SELECT '{d}' AS dimension, CAST({d} AS STRING) AS key, COUNT(*) AS n FROM records GROUP BY {d}" for d in ("category", "brand", "helpful_votes")))
def counts(spark, sf_dir):
    return corpus.counts_by(records(spark, sf_dir), ["category", "brand", "helpful_votes"])


@query("h10_rating_histogram", WITH + "SELECT rating, COUNT(*) AS n FROM records GROUP BY rating")
def histogram(spark, sf_dir):
    return records(spark, sf_dir).groupBy("rating").agg(F.count("*").alias("n"))


@query("h11_divergence", WITH + "SELECT COUNT(*) FILTER (brand = 'Brand#11') AS new_rows, COUNT(*) FILTER (brand <> 'Brand#11') AS preserved_rows, 0 AS new_categories FROM records")
def divergence(spark, sf_dir):
    df = records(spark, sf_dir)
    return corpus.divergence(df, df.where("brand <> 'Brand#11'"))


@query(
    "h12_nesting",
    WITH
    + f""", a AS (SELECT record_id FROM records ORDER BY {H}, record_id LIMIT 100), b AS (SELECT record_id FROM records ORDER BY {H}, record_id LIMIT 1000)
    SELECT 's100' AS small, 's1000' AS large, (SELECT COUNT(*) FROM a WHERE record_id NOT IN (SELECT record_id FROM b)) AS missing, '' AS sample, TRUE AS nested
    UNION ALL SELECT 's1000', 'all', (SELECT COUNT(*) FROM b WHERE record_id NOT IN (SELECT record_id FROM records)), '', TRUE""",
)
def nesting(spark, sf_dir):
    df = records(spark, sf_dir)
    return corpus.verify_nesting([("s100", corpus.nested_sample(df, 100)), ("s1000", corpus.nested_sample(df, 1000)), ("all", df)])


@query(
    "h13_synthetic",
    WITH + f""", m AS (SELECT 5 - floor(pow({uniform_sql("'42'", "id", "'rating'")}, 2.0) * 9) * 0.5 AS rating FROM (SELECT unnest(range((SELECT COUNT(*) FROM records))) AS id)),
    a AS (SELECT rating, COUNT(*) AS made FROM m GROUP BY rating), b AS (SELECT rating, COUNT(*) AS given FROM records GROUP BY rating)
    SELECT rating, coalesce(made, 0) AS made, coalesce(given, 0) AS given FROM a FULL JOIN b USING (rating)""",
)
def synthetic(spark, sf_dir):
    """As many synthetic records as the table has, by rating beside the real ones."""
    df = records(spark, sf_dir)
    count = lambda rows, name: rows.groupBy("rating").agg(F.count("*").alias(name))
    return count(corpus.synthetic(spark, df.count()), "made").join(count(df, "given"), "rating", "full_outer").fillna(0, ["made", "given"])


ROW = "SELECT '{0}' AS world_id, {1} AS parent, CAST(42 AS INT) AS seed, " + fingerprint_sql("record_id") + " FROM "


@query("h14_manifest", WITH + ROW.format("s1000", "'all'") + f"(SELECT * FROM records ORDER BY {H}, record_id LIMIT 1000) UNION ALL " + ROW.format("all", "NULL") + "records")
def manifest(spark, sf_dir):
    df = records(spark, sf_dir)
    rows = corpus.manifest(spark, "s1000", corpus.nested_sample(df, 1000), "all", 42).unionByName(corpus.manifest(spark, "all", df, None, 42))
    return rows.withColumn("hash_sum", F.col("hash_sum").cast("string"))
