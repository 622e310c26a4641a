"""Queries of retrieval and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells as D
from ..operators import extraction as X
from ..operators import lexical as L
from ..operators import retrieval as R
from ..operators.records import records
from .answers import WITH
from .base import query

TOKENS = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^a-z0-9]+'), lambda x: len(x) > 1)"


def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def asked(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")


@query(
    "r01_render",
    WITH
    + """SELECT record_id, concat_ws(chr(10), 'ID: ' || record_id, 'Title: ' || title, 'Category: ' || category, 'Brand: ' || brand, 'Rating: ' || CAST(rating AS STRING),
    'Verified: ' || CAST(verified_purchase AS STRING), 'Votes: ' || CAST(helpful_votes AS STRING), 'Price: ' || coalesce(CAST(price AS STRING), 'n/a')) AS text FROM records""",
)
def render(spark, sf_dir):
    return R.render(records(spark, sf_dir)).select("record_id", "text")


@query(
    "r02_chunk",
    """SELECT doc_id, CAST(i AS INT) AS chunk_index, substr(text, i * 400 + 1, 500) AS chunk_text
    FROM (SELECT doc_id, text, unnest(range(0, CAST(CASE WHEN length(text) <= 500 THEN 1 ELSE 1 + ceil((length(text) - 500) / 400.0) END AS BIGINT))) AS i FROM documents)""",
)
def chunk(spark, sf_dir):
    return R.chunk(docs(spark, sf_dir), 500, 100).select("doc_id", "chunk_index", "chunk_text")


@query("r03_tokens", "SELECT doc_id, CAST(greatest(1, length(text) // 4) AS INT) AS tokens FROM documents")
def tokens(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", R.estimate_tokens(F.col("text")).alias("tokens"))


@query("r04_tokenize", f"SELECT doc_id, array_to_string({TOKENS.format('text')}, ' ') AS tokens FROM documents")
def tokenize(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(R.tokenize(F.col("text")), " ").alias("tokens"))


def bm25_sql(k: int = 10, tokens: str = TOKENS.format("text"), units: str = "documents", source: str = "documents", asked: str = "benchmark", unit: str = "doc_id") -> str:
    """A WITH clause with idf and top, the k best of the units for each item."""
    return f"""WITH tok AS (SELECT {unit} AS unit, {tokens} AS ts FROM {source}),
dl AS (SELECT unit, len(ts) AS len FROM tok),
tf AS (SELECT unit, term, COUNT(*) AS tf FROM (SELECT unit, unnest(ts) AS term FROM tok) GROUP BY unit, term),
raw AS (SELECT term, COUNT(*) AS n, ln((SELECT COUNT(*) FROM {source}) - COUNT(*) + 0.5) - ln(COUNT(*) + 0.5) AS r FROM tf GROUP BY term),
idf AS (SELECT term, n, CASE WHEN r < 0 THEN 0.25 * (SELECT AVG(r) FROM raw) ELSE r END AS idf FROM raw),
q AS (SELECT query_id, term, COUNT(*) AS times FROM (SELECT item_id AS query_id, unnest({TOKENS.format("text")}) AS term FROM {asked}) GROUP BY ALL),
s AS (SELECT query_id, unit, SUM(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / (SELECT AVG(len) FROM dl)))) AS score
      FROM tf JOIN q USING (term) JOIN idf USING (term) JOIN dl USING (unit) GROUP BY query_id, unit),
every AS (SELECT item_id AS query_id, {unit} AS unit, coalesce(score, 0.0) AS score FROM {asked} CROSS JOIN (SELECT {unit} FROM {units}) LEFT JOIN s ON s.query_id = item_id AND s.unit = {unit}),
top AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, unit) AS INT) AS rank FROM every QUALIFY rank <= {k}) """


BM25 = bm25_sql()


@query("r05_bm25_index", BM25 + "SELECT term, n, ROUND(idf, 6) AS idf FROM idf")
def index(spark, sf_dir):
    return L.bm25_index(docs(spark, sf_dir), "doc_id", "text").df.select("term", "n", F.round("idf", 6).alias("idf"))


def top(spark, sf_dir, k=10):
    return L.bm25_top(L.bm25_index(docs(spark, sf_dir), "doc_id", "text"), asked(spark, sf_dir), k)


@query("r06_bm25_top", BM25 + "SELECT query_id, unit, ROUND(score, 5) AS score, rank FROM top")
def bm25(spark, sf_dir):
    return top(spark, sf_dir).withColumn("score", F.round("score", 5))


@query("r07_bm25_filtered", bm25_sql(10, f"{TOKENS.format('text')} || {TOKENS.format('source')} || {TOKENS.format('source')}", "documents WHERE lang = 'en'") + "SELECT query_id, unit, ROUND(score, 5) AS score, rank FROM top")
def bm25_filtered(spark, sf_dir):
    d = docs(spark, sf_dir)
    units = d.where("lang = 'en'").select(F.col("doc_id").alias("unit"))
    return L.bm25_top(L.bm25_index(d, "doc_id", "text", ["source"]), asked(spark, sf_dir), 10, units=units).withColumn("score", F.round("score", 5))


@query(
    "r08_hash_embedding",
    """WITH b AS (SELECT doc_id, list_transform(range(0, 16), lambda i: CAST('0x' || substr(sha256(text), CAST(2 * i + 1 AS BIGINT), 2) AS INT) / 255.0) AS v FROM documents)
    SELECT doc_id, ROUND(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first, ROUND(list_sum(v) / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS total FROM b""",
)
def embedding(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", R.hash_embedding(F.col("text")).alias("v"))
    return rows.select("doc_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(
    "r09_dense_top",
    """WITH p AS (SELECT q.vec_id AS query_id, e.vec_id AS unit, round(list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: CAST(e.embedding[i] AS DOUBLE) * CAST(q.embedding[i] AS DOUBLE))), 9) AS score
      FROM embeddings e CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q)
    SELECT query_id, unit, ROUND(score, 5) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, unit) AS rank FROM p) WHERE rank <= 10""",
)
def dense(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return R.dense_top(e, q, 10).withColumn("score", F.round("score", 5))


@query("r09_dense_cells")
def dense_cells(spark, sf_dir):
    """The queries of r09_dense_top by cells: at least nine in ten of its answers (a test)."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return D.cell_top(D.cell_index(e), q, 10).withColumn("score", F.round("score", 5))


def candidates(spark, sf_dir):
    return top(spark, sf_dir).join(docs(spark, sf_dir).select(F.col("doc_id").alias("unit"), R.estimate_tokens(F.col("text")).cast("bigint").alias("tokens")), "unit")


PACKED = BM25.replace("WITH tok", "WITH RECURSIVE tok", 1) + """, c AS (SELECT query_id, CAST(rank AS INT) AS rank, unit, greatest(1, length(text) // 4) AS tokens FROM top JOIN documents ON unit = doc_id),
p(query_id, rank, used, units) AS (SELECT DISTINCT query_id, 0, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]) FROM c UNION ALL
  SELECT c.query_id, c.rank, CASE WHEN used + tokens <= 1500 THEN used + tokens ELSE used END, CASE WHEN used + tokens <= 1500 THEN list_append(units, CAST(unit AS VARCHAR)) ELSE units END
  FROM p JOIN c ON c.query_id = p.query_id AND c.rank = p.rank + 1),
packed AS (SELECT query_id, rank AS candidates, used AS tokens, array_to_string(units, ',') AS units, CAST(len(units) AS INT) AS selected FROM p QUALIFY ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY rank DESC) = 1) """


@query("r10_pack_context", PACKED + "SELECT query_id, units, tokens FROM packed")
def pack(spark, sf_dir):
    return R.pack_context(candidates(spark, sf_dir), 1500).select("query_id", "units", "tokens")


@query(
    "r11_context_manifest",
    PACKED + "SELECT query_id, candidates, selected, candidates - selected AS dropped, tokens, CASE WHEN candidates = selected THEN 'all_fit' ELSE 'budget_exceeded' END AS reason, substr(sha256(units), 1, 32) AS manifest_hash FROM packed",
)
def context_manifest(spark, sf_dir):
    return R.pack_context(candidates(spark, sf_dir), 1500).drop("units")



KS = [5, 10, 20, 50]
GRAMS = "SELECT DISTINCT {0} AS id, array_to_string(ts[i : i + 4], ' ') AS g FROM (SELECT {0}, ts, unnest(range(1, len(ts) - 3)) AS i FROM (SELECT {0}, " + TOKENS.format("text") + " AS ts FROM {1}) WHERE len(ts) >= 5)"


@query(
    "r12_retrieval_quality",
    bm25_sql(max(KS)) + f""", rel AS (SELECT DISTINCT i.id AS query_id, d.id AS unit FROM ({GRAMS.format('item_id', 'benchmark')}) i JOIN ({GRAMS.format('doc_id', 'documents')}) d USING (g)),
    n AS (SELECT query_id, COUNT(*) AS relevant FROM rel GROUP BY query_id), h AS (SELECT query_id, rank FROM top JOIN rel USING (query_id, unit))
    SELECT query_id, k, ROUND(hits / relevant, 6) AS recall, ROUND(hits / k, 6) AS precision
    FROM (SELECT n.query_id, relevant, CAST(k AS INT) AS k, (SELECT COUNT(*) FROM h WHERE h.query_id = n.query_id AND rank <= k) AS hits FROM n, (SELECT unnest({KS}) AS k))""",
)
def quality(spark, sf_dir):
    """A document is relevant to an item if it has five tokens in a row of it, anywhere in either."""

    def grams(rows, name):
        t = rows.select(F.col(name).alias("id"), R.tokenize(F.col("text")).alias("t")).where("size(t) >= 5")
        each = F.transform(F.sequence(F.lit(1), F.size("t") - 4), lambda i: F.array_join(F.slice("t", i, 5), " "))
        return t.select("id", F.explode(F.array_distinct(each)).alias("g"))

    wanted = R.few(grams(asked(spark, sf_dir), "query_id").withColumnRenamed("id", "query_id"))
    relevant = grams(docs(spark, sf_dir), "doc_id").withColumnRenamed("id", "unit").join(wanted, "g").select("query_id", "unit").distinct()
    return R.quality_at(top(spark, sf_dir, max(KS)), relevant, KS)


@query(
    "r13_batch_plan",
    WITH + "SELECT CAST(b AS BIGINT) AS batch, MIN(record_id) AS first_id, MAX(record_id) AS last_id, COUNT(*) AS rows, COUNT(*) * 150 AS tokens FROM (SELECT record_id, (ROW_NUMBER() OVER (ORDER BY record_id) - 1) // 1000 AS b FROM records) GROUP BY b",
)
def plan(spark, sf_dir):
    return R.batch_plan(records(spark, sf_dir), 1000)


@query("r14_edges", WITH + "SELECT src, dst FROM (SELECT record_id AS src, lead(record_id) OVER (PARTITION BY category ORDER BY record_id) AS dst FROM records) WHERE dst IS NOT NULL")
def edges(spark, sf_dir):
    return R.consecutive_edges(records(spark, sf_dir), "category")


FIELDS = {"brand": "string", "rating": "double"}


def responses(spark, sf_dir):
    """Responses of an extraction: records in batches of a product, one batch in eleven broken."""
    df = records(spark, sf_dir)
    row = F.struct("record_id", F.when(F.col("helpful_votes") == 6, None).otherwise(F.col("rating") > 2.0).alias("in_scope"), "brand", "rating")
    out = df.groupBy(F.col("product_id").alias("batch")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(row)).alias("records"))).alias("response"))
    return out.withColumn("response", F.when(F.col("batch").cast("int") % 11 == 0, F.lit("{not json")).otherwise(F.col("response")))


@query("r15_r16_parse", WITH + "SELECT product_id AS batch, record_id, brand, rating FROM records WHERE CAST(product_id AS INT) % 11 <> 0")
def parse(spark, sf_dir):
    return X.parse(responses(spark, sf_dir), FIELDS)[0].select("batch", "record_id", "brand", "rating")


@query("r16_failed_batches", WITH + "SELECT DISTINCT product_id AS batch FROM records WHERE CAST(product_id AS INT) % 11 = 0")
def failed(spark, sf_dir):
    return X.parse(responses(spark, sf_dir), FIELDS)[1]


@query("r17_pivot", WITH + "SELECT record_id, brand, CASE WHEN price IS NOT NULL THEN CAST(CAST(floor(price) AS BIGINT) AS STRING) END AS price FROM records")
def pivot(spark, sf_dir):
    entry = lambda n, v: F.struct(F.lit(n).alias("field_name"), v.alias("value"), v.isNull().alias("is_missing"))
    rows = records(spark, sf_dir).select("record_id", F.explode(F.array(entry("brand", F.col("brand")), entry("price", F.floor("price").cast("string")))).alias("e")).select("record_id", "e.*")
    return X.pivot_entries(rows, ["brand", "price"])


@query("r18_in_scope", WITH + "SELECT record_id FROM records WHERE CAST(product_id AS INT) % 11 <> 0 AND helpful_votes <> 6 AND rating > 2.0")
def scope(spark, sf_dir):
    return X.in_scope(X.parse(responses(spark, sf_dir), FIELDS)[0]).select("record_id")


@query("r19_cache", WITH + "SELECT COUNT(*) FILTER (brand = 'Brand#11') AS hits, COUNT(*) FILTER (brand <> 'Brand#11') AS left_to_do FROM (SELECT DISTINCT brand, category FROM records)")
def cache(spark, sf_dir):
    work = records(spark, sf_dir).select("brand", "category").distinct().withColumn("cache_key", X.cache_key(F.lit("model"), "brand", "category"))
    hits, left = X.split_by_cache(work, work.where("brand = 'Brand#11'").select("cache_key", F.lit("stored").alias("result")))
    return hits.agg(F.count("*").alias("hits")).crossJoin(left.agg(F.count("*").alias("left_to_do")))  # single rows


ATTEMPTS = "(SELECT product_id AS batch, a AS attempt, (CAST(product_id AS INT) + a) % 3 = 0 AS ok, 'r' || a AS result FROM (SELECT DISTINCT product_id FROM records WHERE CAST(product_id AS INT) % 7 <> 0) CROSS JOIN (SELECT unnest(range(0, 3)) AS a) WHERE a < 2 OR CAST(product_id AS INT) % 2 = 0)"


@query("r20_repair", WITH + f"SELECT batch, arg_min(result, attempt) FILTER (ok) AS result, CAST(coalesce(MIN(attempt) FILTER (ok), MAX(attempt)) AS INT) AS repairs, COUNT(*) FILTER (ok) = 0 AS failed FROM {ATTEMPTS} GROUP BY batch")
def repair(spark, sf_dir):
    p = F.col("batch").cast("int")
    rows = records(spark, sf_dir).select(F.col("product_id").alias("batch")).distinct().where(p % 7 != 0).withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(2)))).where((F.col("attempt") < 2) | (p % 2 == 0))
    return X.first_good(rows.withColumn("ok", (p + F.col("attempt")) % 3 == 0).withColumn("result", F.concat(F.lit("r"), F.col("attempt").cast("string"))))


@query("r21_checks", WITH + "SELECT COUNT(*) FILTER (helpful_votes = 0) AS invented, COUNT(*) FILTER (brand = 'Brand#12' AND helpful_votes <> 0) AS missing, COUNT(*) FILTER (brand <> 'Brand#12' AND rating = 1.0) AS wrong_type, COUNT(*) FILTER (brand <> 'Brand#12' AND helpful_votes = 6) AS ambiguous FROM records WHERE brand <> 'Brand#12' OR helpful_votes <> 0")
def checks(spark, sf_dir):
    df = records(spark, sf_dir)
    got = df.where("brand <> 'Brand#12'").select("record_id", F.when(F.col("rating") == 1.0, "low").otherwise(F.col("rating").cast("string")).alias("rating"), F.when(F.col("helpful_votes") != 6, True).alias("in_scope"))
    return X.checks(got, df.where("helpful_votes <> 0"), ["rating"])


@query("r22_usage", WITH + "SELECT brand AS run_id, CAST(SUM(length(title)) AS BIGINT) AS tokens_in, COUNT(*) * 20 AS tokens_out, ROUND((SUM(length(title)) * 0.5 + COUNT(*) * 20 * 1.5) / 1000, 6) AS cost FROM records GROUP BY brand")
def usage(spark, sf_dir):
    return X.usage(records(spark, sf_dir).select(F.col("brand").alias("run_id"), F.length("title").alias("tokens_in"), F.lit(20).alias("tokens_out")), 0.5, 1.5)
