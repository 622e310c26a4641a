"""Queries of sources, ingest, sinks and the incremental ingest, over the events table as raw lines."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import new_folder as workspace
from ..operators import aggregates as A
from ..operators import evidence
from ..operators import predicates as P
from ..operators.records import RECORDS_SQL, records
from ..sources import ingest as I
from ..sources import layout, ranges, readers, sinks
from .answers import WITH
from .base import query


#: Raw names of categories in the made lines, the last of them unknown, and what they stand for.
NAMES = ["electronics", "books", "home & kitchen", "home and kitchen", "kitchen", "sports & outdoors", "sports and outdoors", "sports", "clothing", "clothing, shoes & jewelry", "apparel",
         "toys & games", "toys and games", "toys", "beauty", "beauty & personal care", "automotive", "food & grocery", "grocery", "grocery & gourmet food", "office products", "office", "unheard of"]
MEANT = ["Electronics", "Books", *["Home & Kitchen"] * 3, *["Sports & Outdoors"] * 3, *["Clothing"] * 3, *["Toys & Games"] * 3, "Beauty", "Beauty", "Automotive", *["Food & Grocery"] * 3, *["Office Products"] * 3]


def load(spark, path: str) -> DataFrame:
    """Raw rows that a query wrote itself, of any size: the limit of bytes is for files from outside."""
    return readers.load_raw(spark, path, max_bytes=None)


def raw_lines(spark, sf_dir) -> DataFrame:
    """Each event as a JSON line of a raw review; event_id % 10 picks a fault, and the rest of the number the category,
    brand or store, flag, and further fields."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.col("event_id") % 10).withColumn("m", F.floor(F.col("event_id") / 10))
    i, k, m = F.col("event_id"), F.col("k"), F.col("m")
    asin = F.when(k == 1, "").when(k == 2, F.lit("bad id!")).when(k == 3, F.concat(F.lit("E"), (i - 3).cast("string"))).otherwise(F.concat(F.lit("E"), i.cast("string")))
    name = F.element_at(F.array(*map(F.lit, NAMES)), (m % len(NAMES)).cast("int") + 1)
    seconds = F.lit("2023-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), i % 86400)
    fields = {  # a text that begins with # stands for the bare value behind it
        "asin": asin,
        "title": F.when(k == 7, None).otherwise(F.concat(F.lit("Event "), i.cast("string"))),
        "main_category": F.when(k == 8, None).when(k == 9, "nothing").when(m % 2 == 0, F.concat(F.lit(" "), F.upper(name))).otherwise(name),
        "categories": F.when((k == 8) & (m % 3 == 0), F.array(name, F.lit("x"))).when(k == 9, F.array(F.lit("Books"), F.lit("y"), F.lit("z"))),
        "brand": F.when(m % 4 == 0, " Acme ").when(m % 4 == 2, ""),
        "store": F.when(m % 4 == 1, "Shop").when(m % 4 == 2, "Corner"),
        "verified_purchase": F.element_at(F.array(F.lit(None).cast("string"), *map(F.lit, ("#true", "no", "YES", "#1", "#false"))), (m % 6).cast("int") + 1),
        "average_rating": F.when(k == 5, F.lit(6.5)).otherwise(F.lit(1.0) + i % 9 * 0.5),
        "rating_number": i % 7,
        "price": F.when(k == 6, "$1,234.565").otherwise(F.concat(F.lit("$"), (i % 50).cast("string"))),
        "bought_in_last_month": F.when(m % 5 == 0, "1K+"),
        "timestamp": F.when(k == 4, "not a date").when(k == 6, F.concat(F.lit("#"), F.unix_timestamp(seconds).cast("string"))).otherwise(F.date_format(seconds, "yyyy-MM-dd'T'HH:mm:ssXXX")),
        "extra": i,
        "more": F.when(m % 7 == 0, "yes"),
    }
    line = F.regexp_replace(F.to_json(F.struct(*[v.alias(n) for n, v in fields.items()])), '"#([a-z0-9]+)"', "$1")
    return e.select(i.alias("row_index"), F.when(i % 100 == 0, "{broken").otherwise(line).alias("line"))


def raw(spark, sf_dir) -> DataFrame:
    """The lines as stored, each with its number. Row groups are small, as a task reads whole ones: lines are short on disk and long to parse."""
    folder = workspace(spark)
    raw_lines(spark, sf_dir).write.option("parquet.block.size", 8 << 20).parquet(f"{folder}/lines")
    return readers.parse_lines(spark.read.parquet(f"{folder}/lines"))


#: The same faults as SQL over events.
FAULTS = """WITH e AS (SELECT event_id AS i, event_id % 10 AS k, event_id // 10 AS m, event_id % 100 = 0 AS broken FROM events),
r AS (SELECT i, k, m, CASE WHEN broken THEN 'json_parse_error' WHEN k = 1 THEN 'missing_or_empty_asin' WHEN k = 2 THEN 'invalid_asin_format'
             WHEN k = 4 THEN 'malformed_timestamp' WHEN k = 5 THEN 'invalid_rating' END AS reason,
             CASE WHEN k = 3 THEN i - 3 ELSE i END AS of FROM e),
a AS (SELECT * FROM r WHERE reason IS NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY of ORDER BY i) = 1) """


@query("s04_json_lines", "SELECT COUNT(*) AS n, COUNT(*) FILTER (event_id % 100 = 0) AS malformed FROM events")
def json_lines(spark, sf_dir):
    folder = workspace(spark)
    raw_lines(spark, sf_dir).select("line").write.text(f"{folder}/raw.jsonl")
    return load(spark, f"{folder}/raw.jsonl").agg(F.count("*").alias("n"), F.count_if("malformed").alias("malformed"))


@query("s05_json_gz", "SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_index, event_id % 100 = 0 AS malformed, CASE WHEN event_id % 100 <> 0 THEN 'Event ' || event_id END AS title FROM events WHERE event_id % 10 <> 7")
def json_gz(spark, sf_dir):
    """The lines written in order of the id; their numbers by file and line are the places in that order."""
    folder = workspace(spark)
    lines = raw_lines(spark, sf_dir).where("row_index % 10 <> 7")
    lines.repartitionByRange("row_index").sortWithinPartitions("row_index").select("line").write.option("compression", "gzip").text(f"{folder}/raw.jsonl.gz")
    return load(spark, f"{folder}/raw.jsonl.gz").select("row_index", "malformed", "title")


@query("s06_csv", WITH + "SELECT brand, COUNT(*) AS n, ROUND(SUM(rating), 2) AS total FROM records GROUP BY brand")
def csv(spark, sf_dir):
    folder = workspace(spark)
    records(spark, sf_dir).select(F.col("record_id").alias("asin"), "brand", F.col("rating").alias("average_rating")).write.option("header", True).csv(f"{folder}/raw.csv")
    rows = load(spark, f"{folder}/raw.csv")
    return rows.groupBy("brand").agg(F.count("*").alias("n"), F.round(F.sum(F.col("average_rating").cast("double")), 2).alias("total"))


@query("s01_s02_parquet_tree", WITH + "SELECT category, COUNT(*) AS n FROM records GROUP BY category")
def tree(spark, sf_dir):
    folder = workspace(spark)
    df = records(spark, sf_dir)
    sinks.write_records(df.where("verified_purchase"), f"{folder}/t/a")
    sinks.write_records(df.where("NOT verified_purchase"), f"{folder}/t/b")
    return readers.read_records(spark, f"{folder}/t", df.schema, recursive=True).groupBy("category").agg(F.count("*").alias("n"))


@query("s03_temp_view", WITH + "SELECT COUNT(*) AS n FROM records WHERE price > 1000")
def view(spark, sf_dir):
    name = readers.as_table(records(spark, sf_dir), "sumac_view")
    return spark.sql(f"SELECT COUNT(*) AS n FROM {name} WHERE price > 1000")


@query("s07_parquet_raw", WITH + "SELECT COUNT(*) AS n, COUNT(price) AS priced FROM records")
def parquet_raw(spark, sf_dir):
    folder = workspace(spark)
    records(spark, sf_dir).select(F.col("product_id").alias("asin"), "title", "price").write.parquet(f"{folder}/raw.parquet")
    return load(spark, f"{folder}/raw.parquet").agg(F.count("*").alias("n"), F.count("price").alias("priced"))


@query("s08_reader_by_extension", "SELECT f.*, COUNT(*) AS n, COUNT(*) FILTER (event_id % 7 = 0) AS sevens FROM events, (SELECT unnest(['rows.jsonl', 'rows.json', 'rows.csv', 'rows.parquet']) AS name) f GROUP BY ALL UNION ALL SELECT 'rows.xml', NULL, NULL")
def by_extension(spark, sf_dir):
    """The same rows in each format, read by the name of the folder; another name has no reader."""
    folder = workspace(spark)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("asin"), (F.col("event_id") % 7).alias("rating_number"))
    rows.write.json(f"{folder}/rows.jsonl")
    rows.write.json(f"{folder}/rows.json")
    rows.write.option("header", True).csv(f"{folder}/rows.csv")
    rows.write.parquet(f"{folder}/rows.parquet")
    sums = [F.count("*").alias("n"), F.count_if(F.col("rating_number") == "0").alias("sevens")]
    first, *rest = [load(spark, f"{folder}/{name}").agg(*sums).select(F.lit(name).alias("name"), "*") for name in ("rows.jsonl", "rows.json", "rows.csv", "rows.parquet")]
    for x in rest:
        first = first.unionByName(x)
    try:
        load(spark, f"{folder}/rows.xml")
    except ValueError:
        return first.unionByName(spark.sql("SELECT 'rows.xml' AS name, CAST(NULL AS BIGINT) AS n, CAST(NULL AS BIGINT) AS sevens"))
    return first


@query("s09_size_limit", "SELECT SUM(length(CAST(event_id AS STRING)) + 1)::BIGINT AS bytes, TRUE AS at_limit, FALSE AS beyond FROM events")
def size_limit(spark, sf_dir):
    """Bytes of the input from the file list, and whether it is read at a limit of so many and of one less."""
    path = f"{workspace(spark)}/rows.jsonl"
    spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").cast("string")).write.text(path)
    size = readers.input_bytes(spark, path)

    def allowed(limit: int) -> bool:
        try:
            readers.load_raw(spark, path, max_bytes=limit)
        except readers.TooLarge:
            return False
        return True

    return spark.createDataFrame([(size, allowed(size), allowed(size - 1))], "bytes long, at_limit boolean, beyond boolean")


STORED = {"all": None, "brand": P.Eq("brand", "Brand#11"), "both": P.And((P.Range("rating", low=2.0, high=3.5, high_open=True), P.In("brand", ("Brand#11", "Brand#12")))), "text": P.Neq("title", "it's \"quoted\"")}


@query("s10_query_specs", WITH + " UNION ALL ".join(f"SELECT '{k}' AS query_id, COUNT(*) AS eligible FROM records WHERE {P.to_sql(p)}" for k, p in STORED.items()))
def query_specs(spark, sf_dir):
    """Specifications written as JSON lines, read back and counted."""
    path = f"{workspace(spark)}/queries.jsonl"
    spark.createDataFrame([(json.dumps({"query_id": k, "scope": P.to_dict(p)}),) for k, p in STORED.items()], "value string").write.text(path)
    specs = readers.load_queries(spark, path)
    return evidence.eligible_counts(records(spark, sf_dir), [A.Query(q["query_id"], A.Count(), q["scope"]) for q in specs])


@query("s11_worlds", WITH + "SELECT concat('world_s7_n', n) AS world_id, n AS scale_n, CAST(7 AS BIGINT) AS seed, 'nested' AS policy, least(n, (SELECT COUNT(*) FROM records)) AS rows FROM (SELECT unnest([10, 500, 100000000])::BIGINT AS n)")
def worlds_config(spark, sf_dir):
    """The samples that a config lists, with the rows that each has."""
    worlds = readers.load_worlds(spark, {"scales": [10, 500, 100_000_000], "seed": 7})
    total = records(spark, sf_dir).agg(F.count("*").alias("n"))
    return worlds.crossJoin(total).withColumn("rows", F.least("scale_n", "n")).drop("n")  # three rows and one


@query("k01_k02_partitioned_write", WITH + "SELECT category, CAST(year(event_time) AS INT) AS year, COUNT(*) AS n FROM records GROUP BY ALL")
def partitioned(spark, sf_dir):
    folder = workspace(spark)
    sinks.write_records(records(spark, sf_dir), f"{folder}/r", ("category", "year"))
    return spark.read.parquet(f"{folder}/r").groupBy("category", "year").agg(F.count("*").alias("n"))


@query(
    "k02_layout",
    WITH
    + """, y AS (SELECT *, CAST(year(event_time) AS INT) AS year FROM records), m AS (SELECT min(brand) AS brand, max(category) AS category, min(year) AS year FROM y)
    SELECT 'brand' AS dimension, record_id FROM y WHERE brand = (SELECT brand FROM m) UNION ALL SELECT 'category', record_id FROM y WHERE category = (SELECT category FROM m)
    UNION ALL SELECT 'year', record_id FROM y WHERE year = (SELECT year FROM m) UNION ALL SELECT 'brand_year', record_id FROM y JOIN m USING (brand, year)""",
)
def layout_read(spark, sf_dir):
    """Records laid out by brand, category and year at once, read by each of them and by two."""
    df, path = records(spark, sf_dir).withColumn("year", F.year("event_time")), workspace(spark)
    layout.write_layout(df, path, ["brand", "category", "year"], 64)
    ends = spark.read.parquet(f"{path}/files").agg(F.min("min_brand").alias("brand"), F.max("max_category").alias("category"), F.min("min_year").alias("year")).first().asDict()
    out = None
    for name, by in (("brand", ["brand"]), ("category", ["category"]), ("year", ["year"]), ("brand_year", ["brand", "year"])):
        rows = layout.read_layout(spark, path, {c: (ends[c], ends[c]) for c in by}).select(F.lit(name).alias("dimension"), "record_id")
        out = rows if out is None else out.unionAll(rows)
    return out


@query("k03_rejects", FAULTS + "SELECT reason, COUNT(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason")
def rejects(spark, sf_dir):
    folder = workspace(spark)
    sinks.write_rejects(I.ingest(raw(spark, sf_dir))["rejects"], f"{folder}/rejects")
    return spark.read.schema("row_index long, reason string, id_hash string").json(f"{folder}/rejects").groupBy("reason").agg(F.count("*").alias("n"))


@query("k04_world", WITH + "SELECT COUNT(*) AS parquet_rows, COUNT(*) AS json_rows, COUNT(*) AS ids FROM records WHERE brand = 'Brand#11'")
def world(spark, sf_dir):
    folder = workspace(spark)
    sinks.write_world(records(spark, sf_dir).where("brand = 'Brand#11'"), folder)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    j = spark.read.schema("record_id string").json(f"{folder}/records.jsonl")
    return count(spark.read.parquet(f"{folder}/records.parquet"), "parquet_rows").crossJoin(count(j, "json_rows")).crossJoin(count(spark.read.text(f"{folder}/ids.txt"), "ids"))  # single rows


@query("k05_stages", WITH + "SELECT brand AS run_id, COUNT(*) AS n FROM records GROUP BY brand")
def stages(spark, sf_dir):
    folder = workspace(spark)
    sinks.append_stage(records(spark, sf_dir).select(F.col("brand").alias("run_id"), "record_id"), f"{folder}/scope_rows")
    return spark.read.parquet(f"{folder}/scope_rows").groupBy("run_id").agg(F.count("*").alias("n"))


@query("k06_export", WITH + "SELECT brand, COUNT(*) AS parquet_n, COUNT(*) AS csv_n FROM records GROUP BY brand")
def export(spark, sf_dir):
    """The export in both formats, read back."""
    folder = workspace(spark)
    sinks.export(records(spark, sf_dir).groupBy("brand").agg(F.count("*").alias("n")), f"{folder}/x")
    p = spark.read.parquet(f"{folder}/x/batch.parquet").select("brand", F.col("n").alias("parquet_n"))
    c = spark.read.schema("brand string, n long").option("header", True).csv(f"{folder}/x/batch.csv").select("brand", F.col("n").alias("csv_n"))
    return p.join(c, "brand")


@query("k06_k07_bundle", """SELECT * FROM (VALUES ('as_written', 'ok'), ('rewritten', 'missing'), ('rewritten', 'unlisted'), ('other_sums', 'changed')) AS t("case", state), (SELECT COUNT(DISTINCT brand) AS lines FROM (""" + RECORDS_SQL + "))")
def bundle(spark, sf_dir):
    """A bundle as written, one whose file was written again, and one whose file has another checksum; lines: of the metrics."""
    rows = records(spark, sf_dir).groupBy("brand").agg(F.count("*").alias("n")).coalesce(1)
    out = []
    for case in ("as_written", "rewritten", "other_sums"):
        folder = f"{workspace(spark)}/b"
        sinks.write_bundle(rows, folder)
        if case == "rewritten":
            rows.write.mode("overwrite").option("header", True).csv(f"{folder}/metrics")
        if case == "other_sums":
            sums = sinks.file_checksums(spark, f"{folder}/metrics").withColumn("sha256", F.reverse("sha256"))
            sums.write.mode("overwrite").parquet(f"{folder}/checksums")
        lines = spark.read.option("header", True).csv(f"{folder}/metrics").count()
        out.append(sinks.verify_bundle(spark, folder).select(F.lit(case).alias("case"), "state", F.lit(lines).alias("lines")))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(
    "k07_ranges",
    WITH
    + """, f AS (SELECT brand, helpful_votes, string_agg(record_id || chr(10), '' ORDER BY record_id) AS t FROM records GROUP BY ALL),
    r AS (SELECT *, unnest(range(0, length(t), 4096)) AS start FROM f)
    SELECT brand, helpful_votes, start, length(substr(t, start + 1, 4096)) AS size, sha256(substr(t, start + 1, 4096)) AS sha256 FROM r""",
)
def range_sums(spark, sf_dir):
    """Sums of all ranges of text files of ids, a file for each brand and number of votes."""
    folder, key = workspace(spark), ["brand", "helpful_votes"]
    rows = records(spark, sf_dir).select("record_id", *key).repartition(*key).sortWithinPartitions(*key, "record_id")
    rows.write.partitionBy(*key).text(f"{folder}/ids")
    part = lambda name: F.regexp_extract("path", f"{name}=([^/]*)", 1)
    brand = F.replace(part("brand"), F.lit("%23"), F.lit("#"))
    return ranges.range_checksums(spark, f"{folder}/ids", 4096).select(brand.alias("brand"), part("helpful_votes").cast("long").alias("helpful_votes"), "start", "size", "sha256")


def registry(spark, sf_dir):
    df = records(spark, sf_dir)
    rows = [(f"Brand#{b}", df.where(F.col("brand") == f"Brand#{b}")) for b in (11, 12, 13)]
    out = [sinks.snapshot_row(x, f"s{i}", "d" if i else "other", "p", 0, i) for i, (_, x) in enumerate(rows)]
    out.append(sinks.snapshot_row(rows[0][1].limit(5), "s0", "other", "p2", 0, 10))
    table = out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])
    return table.unionByName(sinks.tombstone(table, "s2", 11)), df


@query("k08_k09_k10_registry", WITH + "SELECT 's0' AS snapshot_id, 5 AS rows, 'p2' AS path UNION ALL SELECT 's1', COUNT(*), 'p' FROM records WHERE brand = 'Brand#12'")
def snapshots(spark, sf_dir):
    return sinks.list_snapshots(registry(spark, sf_dir)[0]).select("snapshot_id", "rows", "path")


@query("k11_validate", """SELECT * FROM (VALUES ('same', 'registered', TRUE), ('same', 'exists', TRUE), ('same', 'has_rows', TRUE), ('same', 'same_content', TRUE), ('same', 'rejects_known', TRUE),
    ('other', 'registered', TRUE), ('other', 'exists', TRUE), ('other', 'has_rows', TRUE), ('other', 'same_content', FALSE), ('other', 'rejects_known', TRUE),
    ('unknown', 'registered', FALSE), ('unknown', 'exists', TRUE), ('unknown', 'has_rows', TRUE), ('unknown', 'same_content', FALSE), ('unknown', 'rejects_known', FALSE),
    ('gone', 'registered', TRUE), ('gone', 'exists', FALSE)) AS t("case", "check", ok)""")
def validate(spark, sf_dir):
    """The snapshot with its records, with other ones, an id that is not registered, and data that are not there."""
    table, df = registry(spark, sf_dir)
    own, other = df.where("brand = 'Brand#12'"), df.where("brand = 'Brand#12' AND rating <> 3.0")
    cases = {"same": ("s1", own), "other": ("s1", other), "unknown": ("s9", own), "gone": ("s1", None)}
    first, *rest = [sinks.validate_snapshot(table, name, rows).withColumn("case", F.lit(case)) for case, (name, rows) in cases.items()]
    for x in rest:
        first = first.unionByName(x)
    return first


@query("k12_snapshot_id", WITH + "SELECT DISTINCT brand, substr(sha256(brand || ':' || 'source' || ':' || 'config'), 1, 16) AS id FROM records")
def snapshot_id(spark, sf_dir):
    return records(spark, sf_dir).select("brand").distinct().select("brand", sinks.snapshot_id(F.col("brand"), F.lit("source"), F.lit("config")).alias("id"))


@query("i01_mapping", FAULTS + "SELECT COUNT(*) AS n FROM e WHERE NOT broken AND k NOT IN (3, 7)")
def mapping(spark, sf_dir):
    """The title under another name."""
    lines = raw_lines(spark, sf_dir).withColumn("line", F.regexp_replace("line", '"title"', '"name"')).where("row_index % 10 <> 3")
    rows = I.canonicalize(readers.parse_lines(lines), mapping={"title": "name"})
    return rows.where(~F.col("title").startswith("[No Title]") & F.col("title").startswith("Event")).agg(F.count("*").alias("n"))


CANON = FAULTS + f"""SELECT i AS row_index, 'E' || of AS product_id,
    CASE WHEN k = 9 THEN 'Books' WHEN k = 8 AND m % 3 <> 0 THEN 'Office Products' ELSE {MEANT}[m % {len(MEANT)} + 1] END AS category,
    CASE WHEN k = 7 THEN '[No Title] E' || of ELSE 'Event ' || i END AS title, CASE m % 4 WHEN 0 THEN 'Acme' WHEN 1 THEN 'Shop' WHEN 2 THEN 'Corner' ELSE 'Unknown' END AS brand,
    1.0 + (i % 9) * 0.5 AS rating, i % 7 AS helpful_votes, m % 6 NOT IN (2, 5) AS verified_purchase,
    TIMESTAMP '2023-01-01' + INTERVAL 1 SECOND * (i % 86400) AS event_time, CASE WHEN k = 6 THEN 1234.56 ELSE i % 50 END::DOUBLE AS price,
    'amz_d_E' || of || '_' || lpad(CAST(i AS STRING), CAST(greatest(8, length(CAST(i AS STRING))) AS INT), '0') AS record_id FROM r WHERE reason IS NULL"""


@query("i02_to_i12_canonical", CANON)
def canonical(spark, sf_dir):
    rows = I.canonicalize(raw(spark, sf_dir)).where("reason IS NULL")
    return rows.select("row_index", "product_id", "category", "title", "brand", "rating", "helpful_votes", "verified_purchase", "event_time", F.col("price").cast("double").alias("price"), "record_id")


@query(
    "i11_attributes",
    FAULTS + f"""SELECT i AS row_index, CASE k WHEN 8 THEN NULL WHEN 9 THEN 'nothing' ELSE CASE WHEN m % 2 = 0 THEN upper({NAMES}[m % {len(NAMES)} + 1]) ELSE {NAMES}[m % {len(NAMES)} + 1] END END AS raw_category,
    CASE WHEN k = 9 THEN '["Books","y","z"]' WHEN k = 8 AND m % 3 = 0 THEN '["' || {NAMES}[m % {len(NAMES)} + 1] || '","x"]' END AS categories,
    CASE WHEN m % 5 = 0 THEN '1K+' END AS bought, CASE WHEN m % 7 = 0 THEN '2' ELSE '1' END AS extra FROM r WHERE reason IS NULL""",
)
def attributes(spark, sf_dir):
    found = F.col("attributes")
    named = {"raw_category": "raw_category", "categories": "categories", "bought": "bought_in_last_month", "extra": "extra_field_count"}
    return I.canonicalize(raw(spark, sf_dir)).where("reason IS NULL").select("row_index", *[found[v].alias(k) for k, v in named.items()])


@query(
    "i13_hashes",
    CANON.replace("SELECT i AS row_index", ", c AS (SELECT i AS row_index", 1)
    + ") SELECT COUNT(*) AS payloads, COUNT(DISTINCT (product_id, category, title, brand, rating, helpful_votes, event_time, price)) AS contents, 32 AS digits FROM c",
)
def hashes(spark, sf_dir):
    rows = I.canonicalize(raw(spark, sf_dir)).where("reason IS NULL")
    return rows.agg(F.count_distinct("raw_payload_hash").alias("payloads"), F.count_distinct("content_hash").alias("contents"), F.max(F.length("content_hash")).alias("digits"))


@query("i14_reasons", FAULTS + "SELECT i AS row_index, reason FROM r")
def reasons(spark, sf_dir):
    return I.canonicalize(raw(spark, sf_dir)).select("row_index", "reason")


@query("i15_deduplicated", FAULTS + "SELECT 'E' || of AS source_record_id, i AS row_index FROM a")
def dedup(spark, sf_dir):
    return I.deduplicated(I.canonicalize(raw(spark, sf_dir)).where("reason IS NULL")).select("source_record_id", "row_index")


@query(
    "i16_report",
    FAULTS + "SELECT COUNT(*) AS rows_read, (SELECT COUNT(*) FROM a) AS accepted, COUNT(reason) AS rejected, COUNT(*) - COUNT(reason) - (SELECT COUNT(*) FROM a) AS duplicates, COUNT(*) FILTER (reason = 'json_parse_error') AS malformed, 0 AS null_price FROM r",
)
def report(spark, sf_dir):
    return I.ingest(raw(spark, sf_dir))["report"]


@query("i17_missingness", FAULTS + """, s AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (k = 7) AS t, COUNT(*) FILTER (m % 4 = 3) AS u FROM a) SELECT field, CASE field WHEN 'brand' THEN u WHEN 'title' THEN t ELSE 0 END AS missing,
    ROUND(CASE field WHEN 'brand' THEN u / n WHEN 'title' THEN t / n ELSE 0 END, 4)::DOUBLE AS ratio FROM s, (SELECT unnest(['price', 'brand', 'title', 'category', 'event_time', 'rating']) AS field)""")
def missing(spark, sf_dir):
    return I.missingness(I.ingest(raw(spark, sf_dir))["records"])


@query("i18_summary", WITH + "SELECT 'category' AS dimension, category AS key, COUNT(*) AS n FROM records GROUP BY category UNION ALL SELECT 'brand', brand, COUNT(*) FROM records GROUP BY brand UNION ALL SELECT 'rating', CAST(rating AS STRING), COUNT(*) FROM records GROUP BY rating UNION ALL SELECT 'first_time', strftime(MIN(event_time), '%Y-%m-%d %H:%M:%S'), COUNT(*) FROM records UNION ALL SELECT 'last_time', strftime(MAX(event_time), '%Y-%m-%d %H:%M:%S'), COUNT(*) FROM records")
def snapshot_summary(spark, sf_dir):
    return I.snapshot_summary(records(spark, sf_dir))


@query("i19_inspect", "SELECT COUNT(DISTINCT floor(doc_id / 1000)) AS files, COUNT(*) AS rows FROM documents")
def inspect(spark, sf_dir):
    """Documents (without their texts) written as a file for each thousand ids: how many files a given table lies in is not known from its rows."""
    folder = workspace(spark)
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "n_chars", F.floor(F.col("doc_id") / 1000).alias("thousand"))
    rows.repartition("thousand").write.partitionBy("thousand").parquet(f"{folder}/documents")
    return I.inspect(spark.read.parquet(f"{folder}/documents"))


@query("i20_facts", "SELECT o_orderkey AS fiscal_year, substr(sha256(concat_ws(':', o_custkey, o_orderkey, 'Revenue', 'USD', o_orderkey, 'FY', strftime(o_orderdate, '%Y-%m-%d'), '')), 1, 32) AS canonical_fact_hash FROM orders")
def facts(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = o.select(F.col("o_custkey").cast("string").alias("cik"), F.col("o_orderkey").cast("string").alias("accession_number"), F.lit("Revenue").alias("tag"), F.lit("USD").alias("unit"), F.col("o_orderkey").alias("fiscal_year"), F.lit("FY").alias("fiscal_period"), F.col("o_orderdate").cast("date").alias("end_date"), F.lit(None).cast("string").alias("segment_id"))
    return I.filing_facts(rows).select("fiscal_year", "canonical_fact_hash")


@query("i21_incremental", FAULTS + "SELECT 'E' || of AS product_id FROM a")
def incremental(spark, sf_dir):
    from ..streaming import ingest as stream

    folder = workspace(spark)
    raw_lines(spark, sf_dir).select("line").write.text(f"{folder}/in")
    stream.start(stream.read_lines(spark, f"{folder}/in", 2), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out/records").select("product_id")
