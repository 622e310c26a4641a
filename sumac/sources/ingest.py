"""Raw rows to canonical records: parsing, reject reasons, de-duplication, reports."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .readers import RAW_FIELDS

# Canonical category of each raw category name, in lower case.
CATEGORIES = {
    "electronics": "Electronics",
    "books": "Books",
    "home & kitchen": "Home & Kitchen",
    "home and kitchen": "Home & Kitchen",
    "kitchen": "Home & Kitchen",
    "sports & outdoors": "Sports & Outdoors",
    "sports and outdoors": "Sports & Outdoors",
    "sports": "Sports & Outdoors",
    "clothing": "Clothing",
    "clothing, shoes & jewelry": "Clothing",
    "apparel": "Clothing",
    "toys & games": "Toys & Games",
    "toys and games": "Toys & Games",
    "toys": "Toys & Games",
    "beauty": "Beauty",
    "beauty & personal care": "Beauty",
    "automotive": "Automotive",
    "food & grocery": "Food & Grocery",
    "grocery": "Food & Grocery",
    "grocery & gourmet food": "Food & Grocery",
    "office products": "Office Products",
    "office": "Office Products",
}
FALLBACK = "Office Products"
TIMES = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]
REASONS = ["json_parse_error", "missing_or_empty_asin", "invalid_asin_format", "malformed_timestamp", "invalid_rating"]
#: Canonical names that a mapping may give other raw names to.
DEFAULT_MAPPING = {f: f for f in RAW_FIELDS}


def mapping_hash(mapping: dict[str, str]) -> str:
    return hashlib.sha256(json.dumps(mapping, sort_keys=True).encode()).hexdigest()[:32]


def renamed(raw: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """raw with the canonical raw names; mapping: canonical name to the name that the source uses."""
    if unknown := set(mapping) - set(DEFAULT_MAPPING):
        raise ValueError(f"no such fields: {sorted(unknown)}")
    gets = {k: F.try_variant_get(F.try_parse_json("line"), f"$.{v}", "string") for k, v in mapping.items() if k != v}
    return raw.withColumns(gets) if gets else raw


def text_of(name: str) -> Column:
    return F.nullif(F.trim(F.col(name)), F.lit(""))


def category(c: Column, first: Column) -> Column:
    table = F.create_map(*[F.lit(x) for item in CATEGORIES.items() for x in item])
    find = lambda x: F.try_element_at(table, F.lower(F.trim(F.coalesce(x, F.lit("")))))
    return F.coalesce(find(c), find(first), F.lit(FALLBACK))


def event_time(raw: Column, is_number: Column) -> Column:
    """A JSON number is epoch seconds, a text one of TIMES, naive ones UTC; a text of digits is neither."""
    texts = F.coalesce(*[F.try_to_timestamp(F.trim(raw), F.lit(p)) for p in TIMES])
    seconds = raw.try_cast("double")
    return F.when(is_number, F.when(F.abs(seconds) < 4e11, F.timestamp_micros((seconds * 1_000_000).cast("bigint")))).otherwise(texts)


def price(raw: Column) -> Column:
    x = F.bround(F.regexp_replace(F.trim(raw), "[$,]", "").try_cast("decimal(20,6)"), 2).try_cast("decimal(12,2)")
    return F.when(x >= 0, x)


def rating(raw: Column) -> Column:
    x = raw.try_cast("double")
    return F.when(x.between(1, 5), F.round(x, 1))


def verified(raw: Column) -> Column:
    return F.when(raw.isNull(), True).otherwise(F.lower(F.trim(raw)).isin("true", "1", "yes"))


def votes(raw: Column) -> Column:
    return F.greatest(F.lit(0), F.coalesce(raw.try_cast("double").try_cast("bigint"), F.lit(0)))


def numbered(raw: DataFrame) -> DataFrame:
    """raw with row_index where it has none (tables that come from no file): partition and place in it."""
    return raw if "row_index" in raw.columns else raw.withColumn("row_index", F.monotonically_increasing_id())


def canonicalize(raw: DataFrame, dataset_id: str = "d", mapping: dict[str, str] | None = None) -> DataFrame:
    """Every raw row (with row_index, see readers.in_file_order) as a canonical record, with reason: why it is rejected,
    or null. Rejected rows keep the columns that could be read."""
    rows = renamed(raw, mapping or {})
    asin = F.trim(F.coalesce("asin", F.lit("")))
    known = F.array(*map(F.lit, DEFAULT_MAPPING))
    when = event_time(F.col("timestamp"), F.col("number_time"))
    rate = rating(F.col("average_rating"))
    tests = [F.col("malformed"), asin == "", ~asin.rlike("^[A-Za-z0-9]{1,20}$"), when.isNull(), rate.isNull()]
    reason = reduce(lambda acc, x: F.when(x[0], x[1]).otherwise(acc), reversed(list(zip(tests, REASONS))), F.lit(None).cast("string"))
    attributes = F.map_filter(
        F.create_map(
            F.lit("raw_category"), text_of("main_category"),
            F.lit("categories"), F.to_json(F.slice("category_list", 1, 10)),
            F.lit("bought_in_last_month"), text_of("bought_in_last_month"),
            F.lit("extra_field_count"), F.size(F.array_except("keys", known)).cast("string"),
        ),
        lambda k, v: v.isNotNull(),
    )
    out = rows.select(
        "row_index",
        reason.alias("reason"),
        F.format_string("amz_%s_%s_%08d", F.lit(dataset_id), asin, F.col("row_index")).alias("record_id"),
        F.lit(dataset_id).alias("source"),
        asin.alias("source_record_id"),
        asin.alias("product_id"),
        category(F.col("main_category"), F.col("first_category")).alias("category"),
        F.substring(F.coalesce(text_of("title"), F.concat(F.lit("[No Title] "), asin)), 1, 512).alias("title"),
        F.substring(F.coalesce(text_of("brand"), text_of("store"), F.lit("Unknown")), 1, 128).alias("brand"),
        rate.alias("rating"),
        votes(F.coalesce("rating_number", "helpful_votes")).alias("helpful_votes"),
        verified(F.col("verified_purchase")).alias("verified_purchase"),
        when.alias("event_time"),
        price(F.col("price")).alias("price"),
        attributes.alias("attributes"),
        F.substring(F.sha2("line", 256), 1, 32).alias("raw_payload_hash"),
        F.lit("1.0.0").alias("schema_version"),
    )
    content = F.to_json(F.struct("source_record_id", "category", "title", "brand", "rating", "helpful_votes", "event_time", "price"))
    return out.withColumn("content_hash", F.substring(F.sha2(content, 256), 1, 32))


def deduplicated(accepted: DataFrame) -> DataFrame:
    """The first row of each source id. A partial aggregate finds the firsts, so no id's rows meet in a window."""
    first = accepted.groupBy("source_record_id").agg(F.min("row_index").alias("row_index"))
    return accepted.join(first, ["source_record_id", "row_index"], "left_semi")


def ingest(raw: DataFrame, dataset_id: str = "d", mapping: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """records, rejects (row_index, reason, hash of the id: no raw text), report and reasons."""
    rows = canonicalize(numbered(raw), dataset_id, mapping)
    accepted = rows.where("reason IS NULL")
    kept = deduplicated(accepted).drop("reason", "row_index")
    rejects = rows.where("reason IS NOT NULL").select("row_index", "reason", F.substring(F.sha2("source_record_id", 256), 1, 16).alias("id_hash"))
    ok = F.col("reason").isNull()
    report = rows.agg(
        F.count("*").alias("rows_read"),
        F.count_distinct(F.when(ok, F.col("source_record_id"))).alias("accepted"),
        F.count_if(~ok).alias("rejected"),
        (F.count_if(ok) - F.count_distinct(F.when(ok, F.col("source_record_id")))).alias("duplicates"),
        F.count_if(F.col("reason") == REASONS[0]).alias("malformed"),
        F.count_if(ok & F.col("price").isNull()).alias("null_price"),
    )
    return {"records": kept, "rejects": rejects, "report": report, "reasons": rejects.groupBy("reason").agg(F.count("*").alias("n"))}


def missingness(records: DataFrame, fields: tuple[str, ...] = ("price", "brand", "title", "category", "event_time", "rating")) -> DataFrame:
    """field, missing, ratio. Unknown brands and default titles count as missing."""
    gone = {"brand": F.col("brand") == "Unknown", "title": F.col("title").startswith("[No Title]")}
    wide = records.agg(F.count("*").alias("n"), *[F.count_if(F.col(f).isNull() | gone.get(f, F.lit(False))).alias(f) for f in fields])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("missing"), F.round(F.col(f) / F.nullif("n", F.lit(0)), 4).alias("ratio")) for f in fields])).alias("x")).select("x.*")


def snapshot_summary(records: DataFrame) -> DataFrame:
    """dimension, key, n of category, brand and rating; and the first and last time as keys of their own."""
    parts = [records.groupBy(F.col(d).cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit(d).alias("dimension"), "key", "n") for d in ("category", "brand", "rating")]
    ends = records.agg(F.min("event_time").alias("a"), F.max("event_time").alias("b"), F.count("*").alias("n"))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    parts += [ends.select(F.lit(d).alias("dimension"), shown(c).alias("key"), "n") for d, c in (("first_time", "a"), ("last_time", "b"))]
    return reduce(DataFrame.unionByName, parts)


def inspect(stored: DataFrame) -> DataFrame:
    """Files and rows of a table that was read from files."""
    return stored.select(F.col("_metadata.file_path").alias("f")).agg(F.count_distinct("f").alias("files"), F.count("*").alias("rows"))


def filing_facts(facts: DataFrame) -> DataFrame:
    """Filing facts with canonical_fact_hash and record_id."""
    parts = ["cik", "accession_number", "tag", "unit", "fiscal_year", "fiscal_period", "end_date"]
    h = F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in parts], F.coalesce(F.col("segment_id"), F.lit(""))), 256)
    out = facts.withColumn("canonical_fact_hash", F.substring(h, 1, 32))
    return out.withColumn("record_id", F.format_string("fact_%s_%s", F.col("cik"), F.substring("canonical_fact_hash", 1, 16)))


def latest(table: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key."""
    return table.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))).where("__r = 1").drop("__r")
