"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Bits of the filter a listed URL, and the 64-bit lanes of a block; each key sets one bit in each lane.
BITS_PER_KEY = 16
LANES = 8
#: Blocks at least, so that a short list is still dealt over many join keys.
LEAST_BLOCKS = 1024
#: Tasks over which the urls that ask for one key are dealt.
SALTS = 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: behind the first :// up to /, ?, # or the end, A-Z lower-cased. Path: then up to ?, # or the end.
    Both are empty for null and for a url without ://."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def suffixes(host: Column, sizes: list[int]) -> Column:
    """The host or the domain above it of each listed number of labels that it has."""
    dots = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))
    some = F.filter(F.array(*map(F.lit, sizes)), lambda n: n <= dots + 1) if sizes else F.array().cast("array<int>")
    return F.transform(some, lambda n: F.call_function("substring_index", host, F.lit("."), -n))


def probe(key: Column, blocks: int) -> tuple[Column, Column]:
    """The block of a key, and its bit in each lane."""
    h = F.xxhash64(key, F.lit(1))
    block = F.pmod(F.xxhash64(key), F.lit(blocks))
    lanes = F.array_repeat(F.lit(1).cast("long"), LANES)
    return block, F.transform(lanes, lambda one, i: F.call_function("shiftleft", one, F.pmod(F.call_function("shiftright", h, i * 6), F.lit(64)).cast("int")))


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter as a table: a row for each block with a bit set. keys: column key."""
    block, bits = probe(F.col("key"), blocks)
    rows = keys.select(block.alias("block"), bits.alias("bits"))
    ors = F.array(*[F.bit_or(F.col("bits")[i]) for i in range(LANES)])
    return rows.groupBy("block").agg(ors.alias("filter"))


def dealt(asked: DataFrame, known: DataFrame, on: str | list[str]) -> DataFrame:
    """Joins rows of urls (host, path, ...) with a table on some columns. Every row of the table comes in SALTS copies,
    so that urls which ask for one key, such as all of a common domain, are dealt over so many tasks."""
    on = [on] if isinstance(on, str) else on
    copies = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return asked.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS))).join(copies, [*on, "salt"]).drop("salt")


def possible(asked: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """The rows of asked (host, path, key, ...) whose key may be among n keys: blocked Bloom filter, no false negatives."""
    blocks = max(LEAST_BLOCKS, -(-n * BITS_PER_KEY // (64 * LANES)))
    block, bits = probe(F.col("key"), blocks)
    found = dealt(asked.withColumn("block", block).withColumn("bits", bits), bloom_blocks(keys, blocks), "block")
    return found.where(F.forall(F.zip_with("bits", "filter", lambda b, f: b.bitwiseAND(f) == b), lambda x: x)).drop("block", "bits", "filter", "key")


def listed(urls: DataFrame, entries: DataFrame) -> DataFrame:
    """Every pair of a (host, path) of urls and a list entry that fits it.

    urls: distinct host, path. entries: host, path and any further columns; an entry fits its host and all
    its subdomains, where the path starts with the entry's. Each url asks a filter for its host and the domains
    above it that have a listed number of labels, then, for those that may be listed, another for every prefix
    of its path that has a listed length; the possible hits, few besides the true ones, meet the entries in an
    exact equi-join. A host of any number of labels asks for as many domains as there are listed numbers.
    """
    entries = cut(entries)
    size = entries.agg(F.count("*").alias("n"), F.collect_set(F.size(F.split("host", "\\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")).first()
    labels, lengths = sorted(size["labels"]), sorted(size["lengths"])  # small numbers: of labels and of characters of a path
    heads = F.filter(F.array(*map(F.lit, lengths)), lambda x: x <= F.length("path")) if lengths else F.array().cast("array<int>")
    asked = urls.select("host", "path", F.explode(suffixes(F.col("host"), labels)).alias("domain"))
    asked = possible(asked.withColumn("key", F.col("domain")), entries.select(F.col("host").alias("key")).distinct(), size["n"])
    asked = asked.select("host", "path", "domain", F.explode(F.transform(heads, lambda x: F.substr("path", F.lit(1), x))).alias("head"))
    asked = possible(asked.withColumn("key", F.concat("domain", "head")), entries.select(F.concat("host", "path").alias("key")).distinct(), size["n"])
    own = [c for c in entries.columns if c not in ("host", "path")]
    exact = entries.select(F.col("host").alias("domain"), F.col("path").alias("head"), *own)
    return dealt(asked, exact, ["domain", "head"])


def canonical(host: Column, path: Column) -> tuple[Column, Column]:
    """A host without a leading www, m or blog label, and a path without a slash or file ending at its end."""
    return F.regexp_replace(host, r"^(?:www|m|blog)\.", ""), F.regexp_replace(path, r"(?:/|\.html?)$", "")


def sites_named(pages: DataFrame, names: tuple[str, ...], url_col: str = "url") -> DataFrame:
    """A list made from pages: the canonical URLs (host, path) of all pages on hosts with one of the names as a label."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(host.alias("host"), path.alias("path")).distinct()
    named = F.arrays_overlap(F.split("host", "\\."), F.array(*map(F.lit, names)))
    host, path = canonical(F.col("host"), F.col("path"))
    return rows.where(named).select(host.alias("host"), path.alias("path")).distinct()


def judge(pages: DataFrame, rules: DataFrame, blocked: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A verdict for every page.

    rules: host, path, action (allow or block). blocked: host, path of listed canonical URLs. The longest
    rule that fits decides (of equal length the longer host, then block); without one, a listed URL that
    fits blocks, and anything else is allowed.

    Returns per row: id, url, host, path, rule (host and path, or null), verdict, listed (boolean). Null entries
    of a list are passed over. Null, empty and odd urls have empty host and path, and no rule fits them unless its host is empty too. The
    work is done once for each distinct host and path, so a page that fills a third of the table counts once.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    entries = rules.select("host", "path", "action").unionByName(blocked.select("host", "path", F.lit("listed").alias("action")))
    hits = listed(rows.select("host", "path").distinct(), entries.where("host IS NOT NULL AND path IS NOT NULL"))
    rule = F.struct((F.length("domain") + F.length("head")).alias("n"), F.length("domain").alias("h"), "action", F.concat("domain", "head").alias("rule"))
    best = hits.groupBy("host", "path").agg(F.max(F.when(F.col("action") != "listed", rule)).alias("best"), F.bool_or(F.col("action") == "listed").alias("listed"))
    rows = rows.join(cut(best), ["host", "path"], "left")
    verdict = F.coalesce(F.col("best.action"), F.when(F.col("listed"), F.lit("block")), F.lit("allow"))
    return rows.select("id", "url", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("listed", F.lit(False)).alias("listed"))
