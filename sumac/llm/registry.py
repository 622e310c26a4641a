"""The registered queries of this subpackage: thin uses of its operators, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, table
from .decontaminate import contamination, hit_words
from .html import extract
from .lines import drop_later_runs
from .mixing import mix
from .mtree import search
from .phrases import collocations
from .quality import LEAST_GOOD, score, train
from .quality_rules import CLASS_LIMIT, CLASSES, COMMON, LEAST_CHARS, LEAST_WORDS, N_CLASSES, SYMBOLS, WORD_LIMIT, judge_quality
from .simhash import near_duplicates
from .substring import without_repeats
from .tokens import token_table
from .urls import judge, sites_named
from .whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("op3_simhash_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_duplicates(table(spark, sf_dir, "documents"))
    return classes.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query(
    "op4_mix_to_target_weights",
    r"""
    WITH d AS (
      SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
             len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS h
      FROM documents),
    s AS (
      SELECT key, sum(size)::BIGINT AS source_size, (2 * sum(size))::DOUBLE AS room,
             CASE (row_number() OVER (ORDER BY key) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
      FROM d GROUP BY key),
    k AS (
      SELECT room / weight AS fills_at,
             (1.5 * (SELECT sum(size) FROM d)
               - coalesce(sum(room) OVER (ORDER BY room / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / sum(weight) OVER (ORDER BY room / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
      FROM s),
    l AS (SELECT arg_min(level, fills_at) AS level FROM k WHERE level <= fills_at),
    t AS (SELECT key, source_size, least(room, weight * level) AS target FROM s, l),
    q AS (
      SELECT doc_id, size, source_size, target,
             coalesce(sum(size) OVER (PARTITION BY key ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
      FROM d JOIN t USING (key))
    SELECT doc_id, size, source_size, target,
           (greatest(0, least(size, floor(target)::BIGINT - b)) + greatest(0, least(size, floor(target)::BIGINT - b - source_size)))::BIGINT AS taken
    FROM q
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@query(
    "op5_benchmark_decontamination",
    r"""
    WITH d AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM documents),
    i AS (
      SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM benchmark),
    p AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS j FROM i WHERE len(w) > 0),
    windows AS (SELECT DISTINCT item_id, n, array_to_string(w[j : j + n - 1], ' ') AS t FROM p),
    starts AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS j FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
    hit AS (SELECT doc_id, j, a.n, item_id FROM (SELECT doc_id, n, j, array_to_string(w[j : j + n - 1], ' ') AS t FROM starts) a JOIN windows x ON a.t = x.t AND a.n = x.n),
    covered AS (SELECT doc_id, count(DISTINCT pos)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(j, j + n)) AS pos FROM hit) GROUP BY doc_id),
    named AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(k, ',' ORDER BY k) AS ks FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM hit) GROUP BY doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ks, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = hit_words()
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


@query(
    "op6_substring_dedup",
    r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    windows AS (SELECT doc_id, j, md5(array_to_string(w[j : j + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS j FROM d WHERE len(w) >= 35)),
    again AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
    gone AS (SELECT doc_id, list(DISTINCT pos) AS p FROM (SELECT doc_id, unnest(range(j, j + 35)) AS pos FROM windows JOIN again USING (h)) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(p), 0)::BIGINT AS n_removed,
           sha256(array_to_string(CASE WHEN p IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(p, i)) END, ' ')) AS kept_sha256
    FROM d LEFT JOIN gone USING (doc_id)
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeats(table(spark, sf_dir, "documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_token_ids")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_table(table(spark, sf_dir, "documents"), new_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"))
    return rows.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.col("crc").alias("ids_crc32"))


#: Fixed values of the url contract: host, path, action.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Names of sites that carry spam; the canonical URLs of all pages on them are the list.
SPAM_SITES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")


@query(
    "op10_url_filter",
    rf"""
    WITH u AS (SELECT page_id, CASE WHEN coalesce(strpos(url, '://'), 0) > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    p AS (
      SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
      FROM u),
    rules(h, q, action) AS (VALUES {", ".join(map(str, RULES))}),
    listed AS (
      SELECT DISTINCT regexp_replace(host, '^(?:www|m|blog)\.', '') AS h, regexp_replace(path, '(?:/|\.html?)$', '') AS q
      FROM p WHERE len(list_intersect(string_split(host, '.'), [{", ".join(f"'{x}'" for x in SPAM_SITES)}])) > 0),
    fit AS (
      SELECT page_id, arg_max(h || q, length(h || q)) AS rule, arg_max(action, length(h || q)) AS action
      FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id),
    bad AS (SELECT DISTINCT page_id FROM p JOIN listed ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
    SELECT p.page_id, host, path, rule, coalesce(action, CASE WHEN bad.page_id IS NOT NULL THEN 'block' END, 'allow') AS verdict
    FROM p LEFT JOIN fit USING (page_id) LEFT JOIN bad USING (page_id)
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, RULES))} AS t(host, path, action)")
    found = judge(pages, rules, sites_named(pages, SPAM_SITES))
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


@query("op1_main_text")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op2_quality_classifier")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    rated = score(docs.select("doc_id", "text"), model)
    return rated.select("doc_id", "expected_grade", "good", (F.col("good") >= LEAST_GOOD).alias("kept"))


def sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


BINS = len(COMMON["en"]) + 1
CLASS_COUNTS = ", ".join(f"len(regexp_extract_all(t, {sql_text(c)}))" for c in CLASSES)
COMMON_ROWS = ", ".join(f"({sql_text(k)}, {i + 1}, {sql_text(w)})" for k, ws in COMMON.items() for i, w in enumerate(ws))


def sql_distance(counts: str, ref: str, n: int) -> str:
    """Jensen-Shannon distance of a list of counts and a list of reference shares, as SQL."""
    p, q = f"({counts}[i] / list_sum({counts}))", f"{ref}[i]"
    part = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0.0 END"
    return f"sqrt(greatest(0.0, list_sum(list_transform(range(1, {n + 1}), lambda i: ({part(p, q)} + {part(q, p)}) / 2))))"


@query(
    "op8_quality_rules",
    rf"""
    WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    win AS (SELECT doc_id, j, array_to_string(w[j : j + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS j FROM d WHERE len(w) >= 5)),
    rep AS (
      SELECT doc_id, count(DISTINCT pos) AS n FROM (
        SELECT doc_id, unnest(range(j, j + 5)) AS pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS c FROM win) WHERE c > 1)
      GROUP BY doc_id),
    f AS (
      SELECT doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, {sql_text(SYMBOLS)})) AS n_symbols,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, length(t) AS n_chars, strlen(t) AS n_bytes, [{CLASS_COUNTS}] AS k
      FROM d),
    fixed(lang, i, word) AS (VALUES {COMMON_ROWS}),
    hits AS (
      SELECT doc_id, i, count(*) AS n FROM (SELECT doc_id, lang, lower(unnest(w)) AS word FROM d) JOIN fixed USING (lang, word) GROUP BY doc_id, i),
    found AS (SELECT doc_id, map(list(i), list(n)) AS m, sum(n) AS n FROM hits GROUP BY doc_id),
    h AS (
      SELECT f.*, coalesce(rep.n, 0) AS n_repeat_words, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             [n_chars - word_chars, n_symbols, k[1], k[2], k[3], k[4], n_bytes - n_chars, word_chars - n_symbols - k[1] - k[2] - k[3] - k[4]]::DOUBLE[] AS classes,
             (list_transform(range(1, {BINS}), lambda i: coalesce(m[i], 0)) || [n_words - coalesce(found.n, 0)])::DOUBLE[] AS common
      FROM f LEFT JOIN rep USING (doc_id) LEFT JOIN found USING (doc_id)),
    sums AS (
      SELECT lang, [{", ".join(f"sum(classes[{i}])" for i in range(1, N_CLASSES + 1))}] AS a, [{", ".join(f"sum(common[{i}])" for i in range(1, BINS + 1))}] AS b
      FROM h WHERE NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lang IN ({", ".join(map(sql_text, COMMON))}) GROUP BY lang),
    refs AS (SELECT lang, list_transform(a, lambda x: x / list_sum(a)) AS ra, list_transform(b, lambda x: x / list_sum(b)) AS rb FROM sums),
    j AS (
      SELECT h.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
             CASE WHEN ra IS NOT NULL AND n_chars > 0 THEN {sql_distance("classes", "ra", N_CLASSES)} END AS cd,
             CASE WHEN rb IS NOT NULL AND n_words > 0 THEN {sql_distance("common", "rb", BINS)} END AS wd
      FROM h LEFT JOIN refs USING (lang))
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
           n_repeat_words::BIGINT AS n_repeat_words, base_failed,
           NOT base_failed AND NOT (coalesce(n_chars >= {LEAST_CHARS} AND cd > {CLASS_LIMIT}, FALSE) OR coalesce(n_words >= {LEAST_WORDS} AND wd > {WORD_LIMIT}, FALSE)) AS kept
    FROM j
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query(
    "op7_line_dedup",
    r"""
    WITH raw AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    every AS (SELECT doc_id, i, trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM raw)),
    lines AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM every WHERE line <> ''),
    d AS (SELECT doc_id, list(line ORDER BY pos) AS l FROM lines GROUP BY doc_id),
    runs AS (SELECT doc_id, s, n, md5(array_to_string(l[s : s + n - 1], chr(10))) || n AS h
             FROM (SELECT doc_id, l, least(len(l), 3) AS n, unnest(range(1, len(l) - least(len(l), 3) + 2)) AS s FROM d)
             UNION ALL SELECT doc_id, pos + 1, 1, md5(line) || 1 FROM lines JOIN d USING (doc_id)
             WHERE len(l) > 1 AND len(string_split_regex(line, '[ \x09\x0B\x0C\x0D]+')) >= 10),
    later AS (SELECT doc_id, s, n FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS k FROM runs) WHERE k > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(s - 1, s + n - 1)) AS pos FROM later),
    t AS (
      SELECT e.doc_id, e.i, e.line = '' AS blank, sum(CASE WHEN e.line <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY e.doc_id ORDER BY e.i) - 1 AS pos
      FROM every e),
    k AS (
      SELECT t.doc_id, string_agg(r.ls[t.i], chr(10) ORDER BY t.i) FILTER (t.blank OR g.pos IS NULL) AS kept,
             count(*) FILTER (NOT t.blank) AS n_lines, count(*) FILTER (NOT t.blank AND g.pos IS NOT NULL) AS n_removed
      FROM t JOIN raw r ON r.doc_id = t.doc_id LEFT JOIN gone g ON g.doc_id = t.doc_id AND g.pos = t.pos GROUP BY t.doc_id)
    SELECT doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drop_later_runs(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


@query(
    "op11_exact_top_k",
    """
    WITH e AS (SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    s AS (SELECT q.vec_id AS query_id, e.vec_id, list_sum(list_transform(range(1, len(e.x) + 1), lambda i: e.x[i] * q.x[i]))::BIGINT AS score
          FROM e JOIN e q ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id)
    SELECT query_id, rank::INT AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query("op12_embedding_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


@query(
    "op13_phrase_collocations",
    r"""
    WITH d AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]') AS ps FROM documents),
    pieces AS (SELECT lang, regexp_extract_all(p, '[^ 	]+') AS w FROM (SELECT lang, unnest(ps) AS p FROM d)),
    total AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM pieces GROUP BY lang),
    grams AS (
      SELECT lang, m, array_to_string(w[j : j + m - 1], ' ') AS g
      FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS j FROM pieces, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m)),
    f AS (SELECT lang, m, g, count(*)::HUGEINT AS a FROM grams GROUP BY lang, m, g HAVING count(*) >= 100),
    c AS (SELECT lang, m, g, a, string_split(g, ' ') AS w FROM f WHERE m > 1),
    cuts AS (SELECT lang, m, g, a, k, array_to_string(w[1 : k], ' ') AS x, array_to_string(w[k + 1 : m], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
    s AS (SELECT cuts.*, l.a AS l, r.a AS r, n, (1000 * cuts.a * n) // (l.a * r.a) AS score
          FROM cuts JOIN f l ON l.lang = cuts.lang AND l.g = x JOIN f r ON r.lang = cuts.lang AND r.g = y JOIN total ON total.lang = cuts.lang),
    low AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS o FROM s) WHERE o = 1),
    inside AS (SELECT DISTINCT lang, array_to_string(w[j : j + q - 1], ' ') AS g, a
               FROM (SELECT lang, m, w, a, q, unnest(range(1, m - q + 2)) AS j FROM c, (SELECT unnest(range(2, 5)) AS q) WHERE q < m)),
    kept AS (SELECT * FROM low WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = low.lang AND i.g = low.g AND i.a >= low.a))
    SELECT lang, rank, g AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
    FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(g)) AS rank FROM kept) WHERE rank <= 2000
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
