"""A workload of query specs: drawn parameters, validity, splits and packs of the templates."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import stored
from ..operators import aggregates as A
from ..operators import predicates as P
from ..operators.condense import condense, within_passes
from ..operators.evidence import eligible_counts
from .templates import DRAWN, MAKERS, TEMPLATES, Draws, Missing, Template

#: Templates on filing facts: form counts, fact means and sums, top companies, yearly trend.
FILING = [
    ("filing_form_count", A.Count(), "form_type"),
    ("filing_tag_count", A.Count(), "tag"),
    ("filing_tag_mean", A.Mean("value", places=2), "tag"),
    ("filing_tag_sum", A.Sum("value"), "tag"),
    ("filing_companies", A.Count("cik"), "form_type"),
    ("filing_top_companies", A.TopK("cik", 5, "sum", "value"), "tag"),
    ("filing_trend", A.Trend("year", "sum", "value", time="filing_date"), "tag"),
]

#: Fields of the records with_shares that templates name.
FIELDS = ["category", "brand", "rating", "helpful_votes", "verified_purchase", "event_time", "price", "five_star", "no_price"]


SEED = 42


def draw_keys(per_template: int, seed: int = SEED) -> list[tuple[str, str, int, str]]:
    """Template, field and number of every draw, and the text that decides it."""
    return [(t.template_id, field, n, f"{seed}|{t.template_id}|{n}|{field}") for t in TEMPLATES for n in range(per_template) for field in DRAWN]


def drawn_values(df: DataFrame, per_template: int, seed: int = SEED) -> DataFrame:
    """template_id, n, field, first, second: for every draw, of all distinct categories, brands and years the two with
    the least hashes of the draw's key and the value. The keys are a fixed set; the values stay in Spark."""
    df = df.select(*[(F.year("event_time") if f == "year" else F.col(f)).cast("string").alias(f) for f in DRAWN]).distinct()
    texts = [F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in DRAWN]
    values = df.select(F.explode(F.array(*texts)).alias("x")).select("x.*").where("v IS NOT NULL").distinct()
    keys = df.sparkSession.createDataFrame(draw_keys(per_template, seed), "template_id string, field string, n int, k string")
    pairs = values.join(F.broadcast(keys), "field").withColumn("x", F.struct(F.sha2(F.concat_ws("|", "k", "v"), 256).alias("h"), "v"))
    ids = ["template_id", "n", "field"]
    first = pairs.groupBy(*ids, "k").agg(F.min("x").alias("x"))
    others = pairs.withColumnRenamed("x", "y").join(first, [*ids, "k"]).where("y.v <> x.v")
    second = others.groupBy(*ids).agg(F.min("y").alias("y"))
    return first.join(second, ids, "left").select(*ids, F.col("x.v").alias("first"), F.col("y.v").alias("second"))


def build(t: Template, d: Draws) -> A.Query | None:
    """The query of a draw; None if the records lack a value for it."""
    try:
        spec, scope = MAKERS[t.template_id](d)
    except Missing:
        return None
    tags = {"template_id": t.template_id, "family": t.family, "difficulty": t.difficulty, "selectivity": t.selectivity, "question": t.question.format(**d.words)}
    q = A.Query("", spec, scope, (), tags)
    return replace(q, query_id=f"q_{A.spec_hash(q)[:16]}")


def built(df: DataFrame, per_template: int, seed: int = SEED) -> list[tuple[Template, int, A.Query]]:
    """All draws of all templates that the records have values for."""
    found: dict[tuple[str, int], dict[str, tuple]] = {}
    for r in drawn_values(df, per_template, seed).collect():  # a row a draw and field
        found.setdefault((r["template_id"], r["n"]), {})[r["field"]] = (r["first"], r["second"])
    out = [(t, n, build(t, Draws(t.template_id, n, seed, found.get((t.template_id, n), {})))) for t in TEMPLATES for n in range(per_template)]
    return [x for x in out if x[2] is not None]


def needed(q: A.Query) -> int:
    """Records that a valid query has in scope: one, as many as its k, or none where the template wants none."""
    return 0 if q.tags["template_id"] == "cnt_empty_scope" else q.aggregation.k if isinstance(q.aggregation, A.TopK) else 1


def instances(df: DataFrame, family: str | None = None, seed: int = SEED) -> list[A.Query]:
    """The first draw of every template, under the template's id."""
    return [replace(q, query_id=t.template_id) for t, _, q in built(df, 1, seed) if family in (None, t.family)]


def registry(df: DataFrame, seed: int = SEED) -> DataFrame:
    """The templates, with the records that the first draw of each has in scope (null without a draw) and whether it is valid."""
    spark = df.sparkSession
    rows = [(t.template_id, t.family, t.question, t.difficulty, t.selectivity, t.null_risk, t.tie_risk, t.temporal_risk) for t in TEMPLATES]
    table = spark.createDataFrame(rows, "template_id string, family string, question string, difficulty string, selectivity string, null_risk string, tie_risk string, temporal_risk string")
    queries = instances(df, seed=seed)
    least = spark.createDataFrame([(q.query_id, needed(q)) for q in queries], "query_id string, needed int")
    counts = eligible_counts(with_shares(df), queries).join(least, "query_id").select(F.col("query_id").alias("template_id"), "eligible", (F.col("eligible") >= F.col("needed")).alias("valid"))
    return table.join(counts, "template_id", "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


def answers(df: DataFrame, family: str, seed: int = SEED) -> DataFrame:
    """Results of the first draw of every template of a family, if it is valid."""
    df, queries = with_shares(df), instances(df, family, seed)
    found = {r["query_id"]: r["eligible"] for r in eligible_counts(df, queries).collect()}  # a row a template
    return A.evaluate_batch(df, [q for q in queries if found[q.query_id] >= needed(q)])


def with_shares(df: DataFrame) -> DataFrame:
    """Records with five_star and no_price, 1 or 0: their means are shares that some templates ask for."""
    return df.withColumns({"five_star": F.when(F.col("rating") == 5.0, 1.0).otherwise(0.0), "no_price": F.when(F.col("price").isNull(), 1.0).otherwise(0.0)})


def split_of(spec_hash: str) -> str:
    """By the first four hex digits: eight in ten dev, one val, one test."""
    k = int(spec_hash[:4], 16) % 10
    return "dev" if k < 8 else "val" if k == 8 else "test"


def candidates(df: DataFrame, per_template: int = 3, seed: int = SEED) -> list[A.Query]:
    """Distinct queries."""
    return list({A.spec_hash(q): q for _, _, q in built(df, per_template, seed)}.values())


def valid(classes: DataFrame, queries: list[A.Query]) -> list[A.Query]:
    """The valid ones of the queries, counted in their classes (see condense)."""
    found = {r["query_id"]: r["eligible"] for r in eligible_counts(classes, within_passes(queries)).collect()}  # a row a query
    return [q for q in queries if found[q.query_id] >= needed(q)]


def workload(df: DataFrame, per_template: int = 3, seed: int = SEED) -> list[A.Query]:
    """Distinct, valid queries."""
    df = stored(with_shares(df).select(*FIELDS))
    queries = candidates(df, per_template, seed)
    return valid(condense(df, queries), queries)


def workload_table(spark: SparkSession, queries: list[A.Query]) -> DataFrame:
    rows = [(q.query_id, A.spec_hash(q), split_of(A.spec_hash(q)), *(q.tags[k] for k in ("template_id", "family", "difficulty", "question"))) for q in queries]
    return spark.createDataFrame(rows, "query_id string, spec_hash string, split string, template_id string, family string, difficulty string, question string")


def pack(table: DataFrame, statuses: DataFrame | None = None) -> DataFrame:
    """dimension, key, n: queries by family, difficulty, split and, if known, agreement (no_rows: neither side has a row)."""
    dims = ["family", "difficulty", "split"]
    if statuses is not None:
        table, dims = table.join(statuses.select("query_id", F.col("status").alias("agreement")), "query_id", "left").fillna("no_rows", ["agreement"]), [*dims, "agreement"]
    rows = table.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("key")) for d in dims])).alias("x"))
    return rows.groupBy("x.dimension", "x.key").agg(F.count("*").alias("n"))


class SqlDraws(Draws):
    """The draws as SQL text over a table drawn_from (field, v) of the distinct values."""

    def __init__(self, template_id: str, n: int, seed: int = SEED):
        super().__init__(template_id, n, seed, {})
        self.prefix = f"{seed}|{template_id}|{n}|"

    def some(self, field: str, which: int = 0) -> P.Sql:
        other = f" AND v <> {self.some(field).text}" if which else ""
        return P.Sql(f"(SELECT arg_min(v, sha256('{self.prefix}{field}|' || v)) FROM drawn_from WHERE field = '{field}'{other})")

    def day(self, year: P.Sql, month: int, day: int, later: int = 0) -> P.Sql:
        return P.Sql(f"make_timestamp(CAST({year.text} AS BIGINT) + {later}, {month}, {day}, 0, 0, 0.0)")


#: Tables for the statements below: asked, the records with_shares, and drawn_from. It continues a WITH clause that has records.
SQL_TABLES = """, asked AS (SELECT *, CASE WHEN rating = 5.0 THEN 1.0 ELSE 0.0 END AS five_star, CASE WHEN price IS NULL THEN 1.0 ELSE 0.0 END AS no_price FROM records),
    drawn_from AS (SELECT DISTINCT 'category' AS field, category AS v FROM records UNION ALL SELECT DISTINCT 'brand', brand FROM records
      UNION ALL SELECT DISTINCT 'year', CAST(year(event_time) AS STRING) FROM records) """


def sql_instances() -> list[tuple[Template, A.Query, str, str]]:
    """The first draw of every template: its query, the number of records in scope and its validity, as SQL."""
    out = []
    for t in TEMPLATES:
        q = replace(build_sql(t), query_id=t.template_id)
        n = f"(SELECT COUNT(*) FROM asked WHERE {P.to_sql(q.scope)})"
        out.append((t, q, n, f"{n} >= {needed(q)}"))
    return out


def build_sql(t: Template) -> A.Query:
    spec, scope = MAKERS[t.template_id](SqlDraws(t.template_id, 0))
    return A.Query(t.template_id, spec, scope, (), {"template_id": t.template_id})


def answers_sql(family: str) -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({A.to_sql(q, 'asked')}) x WHERE {valid}" for t, q, _, valid in sql_instances() if t.family == family)


def registry_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = [(t, n, valid) for t, _, n, valid in sql_instances()]
    return " UNION ALL ".join(
        f"SELECT {quoted(t.template_id)} AS template_id, '{t.family}' AS family, {quoted(t.question)} AS question, '{t.difficulty}' AS difficulty, '{t.selectivity}' AS selectivity, "
        f"'{t.null_risk}' AS null_risk, '{t.tie_risk}' AS tie_risk, '{t.temporal_risk}' AS temporal_risk, {n} AS eligible, {valid} AS valid"
        for t, n, valid in rows
    )


def draws_sql(per_template: int, seed: int = SEED) -> str:
    ids = ", ".join(f"'{t.template_id}'" for t in TEMPLATES)
    return f"""SELECT template_id, n, field, MIN(v) FILTER (place = 1) AS first, MIN(v) FILTER (place = 2) AS second FROM (
      SELECT template_id, CAST(n AS INT) AS n, field, v, ROW_NUMBER() OVER (PARTITION BY template_id, n, field ORDER BY sha256('{seed}|' || template_id || '|' || n || '|' || field || '|' || v)) AS place
      FROM (SELECT unnest([{ids}]) AS template_id), (SELECT unnest(range({per_template})) AS n), drawn_from) GROUP BY ALL"""
