"""Statistics of runs and experiments."""

from __future__ import annotations

from itertools import accumulate
from math import exp, factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import uniform, uniform_sql
from ..functions.shared import cut
from .retrieval import few, row_numbers


def ratio(a: Column, b: Column) -> Column:
    return F.round(a / F.nullif(b, F.lit(0)), 6)


def run_metrics(runs: DataFrame, *by: str) -> DataFrame:
    """Samples, failures, missing answers, accuracy, mean loss, certified rate, selective risk, false
    certification, latency and cost. runs: status, is_correct, loss, decision, latency_ms, cost, and by."""
    done = F.col("status") == "completed"
    said = done & F.col("decision").isin("certified", "partial")
    certified = done & (F.col("decision") == "certified")
    wrong = ~F.col("is_correct")
    rows = runs.groupBy(*by) if by else runs
    return rows.agg(
        F.count("*").alias("samples"),
        F.count_if(F.col("status") == "failed").alias("failures"),
        F.count_if(done & F.col("is_correct").isNull()).alias("missing"),
        ratio(F.count_if(done & F.col("is_correct")), F.count_if(done)).alias("accuracy"),
        F.round(F.avg(F.when(done, F.col("loss"))), 6).alias("mean_loss"),
        ratio(F.count_if(certified), F.count_if(done)).alias("certified_rate"),
        ratio(F.count_if(said & wrong), F.count_if(said)).alias("selective_risk"),
        ratio(F.count_if(certified & wrong), F.count_if(certified)).alias("false_certification"),
        F.round(F.avg(F.when(done, F.col("latency_ms"))), 4).alias("latency_ms"),
        F.round(F.sum("cost"), 4).alias("cost"),
    )


def field_scores(extracted: DataFrame, gold: DataFrame, fields: list[str]) -> DataFrame:
    """field, tp, fp, fn, accuracy and f1 of extracted cells against gold ones (record_id and the fields)."""
    cell = lambda df, n: df.select("record_id", F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))])).alias("field", n))
    both = cell(extracted, "e").join(cell(gold, "g"), ["record_id", "field"], "full_outer")
    tp, fp, fn = (F.count_if(c) for c in (F.col("e") == F.col("g"), F.col("e").isNotNull() & ~F.col("e").eqNullSafe(F.col("g")), F.col("g").isNotNull() & ~F.col("e").eqNullSafe(F.col("g"))))
    rows = both.groupBy("field").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.count_if(F.col("e").eqNullSafe(F.col("g"))).alias("same"), F.count("*").alias("cells"))
    return rows.select("field", "tp", "fp", "fn", ratio(F.col("same"), F.col("cells")).alias("accuracy"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def by_cell(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean of a value by keys, such as accuracy by pipeline and scale."""
    return runs.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(F.col(value).cast("double")), 6).alias(f"mean_{value}"))


def boxes(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Five numbers of a value for each key, by a mergeable sketch."""
    return rows.groupBy(key).agg(*[F.percentile_approx(value, q, F.lit(10000)).alias(n) for q, n in ((0.0, "low"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1.0, "high"))])


def mean_shares(runs: DataFrame, by: str) -> DataFrame:
    """Mean shares of the loss by stage of completed runs: by, attributed, mean_phi_r, mean_phi_e, mean_phi_a."""
    done = runs.where("status = 'completed' AND phi_r IS NOT NULL")
    return done.groupBy(by).agg(F.count("*").alias("attributed"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("phi_r", "phi_e", "phi_a")])


def by_coverage(rows: DataFrame, by: str) -> DataFrame:
    """Mean loss by tenth of the least coverage ratio. rows: by, the ratios of certificates, loss."""
    tenth = F.floor(F.least("scope_ratio", "extraction_ratio", "field_ratio") * 10).cast("int")
    return rows.groupBy(by, tenth.alias("tenth")).agg(F.count("*").alias("runs"), F.round(F.avg("loss"), 6).alias("mean_loss"))


def by_latency(runs: DataFrame, by: str, step: float) -> DataFrame:
    """Accuracy and mean loss of completed runs by steps of latency."""
    done = runs.where("status = 'completed'").groupBy(by, F.floor(F.col("latency_ms") / step).cast("int").alias("step"))
    return done.agg(F.count("*").alias("runs"), F.round(F.avg(F.col("is_correct").cast("int")), 6).alias("accuracy"), F.round(F.avg("loss"), 6).alias("mean_loss"))


def repair_benefit(rows: DataFrame, by: str) -> DataFrame:
    """Certified rate and mean loss by number of repairs, and the loss against runs without one. rows: by, repairs, decision, loss."""
    out = rows.groupBy(by, "repairs").agg(F.count("*").alias("runs"), F.round(F.avg((F.col("decision") == "certified").cast("int")), 6).alias("certified_rate"), F.avg("loss").alias("mean"))
    none = out.where("repairs = 0").select(by, F.col("mean").alias("none"))
    return out.join(none, by, "left").select(by, "repairs", "runs", "certified_rate", F.round("mean", 6).alias("mean_loss"), F.round(F.col("mean") - F.col("none"), 6).alias("loss_against_none"))


def pairs(a: DataFrame, b: DataFrame, value: str = "loss") -> DataFrame:
    """query_id, pipeline_id, a, b of two experiments' completed runs; several runs of a cell are averaged."""
    one = lambda df, n: df.where("status = 'completed'").groupBy("query_id", "pipeline_id").agg(F.avg(value).alias(n))
    return one(a, "a").join(one(b, "b"), ["query_id", "pipeline_id"])


def effect(paired: DataFrame) -> DataFrame:
    """One row: pairs, mean difference, its standard deviation (n - 1) and Cohen's d (deviation 0 counts as 1)."""
    d = F.col("a") - F.col("b")
    rows = paired.agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"))
    sd = F.when(F.coalesce("sd", F.lit(0.0)) == 0, 1.0).otherwise(F.col("sd"))
    return rows.select("n", F.round("mean", 6).alias("mean_difference"), F.round(F.coalesce("sd", F.lit(0.0)), 6).alias("sd"), F.round(F.col("mean") / sd, 6).alias("cohens_d"))


#: A Poisson(1) count is the number of these that a uniform draw reaches: sums of its probabilities.
POISSON = list(accumulate(exp(-1) / factorial(k) for k in range(12)))


def poisson(u: Column) -> Column:
    """A Poisson(1) count from a uniform draw."""
    return sum((F.when(u >= e, 1).otherwise(0) for e in POISSON), start=F.lit(0))


def bootstrap_interval(paired: DataFrame, key: list[str], samples: int = 1000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """One row: mean difference and its percentile interval by a Poisson bootstrap of the units that key names (such as
    queries): each has a drawn weight in each replicate. Rows are added up by unit first, so replicates multiply units
    and not rows, and every replicate is one partial sum."""
    rows = paired.groupBy(*key).agg(F.sum(F.col("a") - F.col("b")).alias("d"), F.count(F.col("a") - F.col("b")).alias("n"))
    rows = cut(rows)
    drawn = rows.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(samples)))).withColumn("w", poisson(uniform(seed, *[F.col(k) for k in key], F.col("r"))))
    means = drawn.where("w > 0").groupBy("r").agg((F.sum(F.col("w") * F.col("d")) / F.sum(F.col("w") * F.col("n"))).alias("m"))
    low, high = (1 - confidence) / 2, (1 + confidence) / 2
    ends = means.agg(F.percentile("m", F.lit(low)).alias("low"), F.percentile("m", F.lit(high)).alias("high"))
    return rows.agg((F.sum("d") / F.sum("n")).alias("mean_difference")).crossJoin(ends)  # two single rows


def bootstrap_sql(paired: str, key: list[str], samples: int = 1000, confidence: float = 0.95, seed: int = 42) -> str:
    """The interval as SQL over a table with key, a and b."""
    by, u = ", ".join(key), uniform_sql(f"'{seed}'", *key, "r")
    low, high = (1 - confidence) / 2, (1 + confidence) / 2
    edges = " + ".join(f"CASE WHEN u >= {e!r} THEN 1 ELSE 0 END" for e in POISSON)
    return f"""(WITH units AS (SELECT {by}, SUM(a - b) AS d, COUNT(a - b) AS n FROM {paired} GROUP BY {by}),
      drawn AS (SELECT d, n, r, {edges} AS w FROM (SELECT *, {u} AS u FROM units, (SELECT unnest(range(1, {samples + 1})) AS r))),
      means AS (SELECT r, SUM(w * d) / SUM(w * n) AS m FROM drawn WHERE w > 0 GROUP BY r)
      SELECT (SELECT SUM(d) / SUM(n) FROM units) AS mean_difference, quantile_cont(m, {low}) AS low, quantile_cont(m, {high}) AS high FROM means)"""


def resampled_interval(paired: DataFrame, key: list[str], samples: int = 1000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """One row: mean difference and its percentile interval by exact resampling: each replicate draws as many units as there are,
    with replacement, by a hash of its own number and the draw's. Units are numbered in order of key. For small numbers of units,
    where Poisson weights leave replicates of uneven size; the cost is samples times units, spread over all tasks. Without units
    all three are null."""
    rows = paired.groupBy(*key).agg(F.sum(F.col("a") - F.col("b")).alias("d"), F.count(F.col("a") - F.col("b")).alias("n"))
    rows = cut(row_numbers(rows, key, "i").select("i", "d", "n"))
    units = rows.count()
    r, k = F.floor(F.col("id") / max(1, units)) + 1, F.col("id") % max(1, units)
    draws = paired.sparkSession.range(samples * units).select(r.alias("r"), k.alias("k"))
    draws = draws.select("r", F.floor(uniform(seed, F.col("r"), F.col("k")) * units).alias("i"))
    means = draws.join(few(rows), "i").groupBy("r").agg((F.sum("d") / F.nullif(F.sum("n"), F.lit(0))).alias("m"))
    low, high = (1 - confidence) / 2, (1 + confidence) / 2
    ends = means.agg(F.percentile("m", F.lit(low)).alias("low"), F.percentile("m", F.lit(high)).alias("high"))
    return rows.agg((F.sum("d") / F.nullif(F.sum("n"), F.lit(0))).alias("mean_difference")).crossJoin(ends)  # two single rows


def resampled_sql(paired: str, key: list[str], samples: int = 1000, confidence: float = 0.95, seed: int = 42) -> str:
    """The interval as SQL over a table with key, a and b."""
    by, u = ", ".join(key), uniform_sql(f"'{seed}'", "r", "k")
    low, high = (1 - confidence) / 2, (1 + confidence) / 2
    return f"""(WITH units AS (SELECT SUM(a - b) AS d, COUNT(a - b) AS n, ROW_NUMBER() OVER (ORDER BY {by}) - 1 AS i FROM {paired} GROUP BY {by}),
      size AS (SELECT COUNT(*) AS c FROM units),
      drawn AS (SELECT r, CAST(floor({u} * c) AS BIGINT) AS i FROM (SELECT unnest(range(1, {samples + 1})) AS r), (SELECT c, unnest(range(0, c)) AS k FROM size)),
      means AS (SELECT r, SUM(d) / NULLIF(SUM(n), 0) AS m FROM drawn JOIN units USING (i) GROUP BY r)
      SELECT (SELECT SUM(d) / NULLIF(SUM(n), 0) FROM units) AS mean_difference, quantile_cont(m, {low}) AS low, quantile_cont(m, {high}) AS high FROM means)"""


def holm(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """tests (test, p): with rank and reject, by Holm-Bonferroni: strict, and none after the first failure."""
    w = Window.orderBy("p", "test")  # a row a hypothesis
    m = F.count("*").over(Window.partitionBy())
    ranked = tests.withColumn("rank", F.row_number().over(w)).withColumn("ok", F.col("p") < alpha / (m - F.row_number().over(w) + 1))
    return ranked.withColumn("reject", F.min("ok").over(w.rowsBetween(Window.unboundedPreceding, 0))).select("test", "p", "rank", "reject")


def cohens_kappa(ratings: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, observed and expected agreement, kappa (1 if expected is 1, 0 without ratings)."""
    both = ratings.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = both.groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("same"))
    side = lambda c, n: cells.groupBy(F.col(c).alias("label")).agg(F.sum("n").alias(n))
    chance = side("a", "na").join(side("b", "nb"), "label").agg(F.coalesce(F.sum(F.col("na").cast("double") * F.col("nb")), F.lit(0.0)).alias("c"))
    rows = total.crossJoin(chance).select("t", (F.col("same") / F.nullif("t", F.lit(0))).alias("po"), (F.col("c") / F.nullif(F.col("t").cast("double") * F.col("t"), F.lit(0.0))).alias("pe"))  # single rows
    kappa = F.when(F.col("t") == 0, 0.0).when(F.col("pe") >= 1, 1.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe")))
    return rows.select(F.col("t").alias("n"), F.round("po", 6).alias("observed"), F.round("pe", 6).alias("expected"), F.round(kappa, 6).alias("kappa"))


def krippendorff_alpha(ratings: DataFrame, formula: str = "standard") -> DataFrame:
    """One row: items, ratings, alpha of nominal labels. ratings: item_id, rater_id, label (null: missing).

    standard: coincidences weighted by 1 / (ratings of the item - 1). simplified: one less the share of
    differing pairs over the chance that two ratings differ, within [-1, 1].
    """
    counts = ratings.where("label IS NOT NULL").groupBy("item_id", F.col("label").cast("string").alias("label")).agg(F.count("*").alias("n"))
    items = counts.groupBy("item_id").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("s")).where("m >= 2")
    labels = counts.join(items.select("item_id"), "item_id", "left_semi").groupBy("label").agg(F.sum("n").alias("n"))
    total = labels.agg(F.sum("n").alias("t"), F.sum(F.col("n").cast("double") * F.col("n")).alias("q"))
    differing = (F.col("m") * F.col("m") - F.col("s")).cast("double")
    seen = items.agg(F.count("*").alias("items"), F.sum(differing / (F.col("m") - 1)).alias("do"), F.sum(differing).alias("pairs_off"), F.sum((F.col("m") * (F.col("m") - 1)).cast("double")).alias("pairs"))
    rows = seen.crossJoin(total)  # single rows
    if formula == "simplified":
        expected = 1 - F.col("q") / (F.col("t").cast("double") * F.col("t"))
        alpha = 1 - (F.col("pairs_off") / F.nullif("pairs", F.lit(0.0))) / F.nullif(expected, F.lit(0.0))
        alpha = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), alpha))
    else:
        expected = (F.col("t").cast("double") * F.col("t") - F.col("q")) / F.nullif(F.col("t") - 1, F.lit(0))
        alpha = 1 - F.col("do") / F.nullif(expected, F.lit(0.0))
    return rows.select("items", F.col("t").alias("ratings"), F.round(F.when(F.col("items") == 0, 0.0).otherwise(F.coalesce(alpha, F.lit(1.0))), 6).alias("alpha"))


def annotation_progress(ratings: DataFrame) -> DataFrame:
    """item_id, raters, conflict (two raters at least, with different labels)."""
    rows = ratings.where("label IS NOT NULL").groupBy("item_id").agg(F.count_distinct("rater_id").alias("raters"), F.count_distinct("label").alias("labels"))
    return rows.select("item_id", "raters", ((F.col("raters") >= 2) & (F.col("labels") > 1)).alias("conflict"))
