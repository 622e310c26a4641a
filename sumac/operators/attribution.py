"""Losses of answers against gold, and the shares of the stages by counterfactual replacement."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import aggregates as A
from .faults import PIPELINES, answer_fault, stage_answers

#: The stages that an intervention replaces by gold.
SUBSETS = ["none", "R", "E", "A", "RE", "RA", "EA", "REA"]


def kinds_of(queries: list[A.Query]) -> Column:
    return F.create_map(*[x for q in queries for x in (F.lit(q.query_id), F.lit(type(q.aggregation).__name__))])[F.col("query_id")]


def scalar_loss(p: Column, g: Column, tolerance: float = 1e-4) -> Column:
    off = F.abs(p - g)
    return F.when(p.isNull() & g.isNull(), 0.0).when(p.isNull() | g.isNull(), 1.0).when(off <= tolerance, 0.0).otherwise(F.least(F.lit(1.0), off / F.greatest(F.abs(g), F.lit(1.0))))


def losses(answers: DataFrame, gold: DataFrame, kind: Column, tolerance: float = 1e-4) -> DataFrame:
    """run_id, query_id, loss, raw_error and status (scored or abstained).

    answers: run_id, query_id, rank, key, value; gold: query_id, rank, key, value. Scalars: relative error,
    0 within the tolerance, 1 at most, averaged over the keys of a comparison. Top-k: Jaccard distance of
    the key sets. Trend: absolute differences over all buckets by the sum of gold, 1 at most. Nothing
    answered where gold has something: 1.
    """
    pairs = answers.select("run_id", "query_id").distinct()
    want = pairs.join(gold.select("query_id", F.coalesce("key", F.lit("")).alias("key"), F.col("value").alias("g"), F.lit(1).alias("in_g")), "query_id")
    have = answers.select("run_id", "query_id", F.coalesce("key", F.lit("")).alias("key"), F.col("value").alias("p"), F.lit(1).alias("in_p"))
    both = have.join(want, ["run_id", "query_id", "key"], "full_outer").withColumn("kind", kind)
    off = F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("g", F.lit(0.0)))
    rows = both.groupBy("run_id", "query_id", "kind").agg(
        F.avg(scalar_loss(F.col("p"), F.col("g"), tolerance)).alias("scalar"),
        (1 - F.count_if(F.col("in_p").isNotNull() & F.col("in_g").isNotNull()) / F.count("*")).alias("jaccard"),
        F.least(F.lit(1.0), F.sum(off) / F.greatest(F.sum(F.abs(F.coalesce("g", F.lit(0.0)))), F.lit(1.0))).alias("l1"),
        F.sum(off).alias("raw"),
        F.count("p").alias("said"),
        F.count("g").alias("known"),
    )
    loss = F.when((F.col("said") == 0) & (F.col("known") > 0), 1.0).when(F.col("kind") == "TopK", F.col("jaccard")).when(F.col("kind") == "Trend", F.col("l1")).otherwise(F.col("scalar"))
    return rows.select("run_id", "query_id", loss.alias("loss"), F.col("raw").alias("raw_error"), F.when((F.col("said") == 0) & (F.col("known") > 0), "abstained").otherwise("scored").alias("status"))


def interventions(df: DataFrame, queries: list[A.Query], pipelines: list[str], seed: int = 42) -> DataFrame:
    """pipeline_id, query_id, subset, loss: the loss after the stages of the subset are replaced by gold.

    Two batches over the records, right and corrupted, give the answers for right and wrong scope and facts; a wrong
    aggregation is a change of the tall answers. So the eight interventions of all pipelines cost no more passes.
    """
    found = stage_answers(df, queries, seed)
    gold, kind, out = found[""], kinds_of(queries), []
    for name, subset in product(pipelines, SUBSETS):
        left = [s for s in PIPELINES[name] if subset == "none" or s not in subset]
        rows = found["".join(s for s in left if s != "A")]
        rows = answer_fault(rows, queries, seed) if "A" in left else rows
        out.append(rows.select(F.lit(f"{name}/{subset}").alias("run_id"), "*"))
    scored = losses(reduce(DataFrame.unionByName, out), gold, kind)
    parts = F.split("run_id", "/")
    return scored.select(parts[0].alias("pipeline_id"), "query_id", parts[1].alias("subset"), "loss")


def shapley(rows: DataFrame, keys: list[str], subset: str = "subset", loss: str = "loss") -> DataFrame:
    """Shares of the loss by stage: phi_r, phi_e, phi_a, each 0 or more, their interaction, the dominant stage.

    rows: keys, subset, loss; an intervention without loss is invalid and has value 0. The value of a
    subset is how much its replacement lowers the loss, 0 at least. If the shares exceed what all
    replacements recover, they are scaled down to it. Ties go to the first of scope, facts, aggregation.
    """
    wide = rows.groupBy(*keys).pivot(subset, SUBSETS).agg(F.first(loss))
    v = {s: F.coalesce(F.greatest(F.lit(0.0), F.col("none") - F.col(s)), F.lit(0.0)) for s in SUBSETS if s != "none"} | {"": F.lit(0.0)}
    name = lambda s: "".join(x for x in "REA" if x in s)

    def phi(x: str) -> Column:
        a, b = (y for y in "REA" if y != x)
        parts = [(1 / 3, ""), (1 / 6, a), (1 / 6, b), (1 / 3, a + b)]
        return F.greatest(F.lit(0.0), sum((w * (v[name(s + x)] - v[name(s)]) for w, s in parts), start=F.lit(0.0)))

    rows = wide.select(*keys, F.coalesce("none", F.lit(1.0)).alias("loss"), v["REA"].alias("recoverable"), *[phi(x).alias(f"p_{x}") for x in "REA"])
    total = F.col("p_R") + F.col("p_E") + F.col("p_A")
    scale = F.when(total > F.col("recoverable") + 1e-12, F.col("recoverable") / F.nullif(total, F.lit(0.0))).otherwise(F.lit(1.0))
    rows = rows.withColumn("scale", F.coalesce(scale, F.lit(1.0)))
    shares = [F.round(F.col(f"p_{x}") * F.col("scale"), 9).alias(f"phi_{x.lower()}") for x in "REA"]
    rows = rows.select(*keys, "loss", "recoverable", *shares)
    best = F.greatest("phi_r", "phi_e", "phi_a")
    dominant = F.when((F.col("loss") <= 0) | (best <= 0), "none").when(F.col("phi_r") == best, "scope").when(F.col("phi_e") == best, "facts").otherwise("aggregation")
    left = F.round(F.col("recoverable") - F.col("phi_r") - F.col("phi_e") - F.col("phi_a"), 6)
    return rows.withColumn("interaction", F.greatest(F.lit(0.0), left)).withColumn("dominant", dominant)


def batch_summary(shares: DataFrame) -> DataFrame:
    """One row: runs, mean loss and shares, runs by dominant stage."""
    return shares.agg(
        F.count("*").alias("runs"),
        *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("loss", "phi_r", "phi_e", "phi_a")],
        *[F.count_if(F.col("dominant") == d).alias(f"dominant_{d}") for d in ("scope", "facts", "aggregation", "none")],
    )


def losses_sql(answers: str, gold: str, queries: list[A.Query], tolerance: float = 1e-4) -> str:
    """Rows of losses as SQL over tables of answers and gold."""
    kinds = ", ".join(f"('{q.query_id}', '{type(q.aggregation).__name__}')" for q in queries)
    scalar = f"CASE WHEN p IS NULL AND g IS NULL THEN 0.0 WHEN p IS NULL OR g IS NULL THEN 1.0 WHEN abs(p - g) <= {tolerance} THEN 0.0 ELSE least(1.0, abs(p - g) / greatest(abs(g), 1.0)) END"
    return f"""(WITH want AS (SELECT run_id, query_id, coalesce(key, '') AS key, value AS g, 1 AS in_g FROM (SELECT DISTINCT run_id, query_id FROM {answers}) JOIN {gold} USING (query_id)),
      have AS (SELECT run_id, query_id, coalesce(key, '') AS key, value AS p, 1 AS in_p FROM {answers}),
      met AS (SELECT * FROM have FULL JOIN want USING (run_id, query_id, key) JOIN (VALUES {kinds}) AS k(query_id, kind) USING (query_id)),
      sums AS (SELECT run_id, query_id, kind, AVG({scalar}) AS scalar, 1 - COUNT(*) FILTER (in_p = 1 AND in_g = 1) / COUNT(*) AS jaccard, SUM(abs(coalesce(p, 0.0) - coalesce(g, 0.0))) AS raw,
        SUM(abs(coalesce(g, 0.0))) AS size, COUNT(p) = 0 AND COUNT(g) > 0 AS silent FROM met GROUP BY ALL)
      SELECT run_id, query_id, CASE WHEN silent THEN 1.0 WHEN kind = 'TopK' THEN jaccard WHEN kind = 'Trend' THEN least(1.0, raw / greatest(size, 1.0)) ELSE scalar END AS loss, raw AS raw_error,
        CASE WHEN silent THEN 'abstained' ELSE 'scored' END AS status FROM sums)"""
