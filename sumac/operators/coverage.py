"""Coverage certificates: may an answer be shown, given what its run has seen."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import aggregates as A


@dataclass(frozen=True)
class Policy:
    name: str
    scope: float = 1.0
    extraction: float = 1.0
    fields: float = 1.0
    ambiguous: float = 0.0
    repairs: int = 2
    partial: bool = False  # below a threshold: a partial answer instead of none


POLICIES = [Policy("strict"), Policy("warn_partial", 0.9, 0.9, 0.9, 0.1, 2, True), Policy("raw", 0.0, 0.0, 0.0, 1.0, 1 << 20, True)]


def requirement(q: A.Query) -> dict[str, bool]:
    """What an answer's kind needs: counts need the scope alone, the others facts of every row as well."""
    facts = not (isinstance(q.aggregation, A.Count) and q.aggregation.field is None)
    return {"whole_scope": True, "every_row": facts, "every_field": facts}


def policy_table(spark: SparkSession, policies: list[Policy] | None = None) -> DataFrame:
    rows = [tuple(vars(p).values()) for p in policies or POLICIES]
    return spark.createDataFrame(rows, "policy string, min_scope double, min_extraction double, min_fields double, max_ambiguous double, max_repairs long, partial boolean")


def observations(events: DataFrame, rows: DataFrame, fields: list[str]) -> DataFrame:
    """What was seen of each run. events: run_id, stage, rows_out; rows: run_id, record_id, failed,
    ambiguous and the fields."""
    seen = events.groupBy("run_id").agg(F.max(F.when(F.col("stage") == "scope", F.col("rows_out"))).alias("eligible"), F.max(F.when(F.col("stage") == "extract", F.col("rows_out"))).alias("retrieved"))
    holes = reduce(lambda a, b: a | b, [F.col(f).isNull() for f in fields], F.lit(False))
    ok = ~F.coalesce("failed", F.lit(False))
    counts = rows.groupBy("run_id").agg(
        F.count_distinct(F.when(ok, F.col("record_id"))).alias("extracted"), F.count_if(ok & holes).alias("with_null"), F.count_if(~ok).alias("failed"), F.count_if(F.coalesce("ambiguous", F.lit(False))).alias("ambiguous")
    )
    return seen.join(counts, "run_id", "left").fillna(0, ["extracted", "with_null", "failed", "ambiguous"])


def certify(observed: DataFrame, policies: DataFrame) -> DataFrame:
    """Every run under every policy: ratios, reason codes and decision.

    observed: run_id, eligible (null: unknown), retrieved, extracted, with_null, ambiguous, repairs,
    has_answer. Unknown scope: uncertified. An empty scope is covered in full. Any reason: partial or
    abstain, as the policy says. No answer: abstain.
    """
    rows = observed.crossJoin(F.broadcast(policies))  # a handful of policies
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(1.0))
    ratios = {
        "scope_ratio": part("retrieved", "eligible"),
        "extraction_ratio": part("extracted", "retrieved"),
        "field_ratio": F.when(F.col("extracted") > 0, 1 - F.col("with_null") / F.col("extracted")).otherwise(F.lit(1.0)),
        "ambiguous_ratio": F.when(F.col("retrieved") > 0, F.col("ambiguous") / F.col("retrieved")).otherwise(F.lit(0.0)),
    }
    rows = rows.withColumns(ratios)
    tests = [
        ("SCOPE_UNKNOWN", F.col("eligible").isNull()),
        ("SCOPE_ROWS_MISSING", F.col("scope_ratio") < F.col("min_scope")),
        ("EXTRACTION_ROWS_MISSING", F.col("extraction_ratio") < F.col("min_extraction")),
        ("FIELDS_INCOMPLETE", F.col("field_ratio") < F.col("min_fields")),
        ("EXTRACTION_AMBIGUOUS", F.col("ambiguous_ratio") > F.col("max_ambiguous")),
        ("REPAIR_LIMIT", F.col("repairs") > F.col("max_repairs")),
    ]
    reasons = F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(code)) for code, t in tests]), lambda x: x.isNotNull())
    rows = rows.withColumn("reasons", reasons)
    decision = (
        F.when(~F.col("has_answer"), "abstain")
        .when(F.col("eligible").isNull(), "uncertified")
        .when(F.size("reasons") == 0, "certified")
        .when(F.col("partial"), "partial")
        .otherwise("abstain")
    )
    return rows.select("run_id", "policy", *[F.round(c, 6).alias(c) for c in ratios], "reasons", decision.alias("decision"))


def shown(certificates: DataFrame, answers: DataFrame) -> DataFrame:
    """What a user sees: the answer, unless the decision is to abstain, and the reasons."""
    hide = F.col("decision") == "abstain"
    return certificates.join(answers, "run_id", "left").select("run_id", "policy", F.when(~hide, F.col("answer")).alias("answer"), F.concat_ws(" | ", "reasons").alias("why"), "decision")


def policy_quality(rows: DataFrame, by: str = "policy", wrong_above: float = 0.0) -> DataFrame:
    """rows: by, decision, loss. Coverage, risk and accuracy of what is answered, how many abstentions were
    right, and how often certification was wrong."""
    said = F.col("decision").isin("certified", "partial")
    wrong = F.col("loss") > wrong_above
    ratio = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    n_said, n_silent, n_cert = F.count_if(said), F.count_if(~said), F.count_if(F.col("decision") == "certified")
    return rows.groupBy(by).agg(
        F.count("*").alias("runs"),
        ratio(n_said, F.count("*")).alias("coverage"),
        ratio(F.count_if(said & wrong), n_said).alias("risk"),
        ratio(F.count_if(said & ~wrong), n_said).alias("selective_accuracy"),
        ratio(F.count_if(~said & wrong), n_silent).alias("abstention_precision"),
        ratio(F.count_if((F.col("decision") == "certified") & wrong), n_cert).alias("false_certification"),
        ratio(F.count_if(~said & ~wrong), F.count("*")).alias("needless_abstention"),
    )


def risk_coverage(observed: DataFrame, losses: DataFrame, thresholds: list[float]) -> DataFrame:
    """The quality of certification at several thresholds of all ratios."""
    spark = observed.sparkSession
    rows = certify(observed, policy_table(spark, [Policy(str(t), t, t, t, 1 - t) for t in thresholds])).join(losses, "run_id")
    return policy_quality(rows.withColumnRenamed("policy", "threshold"), "threshold")


def code_counts(certificates: DataFrame) -> DataFrame:
    return certificates.select("policy", F.explode("reasons").alias("reason")).groupBy("policy", "reason").agg(F.count("*").alias("n"))


