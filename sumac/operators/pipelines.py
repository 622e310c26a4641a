"""Pipelines that answer from what they retrieve or extract: lexical, dense, extract and aggregate, whole scope, certified.

Each gives tall results (pipeline_id, query_id, rank, key, value) of many queries at once. The question of a query is its
tag question. The pipelines with wrong stages are in faults.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import uniform
from ..functions.shared import cut, stored
from . import aggregates as A
from . import coverage as C
from . import lexical as L
from . import lexical_scan as LS
from . import predicates as P
from . import retrieval as R
from .condense import condense, within_passes
from .evidence import eligible_counts
from .inner import hash_vectors

#: Attempts at extracting a batch of records, and the share of them that succeed.
ATTEMPTS = 3
GOOD = 0.9
#: The column of classes that tells whether extraction read their records.
READ = "__read"


def questions(df: DataFrame, queries: list[A.Query]) -> DataFrame:
    return df.sparkSession.createDataFrame([(q.query_id, q.tags["question"]) for q in queries], "query_id string, text string")


def own(q: A.Query, again: bool) -> A.Query:
    """The query over the rows that were fetched for it, with its scope applied again or not."""
    mine = P.Eq("asked_by", q.query_id)
    return replace(q, scope=P.And((mine, q.scope)) if again and q.scope is not None else mine)


def from_retrieved(df: DataFrame, queries: list[A.Query], top: DataFrame, again: bool) -> DataFrame:
    """Answers over the retrieved records alone. top: query_id, unit (a record id)."""
    few = R.few(cut(top.select(F.col("query_id").alias("asked_by"), F.col("unit").alias("record_id"))))
    return A.evaluate_batch(cut(df.join(few, "record_id")), [own(q, again) for q in queries])


def lexical(df: DataFrame, queries: list[A.Query], k: int) -> DataFrame:
    """The k nearest records of each question; an index is made only for more questions than a pass over the records can ask."""
    units, asked = R.render(df), questions(df, queries)
    terms = LS.asked_terms(asked)
    if terms is None:
        return L.bm25_top(L.bm25_index(units, "record_id", "text"), asked, k)
    return LS.bm25_scan(units, "record_id", "text", terms, asked, k)


def dense(df: DataFrame, queries: list[A.Query], k: int) -> DataFrame:
    """The k records of each question whose hash vectors are nearest to its own. Records' vectors are made where they are compared."""
    vectors = R.render(df).select("record_id", F.sha2("text", 256).alias("v"))
    asked = questions(df, queries).select("query_id", R.hash_embedding(F.col("text")).alias("vector"))
    return R.dense_top(vectors, asked, k, "record_id", "v", hash_vectors)


def direct_bm25(df: DataFrame, queries: list[A.Query], k: int = 20, top: DataFrame | None = None) -> DataFrame:
    """Over the k records that are lexically nearest to the question, as they are. top: those of lexical, if known."""
    return from_retrieved(df, queries, (lexical(df, queries, k) if top is None else top).where(F.col("rank") <= k), again=False)


def direct_dense(df: DataFrame, queries: list[A.Query], k: int = 20, top: DataFrame | None = None) -> DataFrame:
    """Over the k records whose vectors are nearest to the question's, as they are. top: those of dense, if known."""
    return from_retrieved(df, queries, (dense(df, queries, k) if top is None else top).where(F.col("rank") <= k), again=False)


def extract_aggregate(df: DataFrame, queries: list[A.Query], k: int = 50, top: DataFrame | None = None) -> DataFrame:
    """Over those of the k lexically nearest records that lie in the scope."""
    return from_retrieved(df, queries, (lexical(df, queries, k) if top is None else top).where(F.col("rank") <= k), again=True)


def read_within(attempts: int, seed: int = 42) -> Column:
    """Whether one of the first attempts reads a record's product. An attempt at a product succeeds by a draw."""
    tries = reduce(Column.__or__, [uniform(seed, F.col("product_id"), k, "extract") < GOOD for k in range(attempts)])
    return F.col("product_id").isNotNull() & tries


def extracted_classes(df: DataFrame, queries: list[A.Query], seed: int = 42) -> DataFrame:
    """The classes of records that the queries tell apart, and whether extraction read them within its repairs."""
    return condense(df.withColumn(READ, read_within(ATTEMPTS, seed)), queries, (READ,))


def full_scope(df: DataFrame, queries: list[A.Query], classes: DataFrame | None = None) -> DataFrame:
    """Over all records of the scope. classes: those of extracted_classes, if known."""
    return A.evaluate_batch(condense(df, queries) if classes is None else classes, within_passes(queries))


def certified_repair(df: DataFrame, queries: list[A.Query], seed: int = 42, policy: C.Policy = C.POLICIES[1], classes: DataFrame | None = None) -> DataFrame:
    """Over the records that extraction read within its repairs; an answer is shown if the policy lets its run be."""
    classes, asked = extracted_classes(df, queries, seed) if classes is None else classes, within_passes(queries)
    got = classes.where(READ)
    seen = eligible_counts(classes, asked).join(eligible_counts(got, asked).withColumnRenamed("eligible", "extracted"), "query_id")
    observed = seen.select(
        F.col("query_id").alias("run_id"), "eligible", F.col("eligible").alias("retrieved"), "extracted", F.lit(0).alias("with_null"), F.lit(0).alias("ambiguous"),
        F.lit(ATTEMPTS - 1).alias("repairs"), F.lit(True).alias("has_answer"),
    )
    shown = C.certify(observed, C.policy_table(df.sparkSession, [policy])).where("decision IN ('certified', 'partial')").select(F.col("run_id").alias("query_id"))
    return A.evaluate_batch(got, asked).join(shown, "query_id", "left_semi")


CATALOGUE: dict[str, Callable[..., DataFrame]] = {
    "direct_bm25": direct_bm25,
    "direct_dense": direct_dense,
    "extract_aggregate": extract_aggregate,
    "full_scope": full_scope,
    "certified_repair": certified_repair,
}


def run_catalogue(df: DataFrame, queries: list[A.Query]) -> DataFrame:
    """All of them, over records that are joined and written once. They are retrieved once for both pipelines that start from the lexically nearest, what any
    pipeline retrieves is fetched at once, and the pipelines over whole scopes share the classes of records."""
    df = stored(df)
    top, near = cut(lexical(df, queries, 50)), cut(dense(df, queries, 20))
    fetched = cut(df.join(R.few(top.select("unit").union(near.select("unit")).distinct().withColumnRenamed("unit", "record_id")), "record_id"))
    classes = extracted_classes(df, queries)
    known = {
        "direct_bm25": (fetched, {"top": top}), "direct_dense": (fetched, {"top": near}), "extract_aggregate": (fetched, {"top": top}),
        "full_scope": (df, {"classes": classes}), "certified_repair": (df, {"classes": classes}),
    }
    parts = [f(known[name][0], queries, **known[name][1]).select(F.lit(name).alias("pipeline_id"), "*") for name, f in CATALOGUE.items()]
    return reduce(DataFrame.unionByName, parts)
