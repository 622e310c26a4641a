"""Quality classifier: ordinal cumulative-link regression on hashed text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship

#: Buckets of the hashed features: the size of what is broadcast, whatever the vocabulary (1 MB).
BUCKETS = 1 << 18
#: Labelled documents that the fit reads, at most about this many (a hash sample beyond).
SAMPLE = 20_000
#: Training documents that a feature must occur in to get a weight.
LEAST_DOCS = 4
#: Words of a text that are turned to features at once.
STEP = 1 << 16
EPOCHS = 16
#: Steps at least, so that a small set of labels has more epochs.
LEAST_STEPS = 2000
BATCH = 64
#: Tail probability of the best grade from which a document is kept.
LEAST_GOOD = 0.5

ship(__name__)

MARKS = re.compile(rb"[^0-9A-Za-z\x80-\xff]+")


def grade(quality: Column, toxic: Column) -> Column:
    """Graded rating of two binary labels: 0 toxic, 1 poor, 2 good; null if either is null."""
    return F.when(quality.isNull() | toxic.isNull(), None).when(toxic == 1, 0).when(quality == 0, 1).otherwise(2)


def features(text: bytes | None, buckets: int = BUCKETS) -> np.ndarray:
    """Distinct buckets of a text's features, rising.

    Features: each lower-cased word without its marks; the marks at the end of a word; whether words are
    all capitals; words that repeat the one before; and the last three as shares of the words, in steps.
    """
    found: set[int] = set()
    words = (text or b"").split()
    n = len(words)
    marked = capitals = repeated = bars = 0
    cache: dict[bytes, int] = {}
    for lo in range(0, n, STEP):
        part = words[lo : lo + STEP]
        repeated += sum(a == b for a, b in zip(part, part[1:]))
        for w in set(part):
            cache.setdefault(w, 0)
        for w in part:
            cache[w] += 1
    for w, times in cache.items():
        core = MARKS.sub(b"", w)
        if core:
            found.add(xxhash.xxh64_intdigest(core.lower(), 7) % buckets)
            if len(core) > 1 and core.isupper() and core.isascii():
                capitals += times
        else:
            bars += times
        tail = w[len(w.rstrip(b"*#$%&!|<>")) :]
        if len(tail) > 1:
            marked += times
            found.add(xxhash.xxh64_intdigest(b"\x00tail" + tail[:3], 7) % buckets)
    if n:
        for name, k in ((b"marked", marked), (b"capitals", capitals), (b"repeated", repeated), (b"bars", bars)):
            step = min(10, int(20 * k / n))
            for s in range(1, step + 1):
                found.add(xxhash.xxh64_intdigest(b"\x00%s%d" % (name, s), 7) % buckets)
    step = min(6, n.bit_length() // 2)
    for s in range(1, step + 1):
        found.add(xxhash.xxh64_intdigest(b"\x00length%d" % s, 7) % buckets)
    return np.array(sorted(found), np.int64)


@dataclass
class Model:
    """P(grade <= k) = logistic(cuts[k] - score), score = sum of the weights of a text's features."""

    grades: list[int]
    cuts: np.ndarray
    weights: np.ndarray

    def tails(self, score: float) -> np.ndarray:
        """P(grade >= grades[k]) for k from 1."""
        return 1 / (1 + np.exp(np.clip(self.cuts - score, -50, 50)))


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def fit(found: list[np.ndarray], y: np.ndarray, buckets: int = BUCKETS, least_docs: int = LEAST_DOCS, epochs: int = EPOCHS, rate: float = 0.15, shrink: float = 5.0, seed: int = 42) -> Model:
    """Fits shared weights and ordered cuts by AdaGrad on the cumulative-link likelihood.

    Features in fewer than least_docs documents keep weight 0; a rare class weighs as much in sum as a
    quarter of the largest. Cuts are kept in order after every step. shrink pulls weights to 0 as if so many
    documents spoke for each feature being neutral.
    """
    grades = sorted(set(y.tolist()))
    weights = np.zeros(buckets)
    if len(grades) < 2:
        return Model(grades, np.zeros(0), weights)
    level = np.searchsorted(grades, y)
    seen = np.bincount(np.concatenate([f for f in found if len(f)] or [np.zeros(0, np.int64)]), minlength=buckets)
    found = [f[seen[f] >= least_docs] for f in found]
    sizes = np.bincount(level)
    cost = np.maximum(1.0, sizes.max() / 4 / sizes)[level]
    share = np.cumsum(sizes)[:-1] / sizes.sum()
    first = np.log(share / (1 - share))
    cuts = first.copy()
    square, cut_square = np.full(buckets, 1e-2), np.full(len(cuts), 1e-2)
    rng = np.random.default_rng(seed)
    passes = max(epochs, -(-LEAST_STEPS * BATCH // len(found)))
    for _ in range(passes):
        order = rng.permutation(len(found))
        for lo in range(0, len(order), BATCH):
            rows = order[lo : lo + BATCH]
            flat = np.concatenate([found[i] for i in rows])
            ends = np.cumsum([len(found[i]) for i in rows])
            owner = np.repeat(np.arange(len(rows)), np.diff(np.concatenate(([0], ends))))
            score = np.bincount(owner, weights[flat], minlength=len(rows))
            k, c = level[rows], cost[rows]
            padded = np.concatenate(([-np.inf], cuts, [np.inf]))
            upper, lower = padded[k + 1] - score, padded[k] - score
            pu, pl = np.where(np.isinf(upper), 1.0, logistic(np.where(np.isinf(upper), 0, upper))), np.where(np.isinf(lower), 0.0, logistic(np.where(np.isinf(lower), 0, lower)))
            p = np.maximum(pu - pl, 1e-9)
            du, dl = pu * (1 - pu) / p, pl * (1 - pl) / p
            # gradient of the log-likelihood by the score, and by the two cuts around the grade
            g = np.clip(c * (dl - du), -8, 8)
            step = np.bincount(flat, g[owner], minlength=buckets)
            touched = np.flatnonzero(step)
            d = step[touched] / len(rows) - shrink / len(found) * weights[touched]
            square[touched] += d * d
            weights[touched] += rate * d / np.sqrt(square[touched])
            dc = np.zeros(len(cuts) + 2)
            np.add.at(dc, k + 1, c * du)
            np.add.at(dc, k, -c * dl)
            dc = np.clip(dc[1:-1] / len(rows), -8, 8)
            cut_square += dc * dc
            cuts += rate * dc / np.sqrt(cut_square)
            cuts = np.maximum.accumulate(cuts + 1e-3 * np.arange(len(cuts))) - 1e-3 * np.arange(len(cuts))
        rate *= 0.13 ** (1 / passes)
    return Model(grades, cuts, weights)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits a model on labelled documents, at most about sample of them.

    labels: the id, quality and toxic (0 or 1). Labels with a null and labels without a document are
    ignored; of several labels of one id the lowest grade counts. Beyond sample labels, those whose hashed id falls below a threshold are read, so the same
    data give the same model on any cluster. Documents become feature buckets on the executors; the
    driver gets these alone.
    """
    graded = labels.select(F.col(id_col).alias("id"), grade(F.col("quality"), F.col("toxic")).alias("grade")).where("id IS NOT NULL AND grade IS NOT NULL")
    graded = graded.groupBy("id").agg(F.min("grade").alias("grade"))
    n = graded.count()
    if n > sample:
        graded = graded.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * sample / n))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).join(F.broadcast(graded), "id")  # about sample rows

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t.as_py()).astype(np.int32).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.binary())], names=["id", "grade", "found"])

    schema = T.StructType([rows.schema["id"], T.StructField("grade", T.IntegerType()), T.StructField("found", T.BinaryType())])
    got = rows.mapInArrow(task, schema).toArrow().sort_by([("id", "ascending"), ("grade", "ascending"), ("found", "ascending")])
    y = got["grade"].to_numpy()
    return fit([np.frombuffer(x.as_py(), np.int32).astype(np.int64) for x in got["found"]], y)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with two more columns: expected_grade, and good, the probability of the best grade.

    Null and blank texts are scored by their length feature like any other text. A model of one grade
    gives that grade with probability 1.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.grades, model.cuts, model.weights.astype(np.float32)))  # BUCKETS floats

    @F.pandas_udf("expected double, good double")
    def rate(text):
        import pandas as pd

        grades, cuts, weights = sent.value
        m = Model(grades, cuts, weights)
        out = []
        for t in text:
            tails = m.tails(float(weights[features(t)].sum()))
            steps = np.diff(np.array(grades, float))
            out.append((grades[0] + float((steps * tails).sum()) if grades else np.nan, float(tails[-1]) if len(tails) else 1.0))
        return pd.DataFrame(out, columns=["expected", "good"])

    rated = docs.withColumn("__rated", rate(F.col(text_col).cast("binary")))
    return rated.withColumns({"expected_grade": F.col("__rated.expected"), "good": F.col("__rated.good")}).drop("__rated")


def select_good(docs: DataFrame, model: Model, least_good: float = LEAST_GOOD, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose best grade has a probability of least_good or more."""
    columns = docs.columns
    renamed = docs.toDF(*[f"c{i}" for i in range(len(columns))])  # own names of docs may clash with the scores
    kept = score(renamed, model, f"c{columns.index(text_col)}").where(F.col("good") >= least_good)
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])

