"""The pipeline's stages on small tables: rows that should go go, clean ones stay, columns stay."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, good string, fp string, taken string"


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    rng = random.Random(6)
    vocabulary = ["word%d" % i for i in range(250)]
    text = lambda n=80: " ".join(rng.choices(vocabulary, k=n))
    rows = [(i, text(), "en", "s%d" % (i % 4)) for i in range(200)]
    item = text(15)
    rows += [(200 + k, rows[k][1], "en", "s0") for k in range(5)]  # copies
    rows += [(300 + k, text(30) + " " + item + " " + text(30), "en", "s1") for k in range(3)]  # benchmark passages
    rows += [(400 + k, text() + " vile vile2 vile3", "en", "s2") for k in range(99)]  # toxic
    rows += [(500, None, None, None), (501, "", "en", "s1"), (None, text(), "en", "s3"), (7, rows[7][1], "en", "s3")]
    labels = [(i, 1, 0) for i in range(150)] + [(400 + k, 1, 1) for k in range(85)] + [(None, 1, 1), (3, None, None)]
    root = tmp_path_factory.mktemp("data")
    full = [(*r, len(r[1]) if r[1] is not None else None, "c", "c", "c") for r in rows]
    spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    names = list(stage)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    clean = set(range(200))

    good = stage[names[0]](spark, docs, data)
    assert good.columns == docs.columns
    assert len(ids(good) & clean) >= 198 and not ids(good) & set(range(485, 499))
    once = stage[names[1]](spark, docs, data)
    assert once.columns == docs.columns
    assert once.groupBy("text").count().where("count > 1").count() == 0
    assert ids(once) >= clean and not ids(once) & set(range(200, 205))
    left = stage[names[2]](spark, docs, data)
    assert left.columns == docs.columns
    assert ids(docs) - ids(left) == {300, 301, 302} and left.count() == docs.count() - 3
    mixed = stage[names[3]](spark, docs, data)
    assert mixed.columns == docs.columns
    assert mixed.agg(F.sum(F.size(F.split("text", " ")))).first()[0] > 0
    last = stage[names[4]](spark, docs, data)
    assert last.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and last.count() == docs.count()
    for f in stage.values():
        assert f(spark, docs.limit(0), data).count() == 0


def test_run(spark, data):
    rows = corpus_pipeline.run(spark, data).collect()
    starts = sorted((r.start, r.n_tokens) for r in rows)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    found = {r.doc_id for r in rows}
    assert not found & {200, 201, 202, 203, 204, 300, 301, 302, 500, 501}
    assert sorted((r.start, r.doc_id or -1) for r in corpus_pipeline.run(spark, data).collect()) == sorted((r.start, r.doc_id or -1) for r in rows)
