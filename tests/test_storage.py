"""Hash trees, checksums of ranges and layouts by several columns."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sumac.operators import aggregates as A
from sumac.operators import hashtree
from sumac.operators.records import records
from sumac.sources import layout, ranges

WORDS = "id long, word string"


def table(spark, n=5000):
    """Ids with a word; a third of the rows are one row, and one word in seven is null."""
    rows = spark.range(n).select("id", F.when(F.col("id") % 7 != 0, F.concat(F.lit("w"), F.col("id") % 11)).alias("word"))
    return rows.unionAll(spark.range(n // 2).select(F.lit(-1).cast("long").alias("id"), F.lit("hot").alias("word")))


def plain_root(rows, depth):
    """The digest by plain Python: rows are tuples in order of column name."""
    text = lambda v: "n" if v is None else f"{len(str(v))}:{v}"
    copies = Counter(hashlib.sha256("".join(map(text, r)).encode()).hexdigest() for r in rows)
    level = {}
    for place, n in sorted(copies.items()):
        level.setdefault(place[:depth], []).append(f"{place}:{n}")
    for d in range(depth, -1, -1):
        level = {p: hashlib.sha256(",".join(lines).encode()).hexdigest() for p, lines in level.items()} or {"": hashlib.sha256(b"").hexdigest()}
        if d == 0:
            return level[""]
        up = {}
        for p in sorted(level):
            up.setdefault(p[: d - 1], []).append(f"{p}:{level[p]}")
        level = up


@pytest.mark.parametrize("depth", [0, 2])
def test_tree_is_the_plain_one(spark, depth):
    df = table(spark, 600)
    tree = hashtree.build(df, ["id"], depth=depth)
    assert tree.root().first().asDict() == {"rows": 900, "digest": plain_root([tuple(r) for r in df.collect()], depth)}


def test_tree_ignores_partitions(spark):
    df = table(spark)
    a, b = hashtree.build(df, ["id"], block=64), hashtree.build(df.repartition(13).orderBy("word").select("word", "id"), ["id"], block=64)
    assert a.depth == b.depth == 2 and a.root().first() == b.root().first()
    assert hashtree.differences(a, b).count() == 0 and hashtree.blocks(a, b).count() == 0


def test_one_changed_row_is_found_in_its_blocks(spark):
    df = table(spark)
    a = hashtree.build(df, ["id"], block=64)
    gone = hashtree.build(df.where("id <> 4321"), ["id"], depth=a.depth)
    assert hashtree.blocks(a, gone).count() == 1
    found = hashtree.differences(a, gone)
    assert [tuple(r) for r in found.collect()] == [(4321, 1, 0, "only_a")]
    assert found._jdf.queryExecution().executedPlan().toString().count("PushedFilters: [IsNotNull(__block), EqualTo(__block,") >= 2
    changed = hashtree.build(df.withColumn("word", F.expr("CASE WHEN id = 4321 THEN 'x' ELSE word END")), ["id"], depth=a.depth)
    assert hashtree.blocks(a, changed).count() == 2
    assert [tuple(r) for r in hashtree.differences(a, changed).collect()] == [(4321, 1, 1, "changed")]


def test_tree_of_copies_and_nulls(spark, monkeypatch):
    rows = [(1, None), (1, ""), (1, "a|b"), (2, "x"), (2, "x"), (None, None)]
    a = hashtree.build(spark.createDataFrame(rows, WORDS), ["id"], depth=1)
    b = hashtree.build(spark.createDataFrame(rows[:1] + rows[2:4] + [(3, "new")], WORDS), ["id"], depth=1)
    want = {(1, 1, 0, "only_a"), (2, 2, 1, "changed"), (None, 1, 0, "only_a"), (3, 0, 1, "only_b")}
    assert {tuple(r) for r in hashtree.differences(a, b).collect()} == want
    monkeypatch.setattr(hashtree, "LITERALS", 0)  # everything by semi joins
    assert {tuple(r) for r in hashtree.differences(a, b).collect()} == want


def test_tree_of_nothing(spark):
    none, some = hashtree.build(spark.createDataFrame([], WORDS), ["id"]), hashtree.build(spark.createDataFrame([(1, "a")], WORDS), ["id"])
    assert none.root().first().asDict() == {"rows": 0, "digest": hashlib.sha256(b"").hexdigest()}
    assert [tuple(r) for r in hashtree.differences(none, some).collect()] == [(1, 0, 1, "only_b")]
    assert hashtree.differences(none, none).count() == 0
    with pytest.raises(ValueError):
        hashtree.blocks(none, hashtree.build(spark.createDataFrame([], WORDS), ["id"], depth=2))


def test_batch_joins_once(spark):
    specs = [A.Query("s", A.Mean("price")), A.Query("t", A.TopK("brand", 3, "mean", "rating")), A.Query("u", A.TopK("category", 3)), A.Query("y", A.Trend("year"))]
    df = records(spark, "/root/testdata/sf0.001")
    once = A.evaluate_batch(df, specs, once=True)
    assert "lineitem.parquet" not in once._jdf.queryExecution().executedPlan().toString() and not once.inputFiles() == []
    assert sorted(map(str, once.collect())) == sorted(map(str, A.evaluate_batch(df, specs).collect()))


def part(folder, name, size, at=None):
    """A file of zeros with holes, one byte of which may be another."""
    with open(folder / name, "r+b" if (folder / name).exists() else "wb") as f:
        f.truncate(size)
        if at is not None:
            f.seek(at)
            f.write(b"\x01")


def test_a_file_over_two_gigabytes_is_summed(spark, tmp_path):
    """2.2 GB as one file; a changed byte is found in its range, and the file's sum is that of its ranges."""
    size, at = (2 << 30) + 200_000_003, (2 << 30) + 5
    part(tmp_path, "part-big", size)
    keep = lambda df: spark.createDataFrame(df.collect(), df.schema)
    before = keep(ranges.range_checksums(spark, str(tmp_path)))
    assert before.count() == -(-size // ranges.RANGE) and before.agg(F.sum("size")).first()[0] == size
    part(tmp_path, "part-big", size, at)
    now = keep(ranges.range_checksums(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()))
    assert [tuple(r) for r in ranges.changed_ranges(before, now).collect()] == [("part-big", at // ranges.RANGE * ranges.RANGE, "changed")]
    assert ranges.file_checksums(before).first().sha256 != ranges.file_checksums(now).first().sha256
    assert now.select("task").distinct().count() > 8


def test_sums_of_ranges(spark, tmp_path):
    """Against hashlib: files below, at and over the range, names with signs; files that come and go, an empty one."""
    sizes = {"part-1": 9, "part-2": 10, "part-3": 11, "part- %41#4": 35}
    for name, n in sizes.items():
        (tmp_path / name).write_bytes(bytes(range(n)))
    (tmp_path / "other").write_bytes(b"x")
    (tmp_path / "part-0").write_bytes(b"")
    found = ranges.range_checksums(spark, str(tmp_path), 10)
    sums = {r.path.rsplit("/", 1)[1]: r.sha256 for r in ranges.file_checksums(found).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def plain(n):
        parts = [sha(bytes(range(n))[i : i + 10]) for i in range(0, max(n, 1), 10)]
        return parts[0] if len(parts) == 1 else sha(f"{len(parts)}:{','.join(parts)}".encode())

    assert sums == {name: plain(n) for name, n in sizes.items()}
    kept = spark.createDataFrame(found.collect(), found.schema)
    (tmp_path / "part-3").unlink()
    (tmp_path / "part-5").write_bytes(b"y")
    states = {(r.name, r.start, r.state) for r in ranges.changed_ranges(kept, ranges.range_checksums(spark, str(tmp_path), 10)).collect()}
    assert states == {("part-3", 0, "missing"), ("part-3", 10, "missing"), ("part-5", 0, "unlisted")}


def test_a_filter_on_any_column_opens_few_files(spark, tmp_path):
    """64 files; one value of any of three columns is in half of them at most, two values in a fifth; nothing is lost."""
    h = lambda k, n: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n)).cast("int")
    df = spark.range(40_000).select("id", F.concat(F.lit("brand-"), h(1, 25)).alias("brand"), h(2, 8).alias("year"), (h(3, 1000) / 7).alias("price"))
    path = str(tmp_path / "x")
    layout.write_layout(df, path, ["brand", "year", "price"], 64)
    total = spark.read.parquet(f"{path}/files").agg(F.count("*").alias("n"), F.sum("rows").alias("rows"), F.max("rows").alias("most")).first()
    assert total.n >= 56 and total.rows == 40_000 and total.most < 3 * 40_000 / 64
    for asked in ({"brand": ("brand-7", "brand-7")}, {"year": (3, 3)}, {"price": (20.0, 21.0)}):
        assert len(layout.files_for(spark, path, asked)) <= total.n / 2, asked
        (c, (low, high)) = next(iter(asked.items()))
        assert sorted(r.id for r in layout.read_layout(spark, path, asked).collect()) == sorted(r.id for r in df.where(F.col(c).between(low, high)).collect())
    two = {"brand": ("brand-7", "brand-7"), "year": (3, 3)}
    assert len(layout.files_for(spark, path, two)) <= total.n / 5
    assert layout.read_layout(spark, path, two).count() == df.where("brand = 'brand-7' AND year = 3").count()
    assert layout.read_layout(spark, path, {"year": (6, None)}).count() == df.where("year >= 6").count()
    assert layout.read_layout(spark, path, {"year": (99, None)}).count() == 0


def test_layout_of_hot_and_odd_rows(spark, tmp_path):
    """A value with most rows is dealt over files; nulls and long texts are kept; an empty table has no files."""
    rows = spark.range(8000).select("id", F.when(F.col("id") % 3 < 2, "hot").when(F.col("id") % 7 == 0, F.repeat(F.lit("z"), 5000)).when(F.col("id") % 7 > 3, F.col("id").cast("string")).alias("a"), F.lit(None).cast("int").alias("b"))
    path = str(tmp_path / "x")
    layout.write_layout(rows, path, ["a", "b"], 16)
    assert spark.read.parquet(f"{path}/files").agg(F.max("rows")).first()[0] < 2000
    assert spark.read.parquet(f"{path}/rows").count() == 8000
    for low, high in (("hot", "hot"), ("z" * 5000, None), (None, "5"), (None, None)):
        want = rows.where("a IS NOT NULL").where(F.lit(True) if low is None else F.col("a") >= low).where(F.lit(True) if high is None else F.col("a") <= high)
        assert layout.read_layout(spark, path, {"a": (low, high)}).count() == want.count()
    assert layout.read_layout(spark, path, {"b": (None, None)}).count() == 0
    layout.write_layout(rows.where("id < 0"), str(tmp_path / "y"), ["a", "b"], 4)
    assert layout.read_layout(spark, str(tmp_path / "y"), {"a": ("hot", "hot")}).count() == 0
