"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, cut, row_key, same_row, text_hash, words


def source_key(source: Column) -> Column:
    """A source as a text that is never null: null sorts behind every real source."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def fair_targets(sources: DataFrame, budget: float, most: int) -> DataFrame:
    """Adds target to sources (source_size, weight): the budget shared by weight, none above most times its size.

    Each round shares what is left among the sources that are not full; the full set only grows. One round
    is one aggregate of two numbers, so the number of sources does not matter.
    """
    sources = cut(sources.withColumn("room", (F.col("source_size") * most).cast("double")))
    level = 0.0
    while True:
        full = F.col("room") <= F.col("weight") * level
        row = sources.agg(
            F.coalesce(F.sum(F.when(full, F.col("room"))), F.lit(0.0)).alias("used"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("open"),
        ).first()
        if not row["open"]:
            break
        risen = (budget - row["used"]) / row["open"]
        if risen <= level:
            break
        level = risen
    return sources.withColumn("target", F.least(F.col("room"), F.col("weight") * F.lit(level))).drop("room")


def packets(most: int) -> Column:
    """A document's passes as packets (finish, words) of its queue, with the virtual finish time of each: words of the
    queue up to its end, over the source's target. The packet in service at the target is two, before and behind it."""
    goal, size = F.floor("target"), F.col("size")
    out = []
    for k in range(most):
        start, end = F.col("end") - size + F.lit(k) * F.col("source_size"), F.col("end") + F.lit(k) * F.col("source_size")
        inside = F.greatest(F.lit(0), F.least(size, goal - start))  # words before the target
        both = ((F.when(inside < size, goal).otherwise(end), inside), (end, size - inside))
        out += [F.struct(F.try_divide(at, F.col("target")).alias("finish"), words.cast("long").alias("words")) for at, words in both]
    return F.filter(F.array(*out), lambda x: (x["words"] > 0) & x["finish"].isNotNull())


def end_of_budget(queue: DataFrame, budget: int) -> float | None:
    """The virtual time at which a budget of words ends: packets (finish, words) are range-sorted by their finish, summed
    up over the ranges and then inside the range that passes the budget; packets of one time go together."""
    ranged = cut(queue.repartitionByRange("finish").withColumn("range", F.spark_partition_id()))
    sums = ranged.groupBy("range").agg(F.sum("words").alias("words"), F.max("finish").alias("last"))  # one row a range
    upto = F.sum("words").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.withColumn("upto", upto)
    within = F.col("upto") <= budget
    row = sums.agg(
        F.max(F.when(within, F.col("last"))).alias("last"),
        F.coalesce(F.max(F.when(within, F.col("upto"))), F.lit(0)).alias("upto"),
        F.min(F.when(~within, F.col("range"))).alias("next"),
    ).first()
    if row["next"] is None:
        return row["last"]
    running = F.sum("words").over(Window.orderBy("finish").rangeBetween(Window.unboundedPreceding, 0))
    inside = ranged.where(F.col("range") == row["next"]).withColumn("upto", running + row["upto"]).where(F.col("upto") <= budget)
    last = inside.agg(F.max("finish").alias("last")).first()["last"]
    return row["last"] if last is None else last


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """What a mix takes of every document.

    Sources, by code point and null last, have the weights in turn. The budget is share times all words;
    fair_targets gives each source its part, in whole words. Each source is a queue: its documents in a seeded
    shuffled order, the whole queue repeated up to most times. A document's virtual finish time is the words of
    its queue up to its end, divided by the source's target. All queues are range-sorted by it together, and the
    order is cut off where the total budget is spent. The document that a queue is serving when it has reached
    its target counts as two, so it is cut short there, and each source's words are its target, rounded down.

    Returns per row: id, th (text hash), size, source, source_size, target, taken (words, repeats counted),
    finish (virtual finish time of the first pass; null for a source with target 0).

    Null and blank texts have size 0 and take 0. Null ids are shuffled like any other. Rows of one id stand in
    the order of their text hashes, and the same rows next to each other; queues are cut into ranges of rows, so
    neither a hot source nor an id of many rows meets in one task. An empty table gives an empty result.
    """
    rows = cut(
        docs.select(
            F.col(id_col).alias("id"),
            text_hash(F.col(text_col)).alias("th"),
            count_words(F.col(text_col)).alias("size"),
            F.col(source_col).alias("source"),
            source_key(F.col(source_col)).alias("key"),
            F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))).alias("h"),
        )
    )
    words = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    sources = rows.groupBy("key").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy("key")) - 1  # one row a source
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights)) + 1)
    targets = cut(fair_targets(sources.withColumn("weight", weight), share * words, most))
    budget = targets.agg(F.coalesce(F.sum(F.floor("target")), F.lit(0))).first()[0]

    rows = cut(rows.repartitionByRange("key", "h", "th").withColumn("part", F.spark_partition_id()))
    parts = rows.groupBy("key", "part").agg(F.sum("size").alias("part_size")).join(targets, "key")
    before = F.sum("part_size").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("key", "part", "source_size", "target", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("key", "part").orderBy("h", "th").rowsBetween(Window.unboundedPreceding, 0))
    queue = rows.withColumn("inside", inside).join(parts, ["key", "part"]).withColumn("end", F.col("before") + F.col("inside"))
    finish = F.when(F.col("target") > 0, F.col("end") / F.col("target"))
    queue = cut(queue.select("id", "th", "size", "source", "source_size", "target", finish.alias("finish"), packets(most).alias("packets")))

    last = end_of_budget(queue.select(F.inline("packets")), budget)
    served = F.filter("packets", lambda x: x["finish"] <= F.lit(last).cast("double"))
    taken = F.aggregate(served, F.lit(0).cast("long"), lambda n, x: n + x["words"])
    return queue.select("id", "th", "size", "source", "source_size", "target", taken.alias("taken"), "finish")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", **options) -> DataFrame:
    """docs, all columns, as the mix takes them: a row for each pass of a document (see mix).

    A pass that is cut short has the words that it takes, joined by one space, and their length in
    chars_col if docs has such a column. Rows of equal id and text are one document here, which takes what
    they take together. A document that the mix does not reach is left out, and so is one without words.
    """
    names = docs.columns
    taken = mix(docs, id_col=id_col, text_col=text_col, **options).where("taken > 0")
    taken = taken.groupBy("id", "th").agg(F.sum("taken").alias("taken"), F.max("size").alias("size"))
    taken = taken.select(F.col("id").alias("__id"), F.col("th").alias("__th"), "taken", "size", row_key(F.col("id"), F.col("th")).alias("__tkey"))
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    ident, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    rows = rows.withColumn("__rth", text_hash(F.col(text))).withColumn("__key", row_key(F.col(ident), F.col("__rth")))
    same = same_row(F.col(ident), F.col("__rth"), F.col("__id"), F.col("__th"))
    rows = rows.join(taken, (F.col("__key") == F.col("__tkey")) & same).dropDuplicates(["__key", ident, "__rth"])
    turns = F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1))
    rows = rows.withColumn("turn", turns).withColumn("served", F.least(F.col("size"), F.col("taken") - F.col("turn") * F.col("size")).cast("int"))
    whole = F.col("served") == F.col("size")
    part = F.array_join(F.slice(words(F.col(text)), F.lit(1), F.col("served")), " ")
    rows = rows.withColumn("part", F.when(whole, F.col(text)).otherwise(part))
    out = {text_col: F.col("part")}
    if chars_col in names:
        chars = f"c{names.index(chars_col)}"
        out[chars_col] = F.when(whole, F.col(chars)).otherwise(F.length("part").cast(docs.schema[chars_col].dataType))
    return rows.select(*[out.get(n, F.col(f"c{i}")).alias(n) for i, n in enumerate(names)])
