"""Line deduplication: winnowed line hashes find repeated runs of lines and repeated long lines; later ones go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_hash

#: Lines of a winnowing window: every repeated run of so many lines, or a whole text of fewer, is found.
WINDOW = 3
#: A line of so many words is a window of its own.
LONG = 10
SPACES = " \t\n\x0b\x0c\r"


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def minima(hashes: Column, size: Column) -> Column:
    """Positions of the least hash, the last of equal ones, of every window of size hashes, each once."""
    starts = F.sequence(F.lit(0), F.size(hashes) - size)

    def least(start: Column) -> Column:
        inside = F.transform(F.slice(hashes, start + 1, size), lambda h, i: F.struct(h.alias("h"), (-start - i).alias("at")))
        return -F.array_min(inside)["at"]

    return F.array_distinct(F.transform(starts, least))


def repeated_runs(docs: DataFrame, window: int = WINDOW, long: int = LONG, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Line positions of every text that lie in a run that came before: id, th, gone (array of positions).

    Lines are split at line feeds, compared without white space at their ends, and counted from 0 without
    blank ones. A run is window lines in a row, or all lines of a text with fewer, or one line of long words or more (runs of
    what is no white space); it came before if the same lines in a row stand in a row, as a run of as many lines, earlier in the
    order of id (null first), text hash and position.

    Winnowing picks the least line hash of each window as a fingerprint, so a repeated run has a repeated
    fingerprint, and a text without one is done; a long line, whose window is itself, is one. A fingerprint that occurs once is dropped; from each
    other one the match is extended both ways: every run that holds the fingerprint's line is compared with
    the first run of the same lines. The runs of one text that match overlap to maximal ones. Groups of
    copies meet in one partial aggregate and one join with its result, never pair by pair.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), lambda x: F.trim(x, F.lit(SPACES))), lambda x: x != "")
    line = lambda x: F.struct(F.xxhash64(x).alias("hash"), (F.size(F.split(x, r"[ \t\x0B\f\r]+")) >= long).alias("long"))
    rows = docs.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("th"), F.transform(lines, line).alias("lines"))
    rows = rows.where(F.size("lines") > 0).select("id", "th", F.col("lines.hash").alias("hashes"), F.col("lines.long").alias("long"), F.least(F.size("lines"), F.lit(window)).alias("most"))
    windows = F.transform(minima(F.col("hashes"), F.col("most")), lambda at: F.struct(at.alias("at"), F.col("most").alias("size")))
    own = F.filter(F.sequence(F.lit(0), F.size("hashes") - 1), lambda at: F.col("long")[at] & (F.col("most") > 1))
    prints = rows.withColumn("p", F.explode(F.concat(windows, F.transform(own, lambda at: F.struct(at.alias("at"), F.lit(1).alias("size"))))))
    prints = prints.select("id", "th", "hashes", "p.at", "p.size")
    low = F.greatest(F.lit(0), F.col("at") - F.col("size") + 1)
    prints = cut(
        prints.select(
            "id",
            "th",
            "size",
            F.xxhash64("size", F.col("hashes")[F.col("at")]).alias("print"),
            low.alias("low"),
            # the lines that any run with this one can hold
            F.slice("hashes", low + 1, F.least(F.col("at") + F.col("size"), F.size("hashes")) - low).alias("near"),
        )
    )
    again = prints.groupBy("print").agg(F.count("*").alias("n")).where("n > 1")
    held = prints.join(cut(again), "print", "left_semi")
    places = F.explode(F.transform(F.sequence(F.lit(0), F.size("near") - F.col("size")), lambda i: F.struct((F.col("low") + i).alias("at"), F.xxhash64(F.col("size"), F.slice("near", i + 1, F.col("size"))).alias("run"))))
    runs = held.select("id", "th", "size", places.alias("p")).select("id", "th", "size", "p.at", "p.run")
    place = F.struct("id", "th", "at")
    first = runs.groupBy("run").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("run", "first")
    later = cut(runs).join(cut(first), "run").where(F.struct("id", "th", "at") != F.col("first"))
    lines_gone = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("at"), F.col("at") + F.col("size") - 1)))))
    return later.groupBy("id", "th").agg(lines_gone.alias("gone"))


def drop_later_runs(docs: DataFrame, window: int = WINDOW, long: int = LONG, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's text without the runs of lines that came before (see repeated_runs).

    Returns per row: id, n_lines (not blank), n_removed, kept (the text without the removed lines, else as
    it is). Null, empty and blank texts have no lines and stay. Rows of equal id and text count as one
    document: neither removes the other, and both lose what came before them elsewhere.
    """
    gone = cut(repeated_runs(docs, window, long, id_col, text_col))
    rows = docs.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    gone = gone.select(F.col("id").alias("gone_id"), F.col("th").alias("gone_th"), "gone")
    rows = rows.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("th") == F.col("gone_th")), "left")
    raw = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    blank = lambda x: F.trim(x, F.lit(SPACES)) == ""
    n_lines = F.size(F.filter(raw, lambda x: ~blank(x)))

    def without(lines: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(lines) - 1)
        said = F.filter(every, lambda i: ~blank(lines[i]))
        left = let(said, lambda at: F.array_except(every, F.transform("gone", lambda g: at[g])))
        return F.array_join(F.transform(left, lambda i: lines[i]), "\n")

    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(let(raw, without))
    return rows.select("id", n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), kept.alias("kept"))
