"""Quality rules: base counts, and the divergence of a document from its language's references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_hash

#: White space as the word pattern has it.
SPACES = " \t\n\x0b\x0c\r"
#: Symbols that the base counts.
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5

#: The most common words of each language that has references.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "on", "with", "as", "be", "this", "from"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"],
}
#: Character classes of the histogram, besides white space, SYMBOLS, the bytes beyond the first of each
#: character, and all other characters.
CLASSES = ["[A-Z]", "[0-9]", "[.,;:'\"?()-]", "!"]
N_CLASSES = len(CLASSES) + 4

#: Limits of the method: Jensen-Shannon distance (base 2) to the language's character classes and common
#: words, judged from so many characters and words on.
CLASS_LIMIT = 0.3
WORD_LIMIT = 0.31
LEAST_CHARS = 300
LEAST_WORDS = 100


def let(value: Column, f) -> Column:
    """f of the one item of an array: the item is computed once, however often f uses it."""
    return F.transform(value, f)[0]


def split_words(text: Column) -> Column:
    trimmed = F.trim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(SPACES)) != "")
    return let(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))


def repeat_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more in the list, the first included."""
    n = F.size(words)
    each = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[words[i + k] for k in range(WINDOW)]))
    hashes = F.when(n < WINDOW, F.array().cast("array<long>")).otherwise(each)

    def covered(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twin = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
            return F.sort_array(F.transform(twin, lambda x: x["i"]))

        # the part of each window that no earlier one covers
        start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end"))
        return F.aggregate(
            let(F.array(ranked), places),
            start,
            lambda a, x: F.struct((a["sum"] + x + WINDOW - F.greatest(a["end"], x)).alias("sum"), (x + WINDOW).alias("end")),
            lambda a: a["sum"],
        )

    return let(F.array(hashes), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def common_counts(words: Column, lang: Column) -> Column:
    """Counts of the language's common words, and of all other words."""
    table = F.create_map(*[x for k, v in COMMON.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    bins = len(next(iter(COMMON.values())))
    own = F.coalesce(table[F.coalesce(lang, F.lit(""))], F.array().cast("array<string>"))
    short = F.filter(words, lambda w: F.length(w) <= max(len(x) for v in COMMON.values() for x in v))
    places = let(F.array(own), lambda c: F.filter(F.transform(short, lambda w: F.array_position(c, F.lower(w))), lambda p: p > 0))
    counted = lambda p: F.transform(F.sequence(F.lit(1), F.lit(bins)), lambda k: F.size(F.filter(p, lambda x: x == k)).cast("long"))
    return let(F.array(places), lambda p: F.concat(counted(p), F.array((F.size(words) - F.size(p)).cast("long"))))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id, th, lang, the base counts, and the histograms classes and common."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("th"), F.col(lang_col).alias("lang"), text.alias("text"))
    rows = rows.withColumn("words", split_words(F.col("text")))
    rows = rows.select(
        "id",
        "th",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        dup_lines(F.col("text")).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.length("text").cast("long").alias("n_chars"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.array(*[F.regexp_count("text", F.lit(c)).cast("long") for c in CLASSES]).alias("counted"),
        common_counts(F.col("words"), F.col("lang")).alias("common"),
    )
    known = [F.col("n_chars") - F.col("word_chars"), F.col("n_symbols"), *[F.col("counted")[i] for i in range(len(CLASSES))]]
    rest = F.col("n_chars") - sum(known, start=F.lit(0).cast("long"))
    return rows.withColumn("classes", F.array(*known, F.col("n_bytes") - F.col("n_chars"), rest)).drop("counted", "n_bytes")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def references(rows: DataFrame) -> DataFrame:
    """Each language's histograms: the shares of all characters and words of its documents that pass the base. A row for
    each language of COMMON at most."""
    rows = rows.where(F.col("lang").isin(*COMMON) & ~base_failed())
    sizes = {"classes": N_CLASSES, "common": len(next(iter(COMMON.values()))) + 1}
    sums = {h: F.array(*[F.sum(F.col(h)[i]) for i in range(n)]) for h, n in sizes.items()}
    return rows.groupBy("lang").agg(*[shares(sums[h]).alias(f"{h}_ref") for h in sizes])


def shares(counts: Column) -> Column:
    """Counts as shares of their sum; null without any."""
    total = F.aggregate(counts, F.lit(0).cast("double"), lambda a, x: a + x)
    return F.when(total > 0, F.transform(counts, lambda x: x / total))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of shares."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: (part(a, b) + part(b, a)) / 2)
    distance = F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)))
    return F.when(p.isNotNull() & q.isNotNull(), distance)


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", class_limit: float = CLASS_LIMIT, word_limit: float = WORD_LIMIT, least_chars: int = LEAST_CHARS, least_words: int = LEAST_WORDS) -> DataFrame:
    """Base counts, distances and verdict of every row.

    A document fails the base with fewer than 10 words, or with more than 20% of its words in repeated
    5-word windows. Others are kept unless a distance is over its limit, for texts long enough to judge
    (least_chars, least_words). The references are the language's totals over all documents that pass the base;
    a language without a list of common words, and a null one, has no references: its documents are kept if
    they pass the base.

    Returns per row: id, th, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, class_distance, word_distance (null without reference), kept. Null and blank texts have
    zero counts and fail the base.
    """
    rows = cut(features(docs, id_col, text_col, lang_col))
    rows = rows.join(F.broadcast(cut(references(rows))), "lang", "left")  # four rows
    class_distance = js_distance(shares(F.col("classes")), F.col("classes_ref"))
    word_distance = js_distance(shares(F.col("common")), F.col("common_ref"))
    rows = rows.select(
        "id", "th", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), class_distance.alias("class_distance"), word_distance.alias("word_distance"), "n_chars",
    )
    odd = (F.col("n_chars") >= least_chars) & (F.col("class_distance") > class_limit) | (F.col("n_words") >= least_words) & (F.col("word_distance") > word_limit)
    return rows.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(odd, F.lit(False))).drop("n_chars")
