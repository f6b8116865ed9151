"""Quality rules: divergence of a text's histograms from its language's reference.

The references are the character classes and the most common words of all texts of a
language, counted over the whole table. A text is rejected if the Jensen-Shannon distance
of its character classes, or of its common words, from the reference exceeds a limit;
texts too short for a histogram to mean anything are only judged by the base rules.

The few most common words have a bin each. The hundreds after them share bins by rank,
each for as many words as all before it: a short text holds only some of these words, and
with a bin for each would be as far from its own language as from any other. All other
words are the last bin. The limit is below the distance of a text with no common word.
Built-in functions alone; the table is read once for the references and once for the
verdicts, and only counts are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 20, 30, 8
#: Character classes, which share no character; the rest of the text is one more class. The largest come first.
CLASSES = {
    "lower": r"\p{Ll}+", "space": r"[\x20\x09-\x0D]+", "stop": r"[.,;:'()-]+", "upper": r"\p{Lu}+",
    "symbol": r"[#*$%&|<>!?@=_+/\\^~{}\[\]]+", "digit": r"[0-9]+",
}
#: For each common word by rank, the letter of its bin.
RANKS = "abcdefghijkl" + "m" * 12 + "n" * 24 + "o" * 48 + "p" * 96 + "q" * 192
COMMON_WORDS, BINS = len(RANKS), sorted(set(RANKS))
SLOTS = 512  # of the hash table in which a language's common words are looked up
MIN_CHARACTERS, MIN_COMMON = 200, 60
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.22, 0.4
MIN_REFERENCE = 2000  # words a language needs, else its texts are only judged by the base rules
MAX_LANGUAGES = 1000  # broadcast up to so many references, of about 40 kB each


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _with_classes(rows: DataFrame, text: str) -> DataFrame:
    """rows with __classes_of: counts of the characters of a text column by class, each taken out of what those before it left."""
    names = [f"__class_{c}" for c in CLASSES]
    # invalid bytes become U+FFFD, as in the texts that regexp_replace returns, so that lengths can be subtracted
    rows = rows.withColumn("__left", F.make_valid_utf8(F.col(text)))
    for n, c in zip(names, CLASSES.values()):
        rows = rows.withColumn("__next", F.regexp_replace("__left", c, ""))
        rows = rows.withColumn(n, (F.length("__left") - F.length("__next")).cast("long")).drop("__left").withColumnRenamed("__next", "__left")
    return rows.withColumn("__classes_of", F.array(*names, F.length("__left").cast("long"))).drop(*names, "__left")


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, classes, top, common) for each language: counts by class, its most common words, their counts by bin and that of all others.

    Null is a language of its own.
    """
    rows = docs.select(F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = len(CLASSES) + 1
    sums = _with_classes(rows, "text").groupBy("lang").agg(F.array(*(F.sum(F.col("__classes_of")[i]) for i in range(n))).alias("classes"))
    counts = rows.select("lang", F.explode_outer(_words(F.lower("text"))).alias("w")).filter("w is not null").groupBy("lang", "w").agg(F.count("*").alias("n"))
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    # the first by count of each hash part of a language, then the first of those: no task holds a whole language
    part = F.pmod(F.xxhash64("w"), F.lit(64))
    order = [F.col("n").desc(), F.col("w")]
    some = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).filter(F.col("r") <= COMMON_WORDS)
    best = some.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("r") <= COMMON_WORDS)
    tops = best.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("r", "w", "n"))).alias("t"))
    tops, total = tops.withColumnRenamed("lang", "l1"), total.withColumnRenamed("lang", "l2")
    out = sums.join(tops, F.col("lang").eqNullSafe(F.col("l1")), "left").join(total, F.col("lang").eqNullSafe(F.col("l2")), "left")
    top_n = F.array(*(_total(F.transform(F.slice("t", RANKS.index(b) + 1, RANKS.count(b)), lambda x: x["n"])) for b in BINS))
    return out.select(
        "lang", "classes", F.transform("t", lambda x: x["w"]).alias("top"),
        F.concat(top_n, F.array(F.col("total") - _total(top_n))).alias("common"),
        F.coalesce("total", F.lit(0)).alias("total"),
    )


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)


def _slots(top: str) -> Column:
    """For common words by rank, an array of SLOTS: by a word's _slot, a map of words to the letters of their bins, or null."""
    words = F.transform(top, lambda w, i: F.struct(w.alias("w"), F.substring(F.lit(RANKS), i + 1, F.lit(1)).alias("bin")))
    slots = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda s: F.filter(words, lambda x: _slot(x["w"]) == s))
    return F.transform(slots, lambda x: F.when(F.size(x) > 0, F.map_from_entries(x)))


def _slot(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(SLOTS)).cast("int")


def _with_shares(rows: DataFrame, counts: str, out: str) -> DataFrame:
    """rows with counts as shares of their sum, which is a column of its own so that it is summed once."""
    rows = rows.withColumn("__total", F.greatest(_total(F.col(counts)), F.lit(1).cast("long")))
    return rows.withColumn(out, F.transform(counts, lambda x: x / F.col("__total"))).drop("__total")


def js_distance(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance (0 to 1) of two arrays of shares."""

    def part(x, m):
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))


def base_counts(rows: DataFrame) -> DataFrame:
    """rows with __words and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of column __text."""
    text = F.col("__text")
    bare, plain = text, text
    for c in (" ", "\t", "\n", "\x0b", "\f", "\r"):
        bare = F.replace(bare, F.lit(c), F.lit(""))
    for c in SYMBOLS:
        plain = F.replace(plain, F.lit(c), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumns({
        "__words": _words(text), "word_chars": F.length(bare).cast("long"), "n_symbols": (F.octet_length(text) - F.octet_length(plain)).cast("long"),
        "__lines": F.when(text.contains("\n"), lines).otherwise(F.array().cast("array<string>")),
    })
    rows = rows.withColumns({
        "n_words": F.size("__words").cast("long"), "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__hash": F.transform("__words", lambda w: F.xxhash64(w)),
    }).drop("__lines")
    many = F.size("__hash") > WINDOW
    # elements by number: slice() would copy the whole array for each window; here it cuts off windows beyond the end
    grams = F.transform("__hash", lambda x, i: F.xxhash64(x, *(F.get("__hash", i + k) for k in range(1, WINDOW))))
    grams = F.slice(grams, F.lit(1), F.size("__hash") - (WINDOW - 1))
    rows = rows.withColumn("__grams", F.when(many, grams).otherwise(F.array().cast("array<long>"))).drop("__hash")
    twice = F.size(F.array_distinct("__grams")) < F.size("__grams")
    empty = F.array().cast("array<struct<g:long,i:int>>")
    rows = rows.withColumn("__sorted", F.when(twice, F.array_sort(F.transform("__grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))).otherwise(empty)).drop("__grams")
    # in sorted order, copies of a window are neighbours
    last = F.size("__sorted") - 1
    copies = F.filter("__sorted", lambda x, i: (
        F.when(i > 0, F.col("__sorted")[F.greatest(i - 1, F.lit(0))]["g"] == x["g"]).otherwise(F.lit(False))
        | F.when(i < last, F.col("__sorted")[F.least(i + 1, last)]["g"] == x["g"]).otherwise(F.lit(False))
    ))
    rows = rows.withColumn("__at", F.array_sort(F.transform(copies, lambda x: x["i"]))).drop("__sorted")
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("at"))
    covered = F.aggregate("__at", start, lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["at"])).alias("n"), x.alias("at")), lambda a: a["n"])
    return rows.withColumn("n_repeat_words", covered).drop("__at")


def judged(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance and kept.

    Distances are null where a length guard holds them back, and such texts are kept
    unless the base rules fail them. Null text is as empty: no words, base_failed.
    A word in n_repeat_words counts once, however many repeated windows hold it.
    Columns of these names are replaced; rows stay, repeated ones too.
    """
    refs = references(docs, text_col, lang_col).filter(F.col("total") >= MIN_REFERENCE).drop("total")
    refs = _with_shares(_with_shares(refs, "classes", "__classes"), "common", "__common")
    refs = refs.select(F.col("lang").alias("__lang"), "__classes", _slots("top").alias("__slots"), "__common")
    refs = saved(refs)
    if len(refs.select("__lang").take(MAX_LANGUAGES + 1)) <= MAX_LANGUAGES:
        refs = F.broadcast(refs)
    rows = base_counts(docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit(""))))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).join(refs, F.col(lang_col).eqNullSafe(F.col("__lang")), "left")
    # a text's common words as the letters of their bins, other words as none
    found = F.transform(F.transform("__words", lambda w: F.lower(w)), lambda w: F.try_element_at(F.get("__slots", _slot(w)), w))
    rows = rows.withColumn("__bins", F.when(F.col("__slots").isNotNull(), F.array_join(found, ""))).drop("__words", "__slots")
    mine = [F.octet_length("__bins") - F.octet_length(F.replace("__bins", F.lit(b), F.lit(""))) for b in BINS]
    mine = F.array(*(n.cast("long") for n in mine), F.col("n_words") - F.octet_length("__bins"))
    rows = rows.withColumn("__mine", F.when(F.col("__bins").isNotNull(), mine)).drop("__bins")
    rows = _with_shares(rows, "__mine", "__mine")
    rows = _with_shares(_with_classes(rows, "__text"), "__classes_of", "__classes_of")
    long_enough = F.col("__classes").isNotNull() & (F.length("__text") >= MIN_CHARACTERS)
    rows = rows.withColumns({
        "class_distance": F.when(long_enough, js_distance(F.col("__classes_of"), F.col("__classes"))),
        "word_distance": F.when(F.col("__mine").isNotNull() & (F.col("n_words") >= MIN_COMMON), js_distance(F.col("__mine"), F.col("__common"))),
    })
    diverges = (F.coalesce("class_distance", F.lit(0.0)) > MAX_CLASS_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > MAX_WORD_DISTANCE)
    return rows.withColumn("kept", ~F.col("base_failed") & ~diverges).drop("__text", "__mine", "__classes_of", "__lang", "__classes", "__common")
