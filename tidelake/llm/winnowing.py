"""Benchmark decontamination by winnowing.

Of each run of SHARED - GRAM + 1 overlapping word grams the one of least hash is kept, so
that any SHARED words that a document shares with an item hold a kept gram of both, at the
same place. Kept grams of documents are joined with those of the items; a hit is extended
to each window that had the gram at this place in an item, and the window's words are
compared with the items' windows. Items shorter than SHARED words are one window, found by
the hash of their first words, up to SEED. Built-in functions alone.

Grams are rows of numbers. The few that an item has too get their windows, and nothing is
joined pair by pair: a window meets the distinct windows of all items, and these name the
set of items that hold them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, saved

SHARED, GRAM, SEED = 13, 6, 4
SPAN = SHARED - GRAM + 1  # grams of a window
BLOCK = 6  # windows whose least grams one row computes, in straight code
#: Characters between words: ASCII but for letters and digits.
BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
#: The same one by one, as a regular expression looks single characters up in a table.
NO_WORD = "[" + "".join(f"\\x{ord(c):02X}" for c in BETWEEN) + "]+"
BLOCK = 6  # windows whose least grams one row computes, in straight code
#: Characters between words, ASCII but for letters and digits; one by one, as a regular expression looks single characters up in a table.
NO_WORD = "[" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"
BROADCAST_WORDS = 500_000  # words of all items up to which their windows are broadcast, some 100 bytes each
BROADCAST_FOUND = 500_000  # contaminated documents up to which these are broadcast, 16 bytes each


def words_column(text: Column) -> Column:
    """Words of a text, A-Z lower-cased: letters, digits and all that is not ASCII. Null: none."""
    text = F.btrim(F.coalesce(text, F.lit("")), F.lit(BETWEEN))
    plain = F.length(text) == F.octet_length(text)  # pure ASCII is lower-cased as a whole
    words = F.when(plain, F.split(F.lower(text), NO_WORD)).otherwise(F.transform(F.split(text, NO_WORD), ascii_lower))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(words)


def _grams(rows: DataFrame, short: list[int], mark_rows: bool = False) -> DataFrame:
    """rows with array __h, hashes of words, as rows of (k, h, p): words, hash and place of each kept gram, and of all grams of `short` words.

    mark_rows: each row also gives an entry with k = 0.

    The least of a run is that of least hash, the first of equal ones. Each step's columns
    are used several times by the next, so Spark keeps the steps apart and compiles them as
    one method, without an object for a gram. What lies beyond the end is computed, as
    that needs no test for nulls, and left out at the end. BLOCK is bounded by the 8,000
    bytes of code up to which the JVM compiles a method.
    """
    near = SHARED - 1 + BLOCK
    base, size = F.col("__i"), F.col("__n")
    own = [c for c in rows.columns if c != "__h"]
    step = rows.select(*own, "__h", F.size("__h").alias("__n"))
    step = step.select(*own, "__h", "__n", F.explode_outer(F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(BLOCK)))).alias("__i"))
    words = [F.coalesce(F.get("__h", base + j), F.lit(0).cast("long")).alias(f"__w{j}") for j in range(near)]
    step = step.select(*own, F.coalesce(base, F.lit(0)).alias("__i"), F.coalesce(size, F.lit(0)).alias("__n"), *words)
    gram = lambda j, k: F.shiftleft(F.xxhash64(*(F.col(f"__w{j + x}") for x in range(k))), 32) + (base + j).cast("long")
    all_grams = F.array(*(F.when(base + j + k <= size, gram(j, k)) for k in short for j in range(BLOCK))).cast("array<long>").alias("__short")
    step = step.select(*own, "__i", "__n", *([all_grams] if short else []), *(gram(j, GRAM).alias(f"__g{j}") for j in range(near - GRAM + 1)))
    own += ["__short"] if short else []
    for shift, count in ((1, near - GRAM), (2, near - GRAM - 2), (SPAN - 4, BLOCK)):  # the least of 2, of 4, of all grams of a window
        step = step.select(*own, "__i", "__n", *(F.least(F.col(f"__g{j}"), F.col(f"__g{j + shift}")).alias(f"__g{j}") for j in range(count)))
    # neighbouring windows often keep the same gram; it is sent once
    fits = [base + j + SHARED <= size for j in range(BLOCK)]
    kept = F.array(F.when(fits[0], F.col("__g0")), *(F.when(fits[j] & (F.col(f"__g{j}") != F.col(f"__g{j - 1}")), F.col(f"__g{j}")) for j in range(1, BLOCK)))
    own = [c for c in own if c != "__short"]
    last = [F.array(F.when(base == 0, F.lit(0).cast("long")))] if mark_rows else []
    entries = F.concat(kept, *([F.col("__short")] if short else []), *last) if short or last else kept
    step = step.select(*own, F.posexplode_outer(entries).alias("__at", "__x")).filter("__x is not null")
    k = F.lit(GRAM)
    for n, words in enumerate([*short, *([0] if mark_rows else [])]):
        k = F.when(F.col("__at") >= BLOCK * (n + 1), F.lit(words)).otherwise(k)
    return step.select(*own, k.alias("k"), F.shiftright("__x", 32).alias("h"), F.col("__x").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("p"))


def _window(words: str, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(F.col(words), start + 1, size), " ")


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(id, mark, n_words, n_hit, items) for each document; mark: hash of the text, as rows of one id may differ.

    n_hit: words inside an occurrence of a window of an item. items: ids, as strings, of
    items with an occurring window, each once; an item without id hits but isn't listed.
    """
    items = saved(benchmark.select(F.col(item_col).cast("string").alias("item"), words_column(F.col(text_col)).alias("w")).filter(F.size("w") > 0).withColumn("n", F.size("w")))
    sizes = items.agg(F.sum("n").alias("n"), F.collect_set(F.when(F.col("n") < SHARED, F.least("n", F.lit(SEED)))).alias("short")).first()
    short, small = sorted(sizes["short"]), (sizes["n"] or 0) <= broadcast_words
    hint = F.broadcast if small else (lambda frame: frame)
    t = F.least("n", F.lit(SHARED))
    # the distinct windows of all items; a window names the set of its items
    places = items.select("item", "w", t.alias("t"), F.explode(F.sequence(F.lit(0), F.col("n") - t)).alias("s"))
    windows = places.select("item", _window("w", F.col("s"), F.col("t")).alias("window")).groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    windows = saved(windows.select("window", "items", F.md5(F.to_json("items").cast("binary")).alias("set")))
    sets = windows.select("set", "items").dropDuplicates(["set"])
    # for each kept gram of an item: by how many words the windows that hold it begin before it
    seeds = _grams(items.withColumn("__h", F.transform("w", lambda w: F.xxhash64(w))).select("n", "__h"), short)
    before = F.when(F.col("n") >= SHARED, F.sequence(F.greatest(F.lit(0), F.col("p") + SHARED - F.col("n")), F.least(F.lit(SPAN - 1), F.col("p")))).otherwise(F.array(F.lit(0)))
    own_gram = F.when(F.col("n") >= SHARED, F.col("k") == GRAM).otherwise((F.col("p") == 0) & (F.col("k") == F.least("n", F.lit(SEED))))
    seeds = seeds.filter(own_gram).select("k", "h", F.least("n", F.lit(SHARED)).alias("t"), F.explode(before).alias("b"))
    seeds = saved(seeds.groupBy("k", "h").agg(F.collect_set(F.struct("t", "b")).alias("around")))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), words_column(F.col(text_col)).alias("w"))
    rows = rows.withColumn("n_words", F.size("w").cast("long"))
    hashed = rows.withColumn("__h", F.transform("w", lambda w: F.xxhash64(w)))
    start, n = F.col("p") - F.col("x.b"), F.col("x.t")
    fits = (start >= 0) & (start + n <= F.col("n_words"))
    if small:  # compiled as one with the grams, so that no words are copied but those of a window
        found = _grams(hashed, short, mark_rows=True).join(F.broadcast(seeds), ["k", "h"], "left").filter("around is not null or k = 0")
        found = found.select("id", "mark", "n_words", "w", "k", "p", F.explode_outer("around").alias("x")).filter(fits | (F.col("k") == 0))
        found = found.select("id", "mark", "n_words", start.alias("a"), n.alias("t"), F.when(F.col("k") != 0, _window("w", start, n)).alias("window"))
    else:  # grams without words are shuffled, then meet the words of documents with a partner
        met = _grams(hashed.drop("w"), short).join(seeds, ["k", "h"]).select("id", "mark", "n_words", "p", F.explode("around").alias("x")).filter(fits)
        met = met.select("id", "mark", start.alias("a"), n.alias("t")).groupBy("id", "mark").agg(F.collect_set(F.struct("a", "t")).alias("places"))
        met = met.withColumnsRenamed({"id": "__id", "mark": "__mark"})
        found = rows.dropDuplicates(["id", "mark"]).join(met, rows["id"].eqNullSafe(met["__id"]) & (rows["mark"] == met["__mark"]), "left")
        found = found.select("id", "mark", "n_words", "w", F.explode_outer(F.concat("places", F.array(F.lit(None).cast("struct<a:int,t:int>")))).alias("x"))
        found = found.select("id", "mark", "n_words", "x.a", "x.t", F.when(F.col("x").isNotNull(), _window("w", F.col("x.a"), F.col("x.t"))).alias("window"))
    named = windows.select(F.col("window").alias("__window"), "set")
    found = found.join(hint(named), F.col("window") == F.col("__window"), "left").filter("set is not null or window is null")
    spans = found.select("id", "mark", "n_words", "a", (F.col("a") + F.col("t")).alias("b"), "set").distinct()
    span = F.when(F.col("set").isNotNull(), F.struct("a", "b"))
    own = saved(spans.groupBy("id", "mark").agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_set(span)).alias("spans"), F.collect_set("set").alias("sets")))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    joined = F.aggregate("spans", zero, lambda s, x: F.struct(
        (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["upto"]))).alias("n"), F.greatest(s["upto"], x["b"]).alias("upto")
    ), lambda s: s["n"])
    own = own.select("id", "mark", "n_words", joined.alias("n_hit"), "sets")
    listed = own.select("id", "mark", F.explode("sets").alias("set")).join(hint(sets), "set").select("id", "mark", F.explode("items").alias("item"))
    listed = listed.groupBy(F.col("id").alias("__id"), F.col("mark").alias("__mark")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = own.join(listed, F.col("id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark")), "left")
    return out.select("id", "mark", "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """docs with n_words, n_hit, items (array of strings) and contaminated in place of columns of those names.

    Contaminated: a hit, and at least every twentieth word inside one. Null and empty
    texts have no words and aren't contaminated. An empty benchmark hits nothing. Rows
    stay, repeated ones too. The text is shuffled only if the caller uses that column.
    """
    found = hits(docs, benchmark, id_col, text_col, item_col, broadcast_words).withColumnsRenamed({"id": "__id", "mark": "__mark"})
    found = found.withColumn("contaminated", _contaminated())
    new = ("n_words", "n_hit", "items", "contaminated")
    rows = docs.drop(*new).withColumn("__of", F.xxhash64(text_col))
    return rows.join(found, rows[id_col].eqNullSafe(found["__id"]) & (rows["__of"] == found["__mark"])).drop("__of", "__id", "__mark")


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", broadcast_words: int = BROADCAST_WORDS, broadcast_found: int = BROADCAST_FOUND) -> DataFrame:
    """docs without the contaminated rows, judged as decontaminate() does. Columns stay as they are.

    Up to broadcast_found contaminated documents are broadcast, so that no text is shuffled.
    """
    bad = saved(hits(docs, benchmark, id_col, text_col, item_col, broadcast_words).filter(_contaminated()).select(F.col("id").alias("__id"), F.col("mark").alias("__mark")))
    few = bad.count() <= broadcast_found
    rows = docs.withColumn("__of", F.xxhash64(text_col))
    return rows.join(F.broadcast(bad) if few else bad, rows[id_col].eqNullSafe(bad["__id"]) & (rows["__of"] == bad["__mark"]), "left_anti").drop("__of")
