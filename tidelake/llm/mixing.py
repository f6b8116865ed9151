"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document has the key -ln(u) / quality, u uniform from a hash of its id and text.
Within a source, whole epochs come first; what remains of the source's target is filled
with documents in ascending key order until their summed sizes come nearest to it. The
prefix sums need no ordering of a whole source: sizes are summed by (source, key range),
the range that holds the boundary is found from these sums, then in the same way a finer
range inside it, and only the documents of that one are ordered. Ranges are even in
key / (1 + key), which spreads the keys of good and of bad documents alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, saved

RANGES = 4096  # and as many finer ones in each
MAX_EPOCHS = 3
BROADCAST_SOURCES = 100_000  # sources up to which what is known of them is broadcast, some 100 bytes each
WEIGHTS = (5, 2, 1)


def size_column(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_column(text: Column) -> Column:
    """Quality weight, 0.05 to 1: falls with the share of symbols. Null and empty texts: 1."""
    share = F.length(F.regexp_replace(text, r"[^#*$%&|<>!]+", "")) / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(5.0) * share), F.lit(1.0))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row for each source.

    Sources by code point, null last, weigh `weights`, repeating. Targets share the
    total by weight; none exceeds `most` times its source, and the excess is shared
    by weight among the others: the common level is the largest over how many of the
    sources that fill up first are taken as full.
    """
    one = Window.orderBy(F.lit(0))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    w = sizes.withColumn("w", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (turn + 1).cast("int")))
    full = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total, w_all = F.sum("source_size").over(all_rows), F.sum("w").over(all_rows)
    level = (total - most * F.coalesce(F.sum("source_size").over(full), F.lit(0))) / (w_all - F.coalesce(F.sum("w").over(full), F.lit(0.0)))
    out = w.withColumn("level", level).withColumn("level", F.max("level").over(all_rows))
    return out.select("source", "source_size", F.least((F.col("source_size") * most).cast("double"), F.col("w") * F.col("level")).alias("target"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS, most: int = MAX_EPOCHS, seed: int = 17, quality: Column | None = None,
) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target, mix_copies and mix_taken.

    mix_size is the number of words (null text: 0), mix_copies how often the mix holds
    the document (0 to `most`), mix_taken = mix_size * mix_copies. Null sources are one
    source. Rows that agree in id and text are taken or left together in the last,
    partial epoch. Rows stay, and other columns, but for any of these five names; no rows:
    none. The sources' targets are worked out in one task, a row for each source.
    """
    text = F.col(text_col)
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    u = (F.conv(F.substring(mark, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    key = -F.log(u) / (quality if quality is not None else quality_column(text))
    new = ("mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_taken")
    cell = F.floor(F.col("__key") / (F.col("__key") + 1) * (RANGES * RANGES)).cast("long")
    rows = docs.withColumns({"__size": size_column(text), "__key": key, "__mark": mark}).withColumn("__cell", cell)
    slim = saved(rows.select(F.col(source_col).alias("source"), "__cell", "__key", "__mark", F.col("__size").alias("size")))
    ranges = saved(slim.groupBy("source", F.floor(F.col("__cell") / RANGES).alias("range")).agg(F.sum("size").alias("words")))
    plan = source_targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    plan = plan.withColumn("__epochs", F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("int"))
    plan = saved(plan.withColumn("rest", F.col("target") - F.col("__epochs") * F.col("source_size")))

    def edge(sums: DataFrame, room: DataFrame) -> DataFrame:
        """(s, range, room): by source, the range of sums in which its room ends, and the room that is left for that range."""
        up_to = Window.partitionBy("s").orderBy("range")
        joined = sums.join(room, F.col("source").eqNullSafe(F.col("s"))).filter("words > 0")
        ends = joined.withColumn("after", F.sum("words").over(up_to)).withColumn("before", F.col("after") - F.col("words"))
        return ends.filter((F.col("after") > F.col("room")) & (F.col("before") <= F.col("room"))).select("s", "range", (F.col("room") - F.col("before")).alias("room"))

    # a source that is taken in whole epochs has no edge
    first = saved(edge(ranges, plan.filter("rest > 0").select(F.col("source").alias("s"), F.col("rest").alias("room"))))
    inside = slim.join(first.select(F.col("s").alias("fs"), F.col("range").alias("wide")), F.col("source").eqNullSafe(F.col("fs")) & (F.floor(F.col("__cell") / RANGES) == F.col("wide")))
    finer = inside.groupBy("source", F.col("__cell").alias("range")).agg(F.sum("size").alias("words"))
    second = saved(edge(finer, first.select("s", "room")))
    in_order = Window.partitionBy("s").orderBy("__key", "__mark")
    last = (
        slim.join(second, F.col("source").eqNullSafe(F.col("s")) & (F.col("__cell") == F.col("range")))
        .groupBy("s", "room", "__key", "__mark").agg(F.sum("size").alias("words"))
        .withColumn("after", F.sum("words").over(in_order)).withColumn("before", F.col("after") - F.col("words"))
        # the nearest: with the crossing document, if that overshoots by less than leaving it out falls short
        .filter((F.col("after") <= F.col("room")) | ((F.col("before") <= F.col("room")) & (F.col("room") - F.col("before") > F.col("after") - F.col("room"))))
        .groupBy("s").agg(F.max(F.struct("__key", "__mark")).alias("__last"))
    )
    plan = plan.join(second.select(F.col("s").alias("s2"), F.col("range").alias("__edge")), F.col("source").eqNullSafe(F.col("s2")), "left")
    plan = saved(
        plan.join(last, F.col("source").eqNullSafe(F.col("s")), "left")
        .select(F.col("source").alias("__s"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), "__epochs", "__edge", "__last")
    )
    if plan.count() <= BROADCAST_SOURCES:  # else texts are shuffled
        plan = F.broadcast(plan)
    more = F.col("__edge").isNotNull() & (F.col("__epochs") < most) & (
        (F.col("__cell") < F.col("__edge"))
        | ((F.col("__cell") == F.col("__edge")) & F.coalesce(F.struct("__key", "__mark") <= F.col("__last"), F.lit(False)))
    )
    copies = F.col("__epochs") + F.coalesce(more, F.lit(False)).cast("int")
    return (
        rows.drop(*new).join(plan, rows[source_col].eqNullSafe(plan["__s"]))
        .withColumns({"mix_size": F.col("__size"), "mix_source_size": F.col("__source_size"), "mix_target": F.col("__target"), "mix_copies": copies})
        .withColumn("mix_taken", F.col("mix_size") * F.col("mix_copies"))
        .drop("__key", "__mark", "__cell", "__size", "__s", "__source_size", "__target", "__epochs", "__edge", "__last")
    )
