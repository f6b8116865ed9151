"""Near-duplicate documents by SimHash and multi-index hashing.

A fingerprint has 64 bits. Two fingerprints link at 3 or fewer differing bits. Split
into two 32-bit halves, such a pair differs in at most one bit in one of the halves, so
each fingerprint probes, for each half, the 33 values within one bit of its own against
a table of exact halves; full distances are verified. Copies with one fingerprint are
collapsed first. A half shared by more than HOT_BUCKET fingerprints isn't joined pair by
pair: its members meet on the other half through balls around their bits, and only links
to the smallest member of each meeting point are kept. These are true links and keep
everything connected, in linear space.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import connected_components, saved

SEED = 42
MAX_BITS = 3
SHINGLE = 3
BLOCK = 1 << 16  # shingles hashed at a time, so that a long text needs no more memory
HOT_BUCKET = 1024
CROWDED = 1000  # rows of one fingerprint, and parts of all rows, beyond which its class is broadcast: at most so many are


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of one text as an unsigned 64-bit integer; null and texts without words: 0."""
    import numpy as np
    import xxhash

    words = (text or b"").lower().split()  # of bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    ones, total = np.zeros(64, np.int64), len(first)
    for i in range(0, total, BLOCK):
        h = [digest(joined[s:e], SEED) for s, e in zip(first[i : i + BLOCK].tolist(), last[i : i + BLOCK].tolist())]
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprint_column(text, shingle: int = SHINGLE):
    """The fingerprint of a text column as a (signed) long."""

    @arrow_udf("long")
    def simhash64(texts):
        import numpy as np
        import pyarrow as pa

        out = np.fromiter((fingerprint(x.as_buffer().to_pybytes() if x.is_valid else None, shingle) for x in texts), np.uint64, len(texts))
        return pa.array(out.view(np.int64))

    return simhash64(text)


def _ball(column, radius: int):
    """All 32-bit values within radius bits of a column, as an array."""
    masks = [sum(1 << b for b in c) for n in range(radius + 1) for c in itertools.combinations(range(32), n)]
    if radius > 1:  # built from the single bits, so that the plan stays small
        one = F.array(*(F.lit(m).cast("long") for m in masks[:33]))
        return F.array_distinct(F.flatten(F.transform(one, lambda a: F.transform(one, lambda b: a.bitwiseXOR(b).bitwiseXOR(column)))))
    return F.transform(F.array(*(F.lit(m).cast("long") for m in masks)), lambda m: m.bitwiseXOR(column))


def _halves(fps: DataFrame) -> DataFrame:
    """(fp, seg, own, other): a row for each half of each fingerprint."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), F.shiftrightunsigned("fp", 32)
    return fps.select(
        "fp",
        F.inline_outer(F.array(
            F.struct(F.lit(0).alias("seg"), low.alias("own"), high.alias("other")),
            F.struct(F.lit(1).alias("seg"), high.alias("own"), low.alias("other")),
        )),
    )


def links(fps: DataFrame, hot: int = HOT_BUCKET) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that connect all those within MAX_BITS bits.

    All such pairs where no half is shared by more than `hot` fingerprints, else a
    subset of them with the same components.
    """
    rows = _halves(fps)
    table = rows.select("seg", F.col("own").alias("key"), F.col("fp").alias("b"))
    probes = rows.select("seg", F.explode_outer(_ball(F.col("own"), 1)).alias("key"), F.col("fp").alias("a"))
    crowded = saved(table.groupBy("seg", "key").count().filter(F.col("count") > hot).select("seg", "key"))
    some_hot = bool(crowded.take(1))
    light, light_probes = table, probes
    if some_hot:
        light = table.join(crowded, ["seg", "key"], "left_anti")
        light_probes = probes.join(crowded, ["seg", "key"], "left_anti")
    found = (
        light_probes.join(light, ["seg", "key"])
        .filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS))
        .select("a", "b")
    )
    if not some_hot:
        return found
    members = rows.join(crowded.withColumnRenamed("key", "own"), ["seg", "own"])
    near = (
        rows.select("fp", "seg", "own", "other", F.explode_outer(_ball(F.col("own"), 1)).alias("key"))
        .filter("key != own").join(crowded, ["seg", "key"])
    )
    # own: member's key; a member meets members within 3 bits of the other half through 2 + 1 bits, the rest through 1 + 1
    table = members.select("seg", F.col("own").alias("key"), "fp", F.explode_outer(_ball(F.col("other"), 1)).alias("at"))
    meets = members.select("seg", F.col("own").alias("key"), "fp", F.explode_outer(_ball(F.col("other"), 2)).alias("at")).unionByName(
        near.select("seg", "key", "fp", F.explode_outer(_ball(F.col("other"), 1)).alias("at"))
    )
    centre = table.groupBy("seg", "key", "at").agg(F.min("fp").alias("b"))
    stars = meets.join(centre, ["seg", "key", "at"]).filter("fp != b").select(F.col("fp").alias("a"), "b")
    return found.unionByName(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT_BUCKET) -> DataFrame:
    """(id, fp, component_id) for each row of docs; other columns are not read.

    component_id is the smallest id reachable over links, the row's own included.
    Null, empty and blank texts have fingerprint zero and link like any other. Rows
    with a null id stay and never name a component; one of null ids alone has a null
    component_id. Repeated rows each give a row. No rows: none.
    """
    prints = saved(docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col)).alias("fp")))
    fps = saved(prints.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    joined = connected_components(links(fps.select("fp"), hot))
    member = joined.join(fps, joined["node"] == fps["fp"]).select("node", "root", "rep")
    roots = member.groupBy("root").agg(F.min("rep").alias("component"))
    moved = member.join(roots, "root").select(F.col("node").alias("fp"), "component")
    classes = fps.join(moved, "fp", "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    # fingerprints of many rows are few, so their classes are broadcast; the others are joined by shuffle
    rows = prints.count()
    crowded = F.col("n") > max(CROWDED, rows // CROWDED)
    often = saved(fps.filter(crowded).select("fp"))
    hot = prints.join(F.broadcast(classes.join(often, "fp", "left_semi")), "fp")
    rest = prints.join(F.broadcast(often), "fp", "left_anti").join(classes.join(F.broadcast(often), "fp", "left_anti"), "fp")
    return hot.unionByName(rest).select("id", "fp", "component_id")


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each near-duplicate group: that of the smallest (id, fingerprint), null ids last."""
    marked = saved(near_duplicates(docs, id_col, text_col))
    # groups without an id have none to share, so each of their fingerprints stands for itself
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), F.col("fp").cast("string")))
    kept = saved(
        marked.groupBy(group.alias("g"))
        .agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp")).alias("k"))
        .select(F.col("k.id").alias("__id"), F.col("k.fp").alias("__fp"))
    )
    several = marked.groupBy("id", "fp").count().filter("count > 1").select(F.col("id").alias("__id"), F.col("fp").alias("__fp"))
    repeated = bool(several.join(kept, several["__id"].eqNullSafe(kept["__id"]) & (several["__fp"] == kept["__fp"]), "left_semi").take(1))
    clashing = marked.groupBy("id").agg(F.countDistinct("fp").alias("n")).filter("n > 1 or id is null").take(1)
    if not repeated and not clashing:
        return docs.join(kept, docs[id_col] == kept["__id"], "left_semi")
    out = docs.withColumn("__of", fingerprint_column(F.col(text_col)))
    out = out.join(kept, out[id_col].eqNullSafe(kept["__id"]) & (out["__of"] == kept["__fp"]), "left_semi")
    return out.dropDuplicates([id_col, "__of"]).drop("__of")
