"""Line dedup by a segment-partition edit join.

A line is a copy if an earlier line (by document id, then place) lies within its edit
bound; earlier is judged on the input. The bound follows from the shorter line of a pair:
CLASSES gives the edits allowed from a length on, and lines shorter than all of these match
when equal. Two different lines within t edits share one of the t + 1 segments of the
shorter one: each line is indexed by its segments (length, number, content), and probes,
for each length up to t less than its own, the substrings that the multi-match-aware
windows leave.

The keys of all lines are shuffled once, as bare numbers; only lines that share a key with
another line go on with their text, each once. Where many of them share a segment, as
families of near copies do, they meet again under longer keys, all of the line but t
segments of a finer partition. Candidates are verified by a banded bit-parallel edit
distance: the band of 2t + 1 rows around the diagonal is one word, and a character of the
other line is a few shifts, sums and logical operations. Built-in functions alone.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: (edits, least, most): edits allowed where the shorter line has so many code points.
CLASSES = ((2, 16, (1 << 31) - 1), (1, 8, 15))
HOT = 8  # lines beyond which a key is crowded
BROADCAST_KEYS = 1_000_000  # shared keys up to which these are broadcast, 8 bytes each
BROADCAST_TEXT = 4_000_000  # characters of lines with crowded keys up to which these are broadcast
SPACE = " \t\n\x0b\f\r"


def _key(size: Column, damaged: list[Column], moves: list[Column], parts: Column) -> Column:
    """Hash of a shorter line's size, its damaged segments (from 0) of so many parts, and the characters of all others.

    Segment i starts at floor(size * i / parts). moves: by how much each damaged segment is
    longer in the line at hand, so that what follows lies further right.
    """

    def bound(i: Column) -> Column:
        return F.floor(size * i / parts).cast("int")

    pieces, at, shift = [], F.lit(0), F.lit(0)
    for d, move in zip([*damaged, parts], [*moves, F.lit(0)]):
        pieces.append(F.substring("wide", (bound(at) + shift) * 4 + 1, (bound(d) - bound(at)) * 4))
        at, shift = d + 1, shift + move
    return F.xxhash64(parts, size, *damaged, *pieces)


def _runs(damaged: tuple[int, ...]) -> list[int]:
    """For each damaged segment the length of its run if it ends the run, else 0."""
    runs, n = [], 0
    for d, after in zip(damaged, (*damaged[1:], -1)):
        n += 1
        runs.append(0 if after == d + 1 else n)
        n = 0 if runs[-1] else n
    return runs


def _ways(parts: int, edits: int, probing: bool) -> list[tuple[list[int], list[int]]]:
    """(damaged segments, moves) of so many parts.

    A line within `edits` edits damages at most as many segments. Sets of exactly so many
    are enough, in which a run of r neighbours moves what follows by r at most, as a segment
    with several edits counts its neighbours as damaged too. An index needs no moves. Of
    moves and their opposites, as lines of one size have them, one is left to the other line.
    """
    ways = []
    for damaged in combinations(range(parts), edits):
        for moves in product(*(range(-r, r + 1) if probing else (0,) for r in _runs(damaged))):
            if 0 < sum(moves) <= edits or sum(moves) == 0 and moves >= tuple(-m for m in moves):
                ways.append((list(damaged), list(moves)))
    return ways


def _first_keys(rows: DataFrame, classes: tuple, probing: bool) -> DataFrame:
    """rows (with wide, size) for each way of edits + 1 parts, with key, short (size of the shorter line), damaged, less and both.

    A way is a row of numbers, so that one expression, small enough for the JVM to compile,
    makes all keys. Ways with fewer edits than others are filled up with an empty segment.
    """
    top, table = max(c[0] for c in classes), []
    for edits, least, most in classes:
        for damaged, moves in _ways(edits + 1, edits, probing):
            fill = [0] * (top - edits)
            table.append([least, most, edits + 1, sum(moves), int(any(moves)), *damaged, *(edits + 1 for _ in fill), *moves, *fill])
    way = lambda i: F.col("__way")[i]
    out = rows.withColumn("__way", F.explode(F.lit(table))).withColumn("short", F.col("size") - way(3)).filter(F.col("short").between(way(0), way(1)))
    damaged, moves = [way(5 + k) for k in range(top)], [way(5 + top + k) for k in range(top)]
    out = out.withColumns({"key": _key(F.col("short"), damaged, moves, way(2)), "damaged": F.array(*damaged), "less": way(3), "both": way(4) > 0})
    return out.drop("__way")


def _narrowed(states: DataFrame, rows: DataFrame, shared: int) -> DataFrame:
    """Live states one level below states (g, move, c, t, role, id, start, size, short, head, tail), with key and the number n of its stretches.

    c names a stretch of `size` characters from `start` of line id, t is a hash of it. Stretches
    of one g have `short` characters or more; in a state they begin with `head` and end with
    `tail` equal ones, the rest is open. All edits of a pair lie in one half of what
    is open (the first with the next `shared` characters too); whatever is outside of it is equal.
    """
    open_ = F.col("short") - F.col("head") - F.col("tail")
    bound = lambda k: F.floor(open_ * k / 2).cast("int")
    ends = [F.struct((F.col("head") + bound(k)).alias("head"), (F.col("tail") + open_ - F.least(bound(k + 1) + shared, open_)).alias("tail"), (bound(k + 1) > bound(k)).alias("some")) for k in range(2)]
    same = ["g", "move", "c", "t", "role", "id", "start", "size", "short"]
    deeper = _with_text(states, rows).withColumn("__ends", F.explode(F.filter(F.array(*ends), lambda e: e["some"]))).select(*same, "wide", "__ends.head", "__ends.tail")
    begin = F.substring("wide", F.col("start") * 4 + 1, F.col("head") * 4)
    end = F.substring("wide", (F.col("start") + F.col("size") - F.col("tail")) * 4 + 1, F.col("tail") * 4)
    deeper = deeper.withColumn("key", F.xxhash64("g", "head", "tail", begin, end)).drop("wide").persist()
    live = _live(deeper)
    deeper.unpersist()
    return live


def _with_text(entries: DataFrame, rows: DataFrame) -> DataFrame:
    """entries with the text of their line id, as wide."""
    return entries.join(rows.select("id", "line"), "id").withColumn("wide", F.encode("line", "UTF-32")).drop("line")


def _live(states: DataFrame) -> DataFrame:
    """Those of states under whose key a different stretch may be linked, with their number n: one of role 0 with any, or, of move 1, with one of role 1."""
    of_key = states.groupBy("key").agg(F.count("*").alias("n"), *(f(c).alias(f"__{f.__name__}_{c}") for c in ("t", "role") for f in (F.min, F.max)), F.max("move").alias("__move"))
    live = saved(of_key.filter("__min_t < __max_t and __min_role = 0 and __max_role >= __move").select("key", "n"))
    return saved(states.join(F.broadcast(live) if live.count() <= BROADCAST_KEYS else live, "key"))


def _meeting(states: DataFrame) -> DataFrame:
    """(g, a, b): names of different stretches that share a key, a of role 0, b of any, or, of move 1, of role 1. Repeats are possible."""
    a = states.filter("role = 0").select("key", "g", F.col("c").alias("a"))
    b = states.filter("role >= move").select("key", F.col("c").alias("b"))
    return a.join(b, "key").filter("a != b").select("g", "a", "b")


def _one_edit(states: DataFrame, rows: DataFrame) -> DataFrame:
    """(g, a, b): as _meeting, of all stretches that lie within an edit and agree in head and tail, and few others that differ in two neighbouring characters.

    What is open is halved, and only where another stretch agrees in all the rest.
    """
    states, found = _live(states), []
    open_ = F.col("short") - F.col("head") - F.col("tail")
    while True:
        found.append(_meeting(states.filter(open_ <= 1)))
        states = states.filter(open_ > 1)
        if states.isEmpty():
            return saved(reduce(DataFrame.unionByName, found).distinct())
        states = _narrowed(states.drop("key", "n"), rows, 0)


def _stretches(tasks: DataFrame, rows: DataFrame, before: bool) -> DataFrame:
    """tasks with the stretches of what is open before the cut or after it, as _one_edit takes them.

    A line of move 1 and role 1 is cut one character later. Where only the character between
    the two cuts is an edit, both edits lie in one of _crowd's halves; so the characters that
    end, or begin, the stretches of move 1 have to agree.
    """
    at = F.col("head") + F.col("cut") + F.col("role") * F.col("move")
    start, stop = (F.col("head"), at) if before else (at, F.col("size") - F.col("tail"))
    short = F.col("cut") if before else F.col("short") - F.col("head") - F.col("tail") - F.col("cut") - F.col("move")
    out = tasks.select("g", "move", "id", "role", start.alias("start"), (stop - start).alias("size"), short.alias("short"))
    out = _with_text(out, rows)
    text = F.substring("wide", F.col("start") * 4 + 1, F.col("size") * 4)
    beside = F.substring("wide", (F.col("start") + (F.col("size") - 1 if before else F.lit(0))) * 4 + 1, F.col("move") * 4)
    out = out.withColumns({"t": F.xxhash64("g", text), "key": F.xxhash64("g", beside), "c": F.concat_ws(":", F.xxhash64("g", text), F.xxhash64(F.lit(7), text))}).drop("wide")
    return out.withColumns({"head": F.lit(0) if before else F.col("move"), "tail": F.col("move") if before else F.lit(0)})


def _one_each(tasks: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b): ids of lines of one g with an edit before the cut and one after it.

    tasks: (g, id, role, size, short, head, tail, cut). The longer line's cut may lie one
    character later (move 1), and so may that of one of two lines of a size. Stretches before
    the cut are linked first, and only their lines go on.
    """
    kinds = F.when(F.col("size") - F.col("short") < 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    tasks = tasks.withColumn("move", F.explode(kinds)).withColumn("g", F.xxhash64("g", "move"))
    tasks = tasks.withColumn("role", F.explode(F.when((F.col("move") == 1) & (F.col("role") == 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array("role"))))
    sides = []
    for before in (True, False):
        named = saved(_stretches(tasks, rows, before))
        # of equal stretches one is enough: of role 0 if there is one, and in move 1 one of each role
        one = named.groupBy("g", "move", "c", "t", (F.col("role") * F.col("move")).alias("__kind")).agg(F.min(F.struct("role", "id", "start", "size", "short", "head", "tail", "key")).alias("__one"))
        links = _one_edit(one.select("g", "move", "c", "t", "__one.*"), rows)
        name = "x" if before else "y"
        ends = [named.filter(who).select("g", "id", F.col("c").alias(name)).join(links.select("g", F.col(end).alias(name)).distinct(), ["g", name]) for who, end in (("role = 0", "a"), ("role >= move", "b"))]
        sides.append((*(saved(e) for e in ends), links))
        linked = sides[0][0].unionByName(sides[0][1]).select("g", "id").distinct()
        tasks = tasks.join(linked, ["g", "id"], "left_semi")
    (a_before, b_before, links_before), (a_after, b_after, links_after) = sides
    # a's links before the cut and b's after it meet where the one's stretches are the other's
    a = a_before.join(a_after, ["g", "id"]).join(links_before.withColumnRenamed("a", "x"), ["g", "x"]).select("g", F.col("b").alias("x"), "y", F.col("id").alias("a"))
    b = b_before.join(b_after, ["g", "id"]).join(links_after.withColumnRenamed("b", "y"), ["g", "y"]).select("g", "x", F.col("a").alias("y"), F.col("id").alias("b"))
    return a.join(b, ["g", "x", "y"]).filter("a != b").select("a", "b")


def _crowd(met: DataFrame, rows: DataFrame, edits: int, hot: int) -> DataFrame:
    """(a, b): ids among met (id, short: the size of a pair's shorter line), with all pairs within 1 or 2 edits; both directions and repeats are possible.

    Two edits lie in one half of what is open, so that the other half is equal, or there is
    one in each. Halves that agree for up to `hot` lines are joined, others halved again.
    """
    zero = {c: F.lit(0) for c in ("move", "start", "head", "tail")}
    states = met.join(rows.select("id", "size"), "id").withColumns({"c": F.col("id"), "t": F.xxhash64("id"), **zero})
    states = states.withColumns({"g": F.xxhash64("short"), "key": F.xxhash64("short"), "role": (F.col("size") > F.col("short")).cast("int")})
    if edits == 1:
        return _one_edit(states, rows).select("a", "b")
    states, found, tasks = _live(states), [], []
    open_ = F.col("short") - F.col("head") - F.col("tail")
    while True:
        crowded = (F.col("n") > hot) & (open_ > 3)
        found.append(_meeting(states.filter(~crowded)).select("a", "b"))
        states = states.filter(crowded)
        if states.isEmpty():
            break
        tasks.append(states.select(F.col("key").alias("g"), "id", "role", "size", "short", "head", "tail", F.floor(open_ / 2).cast("int").alias("cut")))
        states = _narrowed(states.drop("key", "n"), rows, 1)
    return reduce(DataFrame.unionByName, found + [_one_each(reduce(DataFrame.unionByName, tasks), rows)] * bool(tasks))


def _candidates(rows: DataFrame, edits: int, least: int, most: int, hot: int) -> DataFrame:
    """(a, b): ids of lines that share a key, repeats included.

    A key that more than `hot` lines are indexed under is not joined: its lines meet in _crowd.
    Of lines of one size and no moves, only the one of smaller id needs to probe.
    """
    lines, rows = rows.select("id", "line", "size"), rows.select("id", "wide", "size")
    index, probes = (_first_keys(rows, ((edits, least, most),), probing).drop("wide", "size") for probing in (False, True))
    crowded = saved(index.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("key"))
    p = probes.select("key", F.col("id").alias("a"), "both").alias("p")
    i = index.join(crowded, "key", "left_anti").select("key", F.col("id").alias("b")).alias("i")
    pairs = p.join(i, (F.col("p.key") == F.col("i.key")) & (F.col("a") != F.col("b")) & (F.col("both") | (F.col("a") < F.col("b"))))
    if not crowded.isEmpty():
        met = saved(probes.join(crowded, "key", "left_semi").select("id", "short").distinct())  # a line probes what it is indexed under
        # numbers for names, and texts as they are, keep what is shuffled small
        some = saved(lines.join(met, "id", "left_semi").withColumn("number", F.monotonically_increasing_id()))
        names = some.select("id", "number")
        met = met.join(names, "id").select(F.col("number").alias("id"), "short")
        texts = some.select(F.col("number").alias("id"), "line", "size")
        if (some.agg(F.sum("size")).first()[0] or 0) <= BROADCAST_TEXT:
            texts = F.broadcast(texts)
        crowd = _crowd(met, texts, edits, hot)
        for end in ("a", "b"):
            crowd = crowd.join(names.select(F.col("id").alias("__name"), F.col("number").alias(end)), end).drop(end).withColumnRenamed("__name", end)
        pairs = pairs.select("a", "b").unionByName(crowd)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def bounded_distance(a: str, b: str, edits: int) -> Column:
    """The edit distance of two arrays of characters, of `edits` or more, the first of __size_a; above `edits` it may be any larger number.

    Their sizes differ by `edits` at most.

    Bit k of a word is row j - edits + k of the distance table's column j. Until the last row comes into the
    band its lowest row is followed down the diagonal, then the last row to the right.
    """
    width, full = 2 * edits + 1, (1 << (2 * edits + 1)) - 1
    start = F.struct(F.lit(1).alias("j"), F.lit(((1 << (edits + 1)) - 1) << edits).alias("vp"), F.lit(0).alias("vn"), F.lit(edits).alias("d"))

    def bit(test: Column, k: int) -> Column:
        return F.when(test, F.lit(1 << k)).otherwise(F.lit(0))

    def column(s: Column, c: Column) -> Column:
        equal = [bit(F.get(F.col(a), s["j"] - edits + (k - 1)) == c, k) for k in range(width)]
        x = equal[0]
        for e in equal[1:]:
            x = x.bitwiseOR(e)
        return F.struct(s["j"].alias("j"), s["vp"].alias("vp"), s["vn"].alias("vn"), s["d"].alias("d"), x.alias("x"))

    def zeros(s: Column) -> Column:  # d0: where the diagonal step costs nothing
        d0 = (s["x"].bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"]).bitwiseOR(s["x"]).bitwiseOR(s["vn"]).bitwiseAND(F.lit(full))
        return F.struct(s["j"].alias("j"), s["vp"].alias("vp"), s["vn"].alias("vn"), s["d"].alias("d"), d0.alias("d0"))

    def flat(s: Column) -> Column:  # hp, hn: where a step to the right costs one more, or one less
        hp = s["vn"].bitwiseOR(F.lit(full).bitwiseXOR(s["d0"].bitwiseOR(s["vp"])))
        return F.struct(s["j"].alias("j"), s["d"].alias("d"), s["d0"].alias("d0"), hp.alias("hp"), s["d0"].bitwiseAND(s["vp"]).alias("hn"))

    def after(s: Column) -> Column:
        below = F.col("__size_a") - s["j"] + edits  # the bit of the last row
        slope = F.when(below >= width - 1, F.when(s["d0"].bitwiseAND(F.lit(1 << (width - 1))) == 0, 1).otherwise(0)).otherwise(
            F.getbit(s["hp"], below).cast("int") - F.getbit(s["hn"], below).cast("int")
        )
        down = F.shiftright(s["d0"], 1)
        return F.struct((s["j"] + 1).alias("j"), s["hn"].bitwiseOR(F.lit(full).bitwiseXOR(down.bitwiseOR(s["hp"]))).alias("vp"), down.bitwiseAND(s["hp"]).alias("vn"), (s["d"] + slope).alias("d"))

    # a step's values are used several times by the next; a one-element array names them
    def then(values: Column, f) -> Column:
        return F.transform(F.array(values), f)[0]

    step = lambda s, c: then(then(then(column(s, c), zeros), flat), after)
    return F.aggregate(b, start, step, lambda s: s["d"])


def verified(pairs: DataFrame, rows: DataFrame, edits: int) -> DataFrame:
    """Those of pairs (a, b) whose lines in rows (id, line, wide, size) lie within `edits` edits.

    What both lines begin and end with, found by halving steps, plays no part in their
    distance; it is cut off, but for as many characters as the band needs.
    """
    one = rows.select(F.col("id").alias("a"), F.col("line").alias("__la"), F.col("wide").alias("__wa"), F.col("size").alias("__na"))
    two = rows.select(F.col("id").alias("b"), F.col("line").alias("__lb"), F.col("wide").alias("__wb"), F.col("size").alias("__nb"))
    met = pairs.join(one, "a").join(two, "b").filter(F.abs(F.col("__na") - F.col("__nb")) <= edits)
    steps = F.lit([1 << k for k in range(12, -1, -1)])
    met = met.withColumn("__most", F.least("__na", "__nb") - edits)
    met = met.withColumn("__begin", F.aggregate(steps, F.lit(0), lambda p, s: p + F.when(
        (p + s <= F.col("__most")) & (F.substring("__wa", 4 * p + 1, 4 * s) == F.substring("__wb", 4 * p + 1, 4 * s)), s
    ).otherwise(F.lit(0))))
    met = met.withColumn("__end", F.aggregate(steps, F.lit(0), lambda p, s: p + F.when(
        (p + s <= F.col("__most") - F.col("__begin"))
        & (F.substring("__wa", 4 * (F.col("__na") - p - s) + 1, 4 * s) == F.substring("__wb", 4 * (F.col("__nb") - p - s) + 1, 4 * s)), s
    ).otherwise(F.lit(0))))
    rest = lambda n: F.col(n) - F.col("__begin") - F.col("__end")
    part = lambda line, n: F.split(F.substring(line, F.col("__begin") + 1, rest(n)), "")
    met = met.select("a", "b", part("__la", "__na").alias("__a"), part("__lb", "__nb").alias("__b"), rest("__na").alias("__size_a"))
    # saved, as a filter would be moved below the columns above and make them anew for each character
    return saved(met.select("a", "b", bounded_distance("__a", "__b", edits).alias("d"))).filter(F.col("d") <= edits).select("a", "b")


def _named(lines: DataFrame) -> DataFrame:
    """lines with h1 and h2, 128 bits that stand for the line."""
    return lines.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(7), "line")})


def line_links(lines: DataFrame, hot: int = HOT, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(h1, h2, o1, o2): each pair of different lines (column line, repeats allowed) within their bound, in both directions."""
    # four bytes a character, as a place in UTF-8 is found from the beginning only
    wide = F.encode("line", "UTF-32").alias("wide")
    sized = lines.select("line", F.length("line").alias("size")).filter(F.col("size") >= min(c[1] for c in CLASSES)).select("line", "size", wide)
    # keys that two different lines have; a line that is repeated is summed up before the shuffle
    bare = _first_keys(sized.select(F.xxhash64("line").alias("h1"), "size", "wide"), CLASSES, True).select("h1", "key")
    shared = saved(bare.groupBy("key").agg(F.min("h1").alias("least"), F.max("h1").alias("most")).filter("least != most").select("key"))
    if shared.count() <= broadcast_keys:
        rows = _first_keys(sized, CLASSES, True).select("line", "key").join(F.broadcast(shared), "key", "left_semi").select("line").distinct()
    else:  # names find their keys first, so that texts are shuffled without them
        names = _first_keys(_named(sized).drop("line"), CLASSES, True).select("h1", "h2", "key").join(shared, "key", "left_semi").select("h1", "h2").distinct()
        rows = _named(sized.select("line")).join(names, ["h1", "h2"], "left_semi").select("line").distinct()
    rows = saved(_named(rows).select("line", F.length("line").alias("size"), wide, F.concat_ws(":", "h1", "h2").alias("id")))
    links = None
    for edits, least, most in CLASSES:
        pairs = saved(_candidates(rows, edits, least, most, hot).distinct())
        found = verified(pairs, rows, edits)
        links = found if links is None else links.unionByName(found)
    links = saved(links.distinct())
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    half = lambda c, i: F.split_part(c, F.lit(":"), F.lit(i)).cast("long")
    return ends.select(half(F.col("a"), 1).alias("h1"), half(F.col("a"), 2).alias("h2"), half(F.col("b"), 1).alias("o1"), half(F.col("b"), 2).alias("o2"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """docs with n_lines, n_removed, n_links and kept_text in place of columns of those names.

    Lines are separated by \\n. n_lines counts lines with a character other than white
    space; others stay and are no copies. n_links: for each of the lines, how many
    different lines within their bound the table has. Null text is as empty. Ids are
    integers; other types are refused. Rows of one id follow each other by a hash of their
    text; rows that agree in id and text are judged as one row, and each gets its result.
    Null ids come before all others.
    """
    kind = dict(docs.dtypes)[id_col]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} is {kind}; line order needs an integer id")
    rows = docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit(""))).withColumn("__mark", F.xxhash64("__text"))
    number = lambda c: c.cast("decimal(38,0)")
    first = F.coalesce(number(F.col(id_col)), F.lit("-9223372036854775809").cast("decimal(38,0)"))
    turn = number(F.col("__mark").bitwiseAND(F.lit((1 << 30) - 1)))
    at = number(number(first * F.lit(1 << 30).cast("decimal(10,0)") + turn) * F.lit(1 << 31).cast("decimal(10,0)"))
    lines = (
        rows.select(F.col(id_col).alias("id"), F.col("__mark").alias("mark"), at.alias("at"), F.posexplode(F.split("__text", "\n")).alias("place", "line"))
        .filter(F.length(F.btrim("line", F.lit(SPACE))) > 0)
        .withColumn("at", number(F.col("at") + F.col("place")))
    )
    links = line_links(lines, hot, broadcast_keys)
    lines = _named(lines).select("id", "mark", "place", "at", "h1", "h2")
    firsts = lines.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count("*").alias("n"))  # without texts
    other = links.join(firsts.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("first").alias("other_first")), ["o1", "o2"])
    linked = other.groupBy("h1", "h2").agg(F.min("other_first").alias("nearest"), F.count("*").alias("links"))
    known = firsts.join(linked, ["h1", "h2"], "left").filter("n > 1 or links is not null").drop("n")
    seen = lines.join(known, ["h1", "h2"])
    copy = (F.col("at") > F.col("first")) | (F.coalesce(F.col("nearest"), F.col("first")) < F.col("first"))
    own = seen.groupBy("id", "mark").agg(
        F.collect_set(F.when(copy, F.col("place"))).alias("__copies"),
        F.collect_set(F.when(F.col("links").isNotNull(), F.struct("place", "links"))).alias("__linked"),
    )
    own = own.select(F.col("id").alias("__id"), F.col("mark").alias("__own"), "__copies", F.aggregate("__linked", F.lit(0).cast("long"), lambda a, x: a + x["links"]).alias("__links"))
    out = rows.join(own, rows[id_col].eqNullSafe(own["__id"]) & (rows["__mark"] == own["__own"]), "left")
    out = out.withColumns({"__lines": F.split("__text", "\n"), "__copies": F.coalesce("__copies", F.array().cast("array<int>"))})
    places = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__copies"))
    kept = F.array_join(F.transform(places, lambda i: F.get("__lines", i)), "\n")
    return out.withColumns({
        "n_lines": F.size(F.filter("__lines", lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)).cast("long"),
        "n_removed": F.size("__copies").cast("long"), "n_links": F.coalesce("__links", F.lit(0)).cast("long"),
        "kept_text": F.when(F.size("__copies") == 0, F.col("__text")).otherwise(kept),
    }).drop("__text", "__mark", "__id", "__own", "__copies", "__links", "__lines")
