"""Secret scan with multipart credential linking.

Base spans are found by three patterns. Weak parts - identifiers, secret-like values and
endpoints that alone prove nothing - are joined by interval within a scope of SCOPE code
points: a weak secret counts beside an identifier or an endpoint, and an identifier or an
endpoint beside a secret, base or weak. All of it is built-in functions over the row's
own text, so there is no shuffle and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCOPE = 120
#: Fixed patterns of base spans, by kind in report order; the assignment counts if its value has 6 characters or more.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Patterns of weak parts.
WEAK_ID = r"""(?i:user(?:name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""
WEAK_SECRET = (
    r"""(?i:\bpass|\bpwd|private_?key|credentials?|\bauth)["']?\x20*[:=]\x20*["']?[^\x20\x09-\x0D"']{6,}"""
    r"""|(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*[0-9])(?=[a-z0-9+/]*[A-Z])[A-Za-z0-9+/]{32,}={0,2}"""
)
ENDPOINT = r"""[A-Za-z][A-Za-z0-9+]{1,20}://[^\x20\x09-\x0D"'<>]+"""
KINDS = ("assign", "access", "hex", "linked_id", "linked_secret", "linked_endpoint")
_RUN = 128


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0), lambda a, x: a + x)


def _spans(rows: DataFrame, out: str, pattern: str, possible: Column, group: int | None = None, least: int = 0) -> DataFrame:
    """rows with a column `out`: array of (s, e), the leftmost non-overlapping matches in column text, in code points.

    Places follow from the lengths of matches and of what lies between them, by prefix
    sums in runs, so that the work stays near linear in the number of matches.
    possible: a cheap test that holds wherever the pattern matches.
    """
    text, none = F.col("text"), F.array().cast("array<int>")
    found = F.when(possible, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    rows = rows.withColumn("__m", F.coalesce(F.transform(found, lambda x: F.length(x)), none))
    some = F.size("__m") > 0
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    rows = rows.withColumn("__g", F.when(some, gaps).otherwise(none))
    rows = rows.withColumn("__step", F.when(some, F.zip_with("__g", F.slice(F.concat(F.array(F.lit(0)), "__m"), 1, F.size("__g")), lambda g, m: g + m)).otherwise(none))
    runs = F.sequence(F.lit(0), F.floor((F.size("__m") - 1) / _RUN).cast("int"))
    rows = rows.withColumn("__run", F.when(some, F.transform(runs, lambda b: _sum(F.slice(F.col("__step"), b * _RUN + 1, F.lit(_RUN))))).otherwise(none))
    rows = rows.withColumn("__base", F.when(some, F.transform(runs, lambda b: _sum(F.slice(F.col("__run"), F.lit(1), b)))).otherwise(none))

    def span(m, i):
        run = F.floor(i / _RUN).cast("int")
        start = F.col("__base")[run] + _sum(F.slice(F.col("__step"), run * _RUN + 1, i - run * _RUN + 1))
        return F.struct(start.alias("s"), (start + m).alias("e"))

    spans = F.transform("__m", span)
    if group is not None:
        size = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.length(x))
        rows = rows.withColumn("__v", F.when(some, size).otherwise(none))
        kept = F.filter(spans, lambda x, i: F.col("__v")[i] >= least)
    else:
        kept = spans
    rows = rows.withColumn(out, F.when(some, kept).otherwise(F.array().cast("array<struct<s:int,e:int>>")))
    return rows.drop("__m", "__g", "__step", "__run", "__base", "__v")


def _near(spans: Column, others: list[str]) -> Column:
    """Those of spans that lie within SCOPE of a span of one of the other columns."""

    def close(x):
        tests = [F.exists(F.col(o), lambda y: (y["s"] <= x["e"] + SCOPE) & (x["s"] <= y["e"] + SCOPE)) for o in others]
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return out

    return F.filter(spans, close)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, assign, access, hex, linked_id, linked_secret, linked_endpoint) for each row: arrays of (s, e).

    Places are code points, ends exclusive. Weak parts that overlap a base span aren't
    reported again. Null text is as empty: no spans. Other columns aren't read; rows stay,
    repeated ones too.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    rows = _spans(rows, "assign", ASSIGN, text.rlike("[:=]"), 1, 6)
    rows = _spans(rows, "access", ACCESS, text.contains("AKIA"))
    rows = _spans(rows, "hex", HEX, F.lit(True))
    rows = _spans(rows, "weak_id", WEAK_ID, text.rlike("[:=]"))
    rows = _spans(rows, "weak_secret", WEAK_SECRET, F.lit(True))
    rows = _spans(rows, "endpoint", ENDPOINT, text.contains("://")).drop("text")
    base = ["assign", "access", "hex"]
    for weak in ("weak_id", "weak_secret", "endpoint"):
        apart = F.filter(weak, lambda x: ~(
            F.exists("assign", lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])) | F.exists("access", lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))
            | F.exists("hex", lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))
        ))
        rows = rows.withColumn(weak, F.when(F.size(weak) > 0, apart).otherwise(F.col(weak)))
    linked = {
        "linked_id": _near(F.col("weak_id"), ["assign", "hex", "weak_secret"]),
        "linked_secret": _near(F.col("weak_secret"), ["access", "weak_id", "endpoint"]),
        "linked_endpoint": _near(F.col("endpoint"), ["assign", "hex", "weak_secret"]),
    }
    return rows.select("id", *base, *(c.alias(k) for k, c in linked.items()))


def listing(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the spans of some kinds, by start, then kind in report order, joined by commas."""

    def tag(kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e")))

    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(F.concat(*map(tag, kinds))), lambda x: F.concat_ws(":", names[x["k"]], x["s"], x["e"])), ",")
