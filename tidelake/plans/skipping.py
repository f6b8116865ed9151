"""Data skipping: a predicate compiled over statistics of files.

may_match() is false only where no row of a file can satisfy the predicate; unknown
statistics keep the file. Negation is pushed to the leaves first. Spark's order has NaN
above all numbers, and statistics gathered here have it so, too; bounds from elsewhere
leave NaN out, so lower bounds alone decide > and >= for floating columns only if the
statistics are our own.
"""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import expressions as E

_ORDERED = (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)
_MIRROR = {"=": "=", "<>": "<>", "<": ">", "<=": ">=", ">": "<", ">=": "<=", "<=>": "<=>"}
_INVERSE = {"=": "<>", "<>": "=", "<": ">=", "<=": ">", ">": "<=", ">=": "<"}


def ordered_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, _ORDERED)]


def file_statistics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(file, num_records, stats: struct of min, max, nulls by column) of a DataFrame over files; one pass with map-side aggregation."""
    columns = ordered_columns(df.schema) if columns is None else columns
    aggs: list[Column] = [F.count("*").alias("num_records")]
    for i, c in enumerate(columns):
        q = E.quoted(c)
        aggs += [F.min(q).alias(f"min{i}"), F.max(q).alias(f"max{i}"), F.count_if(F.col(q).isNull()).alias(f"nulls{i}")]
    out = df.select("*", F.col("_metadata.file_path").alias("__file")).groupBy("__file").agg(*aggs)
    stats = [F.struct(F.col(f"min{i}").alias("min"), F.col(f"max{i}").alias("max"), F.col(f"nulls{i}").alias("nulls")).alias(c) for i, c in enumerate(columns)]
    return out.select(F.col("__file").alias("file"), "num_records", (F.struct(*stats) if stats else F.struct(F.lit(1).alias("none"))).alias("stats"))


def normalise(p: E.Predicate, negate: bool = False) -> E.Predicate:
    """An equivalent tree, as far as true rows go, with negation only in the leaves' own operators; None-able parts become true."""
    if isinstance(p, E.Constant):
        return E.Constant(p.value != negate)
    if isinstance(p, E.Negation):
        return normalise(p.part, not negate)
    if isinstance(p, E.Junction):
        op = p.op if not negate else {"and": "or", "or": "and"}[p.op]
        return E._join(op, tuple(normalise(x, negate) for x in p.parts))
    if not negate:
        return p
    if isinstance(p, E.Compare):
        return E.Compare(_INVERSE[p.op], p.left, p.right) if p.op in _INVERSE else E.TRUE
    if isinstance(p, E.Member):
        return E.Member(p.arg, p.values, not p.negated)
    if isinstance(p, E.Prefix):
        return E.Prefix(p.arg, p.prefix, not p.negated)
    if isinstance(p, E.Test):
        return E.Test({"is_null": "not_null", "not_null": "is_null", "is_nan": "not_nan", "not_nan": "is_nan"}[p.op], p.arg) if p.op in ("is_null", "not_null") else E.TRUE
    return E.TRUE


def may_match(p: E.Predicate, schema: T.StructType, stats: str = "stats", records: str = "num_records") -> Column:
    """A column over file statistics: false where no row can satisfy p. NULL never: unknown is true."""
    return F.coalesce(_may(normalise(p), schema, stats, records), F.lit(True))


def _may(p: E.Predicate, schema, stats, records) -> Column:
    unknown = F.lit(None).cast("boolean")
    if isinstance(p, E.Constant):
        return F.lit(p.value)
    if isinstance(p, E.Junction):
        out = None
        for x in p.parts:
            c = F.coalesce(_may(x, schema, stats, records), F.lit(True))
            out = c if out is None else (out & c if p.op == "and" else out | c)
        return out

    def side(name: str) -> tuple[Column, Column, Column, T.DataType] | None:
        if name not in ordered_columns(schema):
            return None
        s = F.col(f"{stats}.{E.quoted(name)}")
        return s["min"], s["max"], s["nulls"], schema[name].dataType

    def bounded(name: str, op: str, v: Any) -> Column:
        found = side(name)
        if found is None:
            return unknown
        low, high, nulls, kind = found
        some = F.coalesce(nulls < F.col(records), F.lit(True))
        if v is None:
            return nulls > 0 if op == "<=>" else F.lit(False)
        if not E.comparable(E._kind_of_type(kind), E.kind_of_value(v)):
            return F.lit(False)
        if isinstance(v, float) and math.isnan(v):
            return unknown
        x = F.lit(v)
        test = {
            "=": lambda: (low <= x) & (high >= x), "<=>": lambda: (low <= x) & (high >= x), "<": lambda: low < x, "<=": lambda: low <= x,
            ">": lambda: high > x, ">=": lambda: high >= x, "<>": lambda: ~((low == x) & (high == x)),
        }[op]()
        return some & F.coalesce(test, F.lit(True))

    if isinstance(p, E.Compare):
        a, b, op = p.left, p.right, p.op
        if isinstance(a, E.Lit) and isinstance(b, E.Lit):
            return E.to_column(p)
        if isinstance(a, E.Lit):
            a, b, op = b, a, _MIRROR[op]
        return bounded(a.name, op, b.value) if isinstance(a, E.Ref) and isinstance(b, E.Lit) else unknown
    if not isinstance(getattr(p, "arg", None), E.Ref) or side(p.arg.name) is None:
        return unknown
    low, high, nulls, kind = side(p.arg.name)
    if isinstance(p, E.Test):
        return {"is_null": nulls > 0, "not_null": nulls < F.col(records)}.get(p.op, unknown)
    if isinstance(p, E.Member):
        if p.negated:
            if None in p.values:
                return F.lit(False)
            one = [bounded(p.arg.name, "<>", v) for v in p.values]
            return _all(one) if one else nulls < F.col(records)
        one = [bounded(p.arg.name, "=", v) for v in p.values if v is not None]
        return _any(one) if one else F.lit(False)
    if isinstance(p, E.Prefix) and isinstance(kind, T.StringType):
        n = F.lit(len(p.prefix))
        if p.negated:
            return ~(low.startswith(p.prefix) & high.startswith(p.prefix))
        return (F.substring(high, F.lit(1), n) >= p.prefix) & (F.substring(low, F.lit(1), n) <= p.prefix)
    return unknown


def _any(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out | c
    return out


def _all(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out & F.coalesce(c, F.lit(True))
    return out


def pruned_scan(df_of, files: DataFrame, predicate: E.Predicate, schema: T.StructType) -> tuple[DataFrame | None, int, int]:
    """(rows of the files that may match, filtered exactly; files read; files in all). df_of(paths) reads files."""
    total = files.count()
    keep = [r["file"] for r in files.filter(may_match(predicate, schema)).select("file").collect()]  # file names, not rows
    return (E.where(df_of(keep), predicate) if keep else None), len(keep), total
