"""Predicate and expression trees that compile to Spark columns.

One tree has two compilations: to_column() is the exact row filter with SQL's
three-valued logic; plans.skipping compiles the same tree over file statistics.
Incompatible kinds compare to NULL, not to an error.
"""

from __future__ import annotations

import datetime as dt
import decimal
import functools
import operator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Expression:
    """A node; ==, <, and so on stay Python's own so that trees can be compared."""


class Predicate(Expression):
    def __and__(self, other: Predicate) -> Predicate:
        return And(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return Or(self, other)

    def __invert__(self) -> Predicate:
        return Not(self)


@dataclass(frozen=True)
class Ref(Expression):
    """A column by name (dots reach into structs); field_id, if known, survives renames."""

    name: str
    field_id: int | None = None


@dataclass(frozen=True)
class Lit(Expression):
    value: Any


@dataclass(frozen=True)
class Call(Expression):
    """Any function Spark knows, built in or registered."""

    name: str
    args: tuple[Expression, ...]


@dataclass(frozen=True)
class Constant(Predicate):
    value: bool


@dataclass(frozen=True)
class Compare(Predicate):
    op: str
    left: Expression
    right: Expression


@dataclass(frozen=True)
class Test(Predicate):
    """is_null, not_null, is_nan, not_nan."""

    op: str
    arg: Expression


@dataclass(frozen=True)
class Member(Predicate):
    arg: Expression
    values: tuple[Any, ...]
    negated: bool = False


@dataclass(frozen=True)
class Prefix(Predicate):
    arg: Expression
    prefix: str
    negated: bool = False


@dataclass(frozen=True)
class Junction(Predicate):
    op: str  # "and" or "or"
    parts: tuple[Predicate, ...]


@dataclass(frozen=True)
class Negation(Predicate):
    part: Predicate


TRUE, FALSE = Constant(True), Constant(False)


def _expr(x: Any) -> Expression:
    return x if isinstance(x, Expression) else Ref(x) if isinstance(x, str) else Lit(x)


def _value(x: Any) -> Expression:
    return x if isinstance(x, Expression) else Lit(x)


def _join(op: str, parts: tuple[Predicate, ...]) -> Predicate:
    neutral, absorbing = (TRUE, FALSE) if op == "and" else (FALSE, TRUE)
    flat: list[Predicate] = []
    for p in parts:
        flat += p.parts if isinstance(p, Junction) and p.op == op else (p,)
    flat = [p for p in flat if p != neutral]
    if absorbing in flat:
        return absorbing
    return neutral if not flat else flat[0] if len(flat) == 1 else Junction(op, tuple(flat))


def And(*parts: Predicate) -> Predicate:
    return _join("and", parts)


def Or(*parts: Predicate) -> Predicate:
    return _join("or", parts)


def Not(part: Predicate) -> Predicate:
    if isinstance(part, Constant):
        return Constant(not part.value)
    return part.part if isinstance(part, Negation) else Negation(part)


def _comparison(op: str):
    def build(left: Any, right: Any) -> Predicate:
        return Compare(op, _expr(left), _value(right))

    build.__name__ = op
    return build


equal, not_equal, less, less_equal, greater, greater_equal, null_safe_equal = map(
    _comparison, ("=", "<>", "<", "<=", ">", ">=", "<=>")
)


def is_null(x: Any) -> Predicate:
    return Test("is_null", _expr(x))


def not_null(x: Any) -> Predicate:
    return Test("not_null", _expr(x))


def is_nan(x: Any) -> Predicate:
    return Test("is_nan", _expr(x))


def not_nan(x: Any) -> Predicate:
    return Test("not_nan", _expr(x))


def isin(x: Any, values: Any) -> Predicate:
    return Member(_expr(x), tuple(values))


def not_in(x: Any, values: Any) -> Predicate:
    return Member(_expr(x), tuple(values), True)


def starts_with(x: Any, prefix: str) -> Predicate:
    return Prefix(_expr(x), prefix)


def not_starts_with(x: Any, prefix: str) -> Predicate:
    return Prefix(_expr(x), prefix, True)


def call(name: str, *args: Any) -> Call:
    return Call(name, tuple(map(_expr, args)))


def references(e: Expression) -> set[str]:
    """Names of all columns below a node."""
    if isinstance(e, Ref):
        return {e.name}
    below = []
    for v in vars(e).values():
        below += [x for x in (v if isinstance(v, tuple) else (v,)) if isinstance(x, Expression)]
    return set().union(*map(references, below)) if below else set()


class UnresolvedColumn(ValueError):
    pass


def field_type(schema: T.StructType, name: str) -> T.DataType:
    kind: T.DataType = schema
    for part in name.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            raise UnresolvedColumn(f"no column {name}")
        kind = kind[part].dataType
    return kind


def bind(e: Expression, schema: T.StructType, lenient: bool = False) -> Expression:
    """The tree with field ids (field metadata `id`) in its references; an unknown column raises, or stays as it is if lenient."""
    if isinstance(e, Ref):
        try:
            field_type(schema, e.name)
        except UnresolvedColumn:
            if lenient:
                return e
            raise
        top = schema[e.name.split(".")[0]]
        return Ref(e.name, top.metadata.get("id") if "." not in e.name else None)
    changed = {}
    for k, v in vars(e).items():
        if isinstance(v, Expression):
            changed[k] = bind(v, schema, lenient)
        elif isinstance(v, tuple):
            changed[k] = tuple(bind(x, schema, lenient) if isinstance(x, Expression) else x for x in v)
        else:
            changed[k] = v
    return type(e)(**changed)


def _kind_of_type(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "number"
    for kind, types in {
        "string": T.StringType, "boolean": T.BooleanType, "binary": T.BinaryType, "date": T.DateType, "time": (T.TimestampType, T.TimestampNTZType),
    }.items():
        if isinstance(t, types):
            return kind
    return "other"


def kind_of_value(v: Any) -> str:
    for kind, types in (
        ("null", type(None)), ("boolean", bool), ("number", (int, float, decimal.Decimal)), ("string", str), ("binary", (bytes, bytearray)),
        ("time", dt.datetime), ("date", dt.date),
    ):
        if isinstance(v, types):
            return kind
    return "other"


def _kind(e: Expression, schema: T.StructType | None) -> str:
    if isinstance(e, Lit):
        return kind_of_value(e.value)
    if isinstance(e, Ref) and schema is not None:
        return _kind_of_type(field_type(schema, e.name))
    return "boolean" if isinstance(e, Predicate) else "unknown"


def comparable(a: str, b: str) -> bool:
    return a == b or "unknown" in (a, b) or "null" in (a, b) or {a, b} == {"date", "time"}


_NULL = lambda: F.lit(None).cast("boolean")
_OPS = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def quoted(name: str) -> str:
    return ".".join(f"`{p}`" for p in name.split("."))


def to_column(e: Expression, schema: T.StructType | None = None) -> Column:
    """The exact value of a tree as a Spark column; with a schema, kinds that don't compare give NULL and unknown columns raise."""
    if isinstance(e, Ref):
        if schema is not None:
            field_type(schema, e.name)
        return F.col(quoted(e.name))
    if isinstance(e, (Lit, Constant)):
        return F.lit(e.value)
    if isinstance(e, Call):
        return F.call_function(e.name, *(to_column(a, schema) for a in e.args))
    if isinstance(e, Junction):
        return functools.reduce(operator.and_ if e.op == "and" else operator.or_, (to_column(p, schema) for p in e.parts))
    if isinstance(e, Negation):
        return ~to_column(e.part, schema)
    if isinstance(e, Compare):
        a, b = to_column(e.left, schema), to_column(e.right, schema)
        fits = comparable(_kind(e.left, schema), _kind(e.right, schema))
        if e.op == "<=>":
            return a.eqNullSafe(b) if fits else a.isNull() & b.isNull()
        return _OPS[e.op](a, b) if fits else _NULL()
    if isinstance(e, Test):
        c = to_column(e.arg, schema)
        if e.op == "is_null":
            return c.isNull()
        if e.op == "not_null":
            return c.isNotNull()
        if _kind(e.arg, schema) not in ("number", "unknown"):
            return F.lit(False) if e.op == "is_nan" else F.when(c.isNotNull(), F.lit(True))
        return F.isnan(c) if e.op == "is_nan" else F.when(c.isNotNull(), ~F.isnan(c))
    if isinstance(e, Member):
        c, kind = to_column(e.arg, schema), _kind(e.arg, schema)
        known = [v for v in e.values if v is not None and comparable(kind, kind_of_value(v))]
        hit = c.isin(known) if known else F.lit(False)
        if None in e.values:
            hit = hit | _NULL()
        hit = F.when(c.isNotNull(), hit)  # an empty list is false only for what is not null
        return ~hit if e.negated else hit
    if isinstance(e, Prefix):
        if _kind(e.arg, schema) not in ("string", "unknown"):
            raise TypeError("starts_with is for strings")
        c = to_column(e.arg, schema).startswith(e.prefix)
        return ~c if e.negated else c
    raise TypeError(f"not an expression: {e!r}")


def where(df: DataFrame, predicate: Predicate) -> DataFrame:
    """Rows for which the predicate is exactly true."""
    return df.filter(to_column(predicate, df.schema))


def evaluate(df: DataFrame, **named: Expression) -> DataFrame:
    """df with the value of each expression as a column."""
    return df.withColumns({k: to_column(v, df.schema) for k, v in named.items()})


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns, top-level or dotted, in the order asked for; an empty list, repeats and unknown names raise."""
    if not columns:
        raise ValueError("no columns")
    if len(set(columns)) < len(columns):
        raise ValueError("a column twice")
    for c in columns:
        field_type(df.schema, c)
    return df.select(*(F.col(quoted(c)).alias(c) for c in columns))
