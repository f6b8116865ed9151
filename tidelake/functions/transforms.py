"""Partition transforms and schema fingerprints, after the published table and Avro formats."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def identity(c: Column) -> Column:
    return c


def void(c: Column) -> Column:
    return F.when(F.lit(False), c)


def year(c: Column) -> Column:
    return F.year(c) - 1970


def month(c: Column) -> Column:
    return (F.year(c) - 1970) * 12 + F.month(c) - 1


def day(c: Column) -> Column:
    return F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date"))


def hour(c: Column) -> Column:
    return F.floor(F.unix_micros(c.cast("timestamp")) / 3_600_000_000).cast("int")


def truncate(c: Column, width: int, kind: T.DataType) -> Column:
    """Down to a multiple of width (decimals: of their unscaled value), or to the first width characters or bytes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.substring(c, 1, width)
    if isinstance(kind, T.DecimalType):
        unit = F.lit(width).cast(T.DecimalType(38, 0)) * F.lit(f"{10 ** -kind.scale:.{kind.scale}f}").cast(T.DecimalType(38, kind.scale))
        return (c - F.pmod(c, unit)).cast(kind)
    return c - F.pmod(c, F.lit(width).cast(kind))


def murmur3(data: bytes, seed: int = 0) -> int:
    """MurmurHash3 x86 32-bit, as a signed integer."""
    mask = 0xFFFFFFFF
    mix = lambda k: ((k * 0xCC9E2D51 & mask) << 15 | (k * 0xCC9E2D51 & mask) >> 17) * 0x1B873593 & mask
    h, whole = seed, len(data) // 4 * 4
    for i in range(0, whole, 4):
        h ^= mix(int.from_bytes(data[i : i + 4], "little"))
        h = ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask
    if tail := data[whole:]:
        h ^= mix(int.from_bytes(tail, "little"))
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def bucket_bytes(v) -> bytes:
    """What the bucket transform hashes: integers, dates and times as 8 little-endian bytes, text as UTF-8."""
    import datetime as dt
    import decimal

    if isinstance(v, str):
        return v.encode()
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    if isinstance(v, decimal.Decimal):
        n = int(v.scaleb(-v.as_tuple().exponent))
        return n.to_bytes((n.bit_length() if n >= 0 else (n + 1).bit_length()) // 8 + 1, "big", signed=True)
    if isinstance(v, dt.datetime):
        v = (v.replace(tzinfo=None) - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    elif isinstance(v, dt.date):
        v = (v - dt.date(1970, 1, 1)).days
    return int(v).to_bytes(8, "little", signed=True)


def bucket(c: Column, buckets: int) -> Column:
    """The table format's bucket number: its hash has another seed than Spark's, so distinct values of a batch go through Python."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("int")
    def bucket_of(values):
        import pyarrow as pa

        known = {v: (murmur3(bucket_bytes(v)) & 0x7FFFFFFF) % buckets for v in set(values.to_pylist()) if v is not None}
        return pa.array([known.get(v) for v in values.to_pylist()], pa.int32())

    return bucket_of(c)


#: Names, full names and attributes that the canonical form of an Avro schema keeps, in this order (fixed values).
_KEPT = ("name", "type", "fields", "symbols", "items", "values", "size")
_PRIMITIVES = ("null", "boolean", "int", "long", "float", "double", "bytes", "string")


def canonical_schema(schema, space: str = "") -> str:
    """The parsing canonical form of an Avro schema (parsed JSON)."""
    if isinstance(schema, str):
        name = schema if schema in _PRIMITIVES or "." in schema or not space else f"{space}.{schema}"
        return json.dumps(name)
    if isinstance(schema, list):
        return "[" + ",".join(canonical_schema(s, space) for s in schema) + "]"
    if schema["type"] in _PRIMITIVES:
        return json.dumps(schema["type"])
    if isinstance(schema["type"], (dict, list)):
        return canonical_schema(schema["type"], space)
    full = schema.get("name", "")
    if full and "." not in full and schema.get("namespace", space):
        full = f"{schema.get('namespace', space)}.{full}"
    inner = full.rpartition(".")[0] if full else space
    out = []
    for k in _KEPT:
        if k not in schema:
            continue
        v = schema[k]
        if k == "name":
            text = json.dumps(full)
        elif k == "fields":
            text = "[" + ",".join('{"name":%s,"type":%s}' % (json.dumps(f["name"]), canonical_schema(f["type"], inner)) for f in v) + "]"
        elif k in ("items", "values"):
            text = canonical_schema(v, inner)
        elif k == "symbols":
            text = "[" + ",".join(map(json.dumps, v)) + "]"
        else:
            text = json.dumps(v)
        out.append(f'"{k}":{text}')
    return "{" + ",".join(out) + "}"


_EMPTY = 0xC15D213AA4D7A795


def _rabin_table() -> list[int]:
    table = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (_EMPTY & -(i & 1))
        table.append(i)
    return table


_TABLE = _rabin_table()


def fingerprint(schema, kind: str = "rabin") -> bytes:
    """A schema's fingerprint: rabin (8 bytes, little-endian), md5 or sha256 of its canonical form."""
    text = canonical_schema(schema).encode()
    if kind != "rabin":
        return hashlib.new(kind, text).digest()
    h = _EMPTY
    for b in text:
        h = h >> 8 ^ _TABLE[(h ^ b) & 0xFF]
    return h.to_bytes(8, "little")
