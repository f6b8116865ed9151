"""Avro object container files and framed messages, without a jar.

Reading is a Python DataSource with a task for each file; decoding and encoding of
messages are Arrow UDFs, so they run in batch and streaming alike. Unions of null and one
type are nullable fields, other unions structs (member0, member1, ...); enums are strings.
"""

from __future__ import annotations

import datetime as dt
import decimal
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.functions import udf

from ..functions.transforms import fingerprint

MAGIC = b"Obj\x01"
MAX_DEPTH = 64
_EPOCH = dt.datetime(1970, 1, 1)


class AvroError(ValueError):
    pass


def _long(buf: io.BytesIO) -> int:
    n = shift = 0
    while True:
        b = buf.read(1)
        if not b:
            raise AvroError("the data end inside a number")
        n |= (b[0] & 0x7F) << shift
        if not b[0] & 0x80:
            return n >> 1 ^ -(n & 1)
        shift += 7
        if shift > 63:
            raise AvroError("a number has more than 10 bytes")


def _put_long(out: bytearray, n: int) -> None:
    n = (n << 1) ^ (n >> 63)
    n &= (1 << 64) - 1
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)


def _take(buf: io.BytesIO, n: int) -> bytes:
    data = buf.read(n) if n >= 0 else b""
    if n < 0 or len(data) < n:
        raise AvroError("the data end inside a value")
    return data


def named(schema, known: dict | None = None, space: str = "") -> dict:
    """Named types of a schema by name."""
    known = {} if known is None else known
    if isinstance(schema, list):
        for s in schema:
            named(s, known, space)
    elif isinstance(schema, dict):
        if "name" in schema:
            space = schema.get("namespace", space)
            known[schema["name"]] = schema
            if space:
                known[f"{space}.{schema['name']}"] = schema
        for k in ("type", "items", "values"):
            if isinstance(schema.get(k), (dict, list)):
                named(schema[k], known, space)
        for f in schema.get("fields", ()):
            named(f["type"], known, space)
    return known


def spark_type(schema, known: dict | None = None, depth: int = 0) -> T.DataType:
    """The Spark type of an Avro schema; recursion deeper than MAX_DEPTH raises."""
    known = named(schema) if known is None else known
    if depth > MAX_DEPTH:
        raise AvroError("the schema is recursive or too deep")
    if isinstance(schema, str):
        simple = {"null": T.NullType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "bytes": T.BinaryType(), "string": T.StringType()}
        return simple[schema] if schema in simple else spark_type(known[schema], known, depth + 1)
    if isinstance(schema, list):
        rest = [s for s in schema if s != "null"]
        if len(rest) == 1:
            return spark_type(rest[0], known, depth + 1)
        return T.StructType([T.StructField(f"member{i}", spark_type(s, known, depth + 1)) for i, s in enumerate(rest)])
    kind, logical = schema["type"], schema.get("logicalType")
    if logical in ("timestamp-millis", "timestamp-micros"):
        return T.TimestampType()
    if logical in ("local-timestamp-millis", "local-timestamp-micros"):
        return T.TimestampNTZType()
    if logical == "date":
        return T.DateType()
    if logical == "decimal":
        return T.DecimalType(schema["precision"], schema.get("scale", 0))
    if kind == "record":
        return T.StructType([T.StructField(f["name"], spark_type(f["type"], known, depth + 1)) for f in schema["fields"]])
    if kind == "array":
        return T.ArrayType(spark_type(schema["items"], known, depth + 1))
    if kind == "map":
        return T.MapType(T.StringType(), spark_type(schema["values"], known, depth + 1))
    return {"enum": T.StringType(), "fixed": T.BinaryType()}.get(kind) or spark_type(kind, known, depth + 1)


def avro_schema(kind: T.DataType, name: str = "topLevelRecord", nullable: bool = False):
    """The Avro schema that values of a Spark type are written with."""
    simple = {T.BooleanType: "boolean", T.ByteType: "int", T.ShortType: "int", T.IntegerType: "int", T.LongType: "long", T.FloatType: "float", T.DoubleType: "double", T.BinaryType: "bytes", T.StringType: "string", T.NullType: "null"}
    if type(kind) in simple:
        out = simple[type(kind)]
    elif isinstance(kind, T.DateType):
        out = {"type": "int", "logicalType": "date"}
    elif isinstance(kind, T.TimestampType):
        out = {"type": "long", "logicalType": "timestamp-micros"}
    elif isinstance(kind, T.TimestampNTZType):
        out = {"type": "long", "logicalType": "local-timestamp-micros"}
    elif isinstance(kind, T.DecimalType):
        out = {"type": "bytes", "logicalType": "decimal", "precision": kind.precision, "scale": kind.scale}
    elif isinstance(kind, T.ArrayType):
        out = {"type": "array", "items": avro_schema(kind.elementType, f"{name}_item", kind.containsNull)}
    elif isinstance(kind, T.MapType):
        out = {"type": "map", "values": avro_schema(kind.valueType, f"{name}_value", kind.valueContainsNull)}
    elif isinstance(kind, T.StructType):
        out = {"type": "record", "name": name, "fields": [{"name": f.name, "type": avro_schema(f.dataType, f"{name}_{f.name}", f.nullable)} for f in kind.fields]}
    else:
        raise AvroError(f"no Avro type for {kind}")
    return ["null", out] if nullable and out != "null" else out


def decode(buf: io.BytesIO, schema, known: dict):
    """One value; structs are dicts."""
    if isinstance(schema, list):
        at = _long(buf)
        if not 0 <= at < len(schema):
            raise AvroError("no such branch of a union")
        rest = [s for s in schema if s != "null"]
        if schema[at] == "null":
            return None
        value = decode(buf, schema[at], known)
        return value if len(rest) == 1 else {f"member{i}": value if s is schema[at] else None for i, s in enumerate(rest)}
    kind = schema if isinstance(schema, str) else schema["type"]
    logical = schema.get("logicalType") if isinstance(schema, dict) else None
    if kind == "null":
        return None
    if kind == "boolean":
        return _take(buf, 1) != b"\0"
    if kind in ("int", "long"):
        n = _long(buf)
        if logical == "date":
            return dt.date(1970, 1, 1) + dt.timedelta(days=n)
        if logical and "timestamp" in logical:
            at = _EPOCH + dt.timedelta(microseconds=n * (1000 if logical.endswith("millis") else 1))
            return at if logical.startswith("local") else at.replace(tzinfo=dt.timezone.utc)
        return n
    if kind == "float":
        return struct.unpack("<f", _take(buf, 4))[0]
    if kind == "double":
        return struct.unpack("<d", _take(buf, 8))[0]
    if kind in ("bytes", "fixed"):
        data = _take(buf, schema["size"] if kind == "fixed" else _long(buf))
        if logical == "decimal":
            return decimal.Decimal(int.from_bytes(data, "big", signed=True)).scaleb(-schema.get("scale", 0))
        return data
    if kind == "string":
        return _take(buf, _long(buf)).decode("utf-8")
    if kind == "enum":
        return schema["symbols"][_long(buf)]
    if kind in ("array", "map"):
        out: list = []
        while n := _long(buf):
            if n < 0:
                n = -n
                _long(buf)
            for _ in range(n):
                out.append((_take(buf, _long(buf)).decode(), decode(buf, schema["values"], known)) if kind == "map" else decode(buf, schema["items"], known))
        return dict(out) if kind == "map" else out
    if kind == "record":
        return {f["name"]: decode(buf, f["type"], known) for f in schema["fields"]}
    return decode(buf, kind if isinstance(kind, (dict, list)) else known[kind], known)


def encode(out: bytearray, value, schema, known: dict) -> None:
    if isinstance(schema, list):
        if value is None:
            return _put_long(out, schema.index("null"))
        rest = [s for s in schema if s != "null"]
        if len(rest) > 1:
            value = value.asDict() if hasattr(value, "asDict") else value
            at = next(i for i in range(len(rest)) if value.get(f"member{i}") is not None)
            branch, value = rest[at], value[f"member{at}"]
        else:
            branch = rest[0]
        _put_long(out, schema.index(branch))
        return encode(out, value, branch, known)
    kind = schema if isinstance(schema, str) else schema["type"]
    logical = schema.get("logicalType") if isinstance(schema, dict) else None
    if value is None and kind != "null":
        raise AvroError("null in a field that can't hold it")
    if kind == "boolean":
        out.append(bool(value))
    elif kind in ("int", "long"):
        if logical == "date":
            value = (value - dt.date(1970, 1, 1)).days
        elif logical and "timestamp" in logical:
            value = value.astimezone(dt.timezone.utc).replace(tzinfo=None) if value.tzinfo or not logical.startswith("local") else value
            value = (value - _EPOCH) // dt.timedelta(microseconds=1000 if logical.endswith("millis") else 1)
        _put_long(out, value)
    elif kind in ("float", "double"):
        out += struct.pack("<f" if kind == "float" else "<d", value)
    elif kind in ("bytes", "fixed"):
        if logical == "decimal":
            n = int(decimal.Decimal(value).scaleb(schema.get("scale", 0)))
            value = n.to_bytes(schema.get("size") or ((n if n >= 0 else n + 1).bit_length() // 8 + 1), "big", signed=True)
        if kind == "bytes":
            _put_long(out, len(value))
        out += value
    elif kind == "string":
        data = value.encode("utf-8")
        _put_long(out, len(data))
        out += data
    elif kind == "enum":
        _put_long(out, schema["symbols"].index(value))
    elif kind in ("array", "map"):
        if value:
            _put_long(out, len(value))
            for x in value.items() if kind == "map" else value:
                if kind == "map":
                    encode(out, x[0], "string", known)
                    encode(out, x[1], schema["values"], known)
                else:
                    encode(out, x, schema["items"], known)
        _put_long(out, 0)
    elif kind == "record":
        value = value.asDict() if hasattr(value, "asDict") else value
        for f in schema["fields"]:
            encode(out, value.get(f["name"]), f["type"], known)
    elif kind != "null":
        encode(out, value, kind if isinstance(kind, (dict, list)) else known[kind], known)


def _plain(s) -> str:
    return s if isinstance(s, str) else s["type"] if isinstance(s["type"], str) else _plain(s["type"])


_PROMOTIONS = {"int": ("long", "float", "double"), "long": ("float", "double"), "float": ("double",), "string": ("bytes",), "bytes": ("string",)}


def resolver(writer, reader, known_w: dict, known_r: dict, depth: int = 0):
    """A function from a value read with one schema to the value another schema asks for; schemas that don't resolve raise."""
    if depth > MAX_DEPTH:
        raise AvroError("the schema is recursive or too deep")
    writer, reader = known_w.get(writer, writer) if isinstance(writer, str) else writer, known_r.get(reader, reader) if isinstance(reader, str) else reader
    if isinstance(writer, list) or isinstance(reader, list):
        w = [s for s in (writer if isinstance(writer, list) else [writer]) if s != "null"]
        r = [s for s in (reader if isinstance(reader, list) else [reader]) if s != "null"]
        if isinstance(writer, list) and "null" in writer and not (isinstance(reader, list) and "null" in reader):
            inner = resolver(w[0], r[0], known_w, known_r, depth + 1)

            def strict(v):
                if v is None:
                    raise AvroError("null for a field that can't hold it")
                return inner(v)

            return strict
        if len(w) == len(r) == 1:
            inner = resolver(w[0], r[0], known_w, known_r, depth + 1)
            return lambda v: None if v is None else inner(v)
        if w == r:
            return lambda v: v
        raise AvroError("unions that don't resolve")
    a, b = _plain(writer), _plain(reader)
    if a == b == "record":
        steps = []
        by_name = {f["name"]: f for f in writer["fields"]}
        for f in reader["fields"]:
            found = next((by_name[n] for n in (f["name"], *f.get("aliases", ())) if n in by_name), None)
            if found is not None:
                steps.append((f["name"], found["name"], resolver(found["type"], f["type"], known_w, known_r, depth + 1), None))
            elif "default" in f:
                steps.append((f["name"], None, None, f["default"]))
            else:
                raise AvroError(f"no value and no default for {f['name']}")
        return lambda v: {n: default if src is None else fn(v[src]) for n, src, fn, default in steps}
    if a == b == "enum":
        symbols, default = set(reader["symbols"]), reader.get("default")

        def remap(v):
            if v in symbols:
                return v
            if default is None:
                raise AvroError(f"no symbol {v}")
            return default

        return remap
    if a == b == "array":
        inner = resolver(writer["items"], reader["items"], known_w, known_r, depth + 1)
        return lambda v: [inner(x) for x in v]
    if a == b == "map":
        inner = resolver(writer["values"], reader["values"], known_w, known_r, depth + 1)
        return lambda v: {k: inner(x) for k, x in v.items()}
    if a == b:
        return lambda v: v
    if b in _PROMOTIONS.get(a, ()):
        return {"string": lambda v: v.decode("utf-8"), "bytes": lambda v: v.encode("utf-8"), "long": int}.get(b, float)
    raise AvroError(f"{a} doesn't resolve to {b}")


def _codec(name: str):
    import zstandard

    def snappy(data: bytes, back: bool) -> bytes:
        import pyarrow as pa

        codec = pa.Codec("snappy")
        if not back:
            return codec.compress(data, asbytes=True) + struct.pack(">I", zlib.crc32(data))
        body, n, shift, i = data[:-4], 0, 0, 0
        while True:  # the size stands before the compressed data
            n |= (body[i] & 0x7F) << shift
            shift, i = shift + 7, i + 1
            if not body[i - 1] & 0x80:
                break
        out = codec.decompress(body, n, asbytes=True)
        if zlib.crc32(out) != struct.unpack(">I", data[-4:])[0]:
            raise AvroError("a block's checksum is wrong")
        return out

    def deflate(data: bytes) -> bytes:
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        return c.compress(data) + c.flush()

    codecs = {
        "null": (lambda d: d, lambda d: d), "deflate": (deflate, lambda d: zlib.decompress(d, -15)),
        "zstandard": (lambda d: zstandard.ZstdCompressor().compress(d), lambda d: zstandard.ZstdDecompressor().decompressobj().decompress(d)),
        "snappy": (lambda d: snappy(d, False), lambda d: snappy(d, True)),
    }
    if name not in codecs:
        raise AvroError(f"codec {name} isn't supported")
    return codecs[name]


def write_container(rows, schema, codec: str = "null", block_rows: int = 4000) -> bytes:
    """A container file of rows (dicts or Rows)."""
    known, pack = named(schema), _codec(codec)[0]
    sync = uuid.uuid4().bytes
    out = bytearray(MAGIC)
    encode(out, {"avro.schema": json.dumps(schema).encode(), "avro.codec": codec.encode()}, {"type": "map", "values": "bytes"}, {})
    out += sync
    block, n = bytearray(), 0

    def flush():
        data = pack(bytes(block))
        _put_long(out, n)
        _put_long(out, len(data))
        out.extend(data + sync)

    for r in rows:
        encode(block, r, schema, known)
        n += 1
        if n == block_rows:
            flush()
            block, n = bytearray(), 0
    if n:
        flush()
    return bytes(out)


def read_header(data: bytes) -> tuple[dict, str, bytes, int]:
    """(schema, codec, sync mark, place of the first block)."""
    if data[:4] != MAGIC:
        raise AvroError("not a container file")
    buf = io.BytesIO(data)
    buf.seek(4)
    meta = decode(buf, {"type": "map", "values": "bytes"}, {})
    sync = _take(buf, 16)
    return json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode(), sync, buf.tell()


def read_container(data: bytes, reader=None) -> Iterator[dict]:
    """Rows of a container file, resolved to a reader's schema if one is given."""
    schema, codec, sync, at = read_header(data)
    known, unpack = named(schema), _codec(codec)[1]
    fix = resolver(schema, reader, known, named(reader)) if reader is not None else None
    buf = io.BytesIO(data)
    buf.seek(at)
    while buf.tell() < len(data):
        n, size = _long(buf), _long(buf)
        block = io.BytesIO(unpack(_take(buf, size)))
        if _take(buf, 16) != sync:
            raise AvroError("a sync mark is wrong")
        for _ in range(n):
            row = decode(block, schema, known)
            yield fix(row) if fix else row


def _as_row(value, kind: T.DataType):
    """Dicts of structs as tuples in field order."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(_as_row(value.get(f.name), f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return [_as_row(v, kind.elementType) for v in value]
    if isinstance(kind, T.MapType):
        return {k: _as_row(v, kind.valueType) for k, v in value.items()}
    return value


def read_avro(spark: SparkSession, paths, reader=None, columns: list[str] | None = None, skip: list[str] | None = None) -> DataFrame:
    """Rows of container files in any store: Spark reads the files whole, tasks decode them. reader: a reader's schema (parsed JSON)."""
    files = spark.read.format("binaryFile").load(paths)
    head = files.limit(1).select("content").first()
    if head is None:
        raise AvroError("no files")
    schema = reader if reader is not None else read_header(bytes(head["content"]))[0]
    kind = spark_type(schema)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:
                rows = [[None if v is None else v for v in _as_row(r, kind)] for r in read_container(bytes(content), schema)]
                for i in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[i : i + 10_000], columns=kind.names, dtype=object)

    out = files.select("content").mapInPandas(run, kind)
    if skip:
        out = out.drop(*skip)
    return out.select(*columns) if columns else out


class AvroContainer(DataSource):
    """format("avro_container"): writes container files; option codec (null, deflate, snappy, zstandard). Reads files of a local or shared folder."""

    @classmethod
    def name(cls) -> str:
        return "avro_container"

    def _files(self) -> list[str]:
        import glob
        import os

        path = self.options["path"].removeprefix("file://")
        return sorted(glob.glob(os.path.join(path, "*.avro"))) if os.path.isdir(path) else [path]

    def schema(self):
        with open(self._files()[0], "rb") as f:
            return spark_type(read_header(f.read())[0])

    def reader(self, schema):
        return _Reader(self._files(), schema, self.options.get("avroSchema"))

    def writer(self, schema, overwrite):
        return _Writer(schema, self.options["path"].removeprefix("file://"), self.options.get("codec", "deflate"), overwrite)


class _Reader(DataSourceReader):
    def __init__(self, files, kind, wanted):
        self.files, self.kind, self.wanted = files, kind, json.loads(wanted) if wanted else None

    def partitions(self):
        return [InputPartition(f) for f in self.files]

    def read(self, partition):
        with open(partition.value, "rb") as f:
            for r in read_container(f.read(), self.wanted):
                yield _as_row(r, self.kind)


class _Writer(DataSourceWriter):
    """Each task writes under a hidden name; commit renames, so lost or repeated tasks leave nothing."""

    def __init__(self, kind, path, codec, overwrite):
        self.kind, self.path, self.codec, self.overwrite = kind, path, codec, overwrite

    def write(self, rows):
        import os

        data = write_container((dict(zip(self.kind.names, r)) for r in rows), avro_schema(self.kind), self.codec)
        os.makedirs(self.path, exist_ok=True)
        name = os.path.join(self.path, f"_part-{uuid.uuid4().hex}.avro")
        with open(name, "wb") as f:
            f.write(data)
        return _Written(name)

    def commit(self, messages):
        import glob
        import os

        if self.overwrite:
            for old in glob.glob(os.path.join(self.path, "*.avro")):
                if not os.path.basename(old).startswith("_"):
                    os.remove(old)
        for m in messages:
            if m is not None:
                folder, name = os.path.split(m.name)
                os.rename(m.name, os.path.join(folder, name[1:]))

    def abort(self, messages):
        import os

        for m in messages:
            if m is not None and os.path.exists(m.name):
                os.remove(m.name)


class _Written(WriterCommitMessage):
    def __init__(self, name):
        self.name = name


class SchemaStore:
    """Schemas by id or fingerprint, for framed messages."""

    def __init__(self, kind: str = "rabin"):
        self.kind, self.schemas = kind, {}

    def register(self, schema) -> bytes:
        key = fingerprint(schema, self.kind)
        self.schemas[key] = schema
        return key

    def set(self, number: int, schema) -> None:
        self.schemas[number] = schema

    def lookup(self, key):
        return self.schemas.get(key)


#: Frames: a single-object mark and fingerprint; a zero byte and a 4- or 8-byte id; nothing.
FRAMES = ("single_object", "id4", "id8", "raw")


def unframe(message: bytes, frame: str):
    """(key, body) of a message."""
    if frame == "single_object":
        if message[:2] != b"\xc3\x01":
            raise AvroError("not a single-object message")
        return message[2:10], message[10:]
    if frame in ("id4", "id8"):
        n = int(frame[2])
        if message[:1] != b"\0":
            raise AvroError("not a framed message")
        return int.from_bytes(message[1 : 1 + n], "big"), message[1 + n :]
    return None, message


def framed(body: bytes, frame: str, key) -> bytes:
    if frame == "single_object":
        return b"\xc3\x01" + key + body
    return b"\0" + key.to_bytes(int(frame[2]), "big") + body if frame in ("id4", "id8") else body


def decode_messages(value: Column, reader, store: SchemaStore, frame: str = "single_object") -> Column:
    """Structs of a binary column of messages; each may have another writer's schema, all are resolved to the reader's."""
    kind, schemas = spark_type(reader), dict(store.schemas)

    def one(message):
        if message is None:
            return None
        key, body = unframe(bytes(message), frame)
        writer = reader if key is None else schemas.get(key)
        if writer is None:
            raise AvroError("a message of an unknown schema")
        known = named(writer)
        return _as_row(resolver(writer, reader, known, named(reader))(decode(io.BytesIO(body), writer, known)), kind)

    return udf(one, kind, useArrow=True)(value)


def encode_messages(value: Column, schema, frame: str = "single_object", key=None) -> Column:
    """Messages of a struct column."""
    key = fingerprint(schema) if frame == "single_object" and key is None else key

    def one(row):
        if row is None:
            return None
        out = bytearray()
        encode(out, row, schema, named(schema))
        return framed(bytes(out), frame, key)

    return udf(one, T.BinaryType(), useArrow=True)(value)
