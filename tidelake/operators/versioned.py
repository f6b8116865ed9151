"""Versioned tables: Parquet files under an append-only log of JSON commits.

The log follows the public Delta layout (add, remove, metaData, protocol, commitInfo, txn,
domainMetadata, cdc). The driver plans over file entries alone; rows are read, joined with
deletion vectors, filtered and written by Spark. A commit creates its file exclusively:
of two writers one wins, and an appender that loses retries on the new version.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bitmaps
from ..plans import expressions as E
from ..plans import skipping
from ..sources.store import Store

READER_FEATURES = {"deletionVectors", "columnMapping", "timestampNtz", "typeWidening", "v2Checkpoint", "vacuumProtocolCheck"}
WRITER_FEATURES = READER_FEATURES | {"appendOnly", "changeDataFeed", "identityColumns", "rowTracking", "inCommitTimestamp", "domainMetadata", "icebergCompatV1", "icebergCompatV2"}
SYSTEM_DOMAIN = "delta."
_WIDER = {
    ("byte", "short"), ("byte", "integer"), ("byte", "long"), ("short", "integer"), ("short", "long"), ("integer", "long"), ("float", "double"),
    ("byte", "double"), ("short", "double"), ("integer", "double"), ("date", "timestamp_ntz"),
}


class Conflict(RuntimeError):
    """Another writer committed the version first."""


#: Columns with the row id and the version of a row that a rewrite carries on, and the properties that name them in files.
ROW_ID, ROW_VERSION = "__row_id", "__row_version"
_KEPT = {ROW_ID: "delta.rowTracking.materializedRowIdColumnName", ROW_VERSION: "delta.rowTracking.materializedRowCommitVersionColumnName"}


class UnsupportedProtocol(RuntimeError):
    pass


@dataclass
class Snapshot:
    version: int
    schema: T.StructType
    partition_columns: list[str]
    properties: dict[str, str]
    protocol: dict
    files: dict[str, dict]  # path -> add; at most one deletion vector is active for a path
    txns: dict[str, int] = field(default_factory=dict)
    domains: dict[str, str] = field(default_factory=dict)
    timestamp: int = 0
    metadata_id: str = ""

    @property
    def row_id_mark(self) -> int:
        return int(json.loads(self.domains.get("delta.rowTracking", '{"rowIdHighWaterMark": -1}'))["rowIdHighWaterMark"])


def _name(version: int) -> str:
    return f"_delta_log/{version:020d}.json"


def check_type_change(old: T.DataType, new: T.DataType) -> None:
    """Raise unless values of old are values of new without loss."""
    if old == new or (old.typeName(), new.typeName()) in _WIDER:
        return
    if isinstance(new, T.DecimalType):
        digits = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 20}.get(type(old))
        if digits is not None and new.precision - new.scale >= digits:
            return
        if isinstance(old, T.DecimalType) and new.scale >= old.scale and new.precision - new.scale >= old.precision - old.scale:
            return
    raise ValueError(f"{old.simpleString()} can't become {new.simpleString()}")


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.store = Store(spark, self.path)
        if not self.versions():
            raise FileNotFoundError(f"no table at {path}")

    # -- create and open

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, partition_by: list[str] | None = None, properties: dict[str, str] | None = None, column_mapping: str = "none") -> VersionedTable:
        """column_mapping: none, id or name; then files hold physical names that survive renames."""
        store, properties = Store(spark, path.rstrip("/")), dict(properties or {})
        if column_mapping not in ("none", "id", "name"):
            raise ValueError(column_mapping)
        if column_mapping != "none":
            schema = _mapped(schema)
            properties |= {"delta.columnMapping.mode": column_mapping, "delta.columnMapping.maxColumnId": str(len(schema))}
        for c in partition_by or []:
            E.field_type(schema, c)
        meta = _metadata(schema, partition_by or [], _with_kept(properties))
        actions = [{"protocol": {"minReaderVersion": 3, "minWriterVersion": 7, "readerFeatures": ["deletionVectors"], "writerFeatures": ["deletionVectors", "domainMetadata"]}}, {"metaData": meta}]
        if not store.write_new(_name(0), _lines([_info("CREATE TABLE"), *actions])):
            raise Conflict(f"a table is at {path} already")
        return cls(spark, path)

    @classmethod
    def open_or_create(cls, spark: SparkSession, path: str, schema: T.StructType, **options) -> VersionedTable:
        try:
            return cls(spark, path)
        except FileNotFoundError:
            return cls.create(spark, path, schema, **options)

    # -- the log

    def versions(self) -> list[int]:
        return sorted(int(n[11:31]) for n, _, _ in self.store.list("_delta_log") if n.endswith(".json") and n[11:31].isdigit() and len(n) == 36)

    def history(self) -> list[dict]:
        """commitInfo of every version, the latest first."""
        return [next((a["commitInfo"] for a in self._actions(v) if "commitInfo" in a), {}) | {"version": v} for v in reversed(self.versions())]

    def _actions(self, version: int) -> list[dict]:
        return [json.loads(x) for x in self.store.read(_name(version)).decode().splitlines() if x]

    def snapshot(self, version: int | None = None, timestamp: int | None = None) -> Snapshot:
        """The table at a version, or at the last one committed at a time (ms) or before; else the latest."""
        there = self.versions()
        if timestamp is not None:
            older = [v for v in there if self._time(v) <= timestamp]
            if not older:
                raise ValueError("the table is younger")
            version = older[-1]
        version = there[-1] if version is None else version
        if version not in there:
            raise ValueError(f"no version {version}")
        points = [v for v in self._checkpoints() if v <= version]
        start, actions = (points[-1] + 1, self._read_checkpoint(points[-1])) if points else (0, [])
        wanted = [v for v in there if start <= v <= version]
        if wanted != list(range(start, version + 1)):
            raise FileNotFoundError("commits are missing")
        snap = Snapshot(version, T.StructType(), [], {}, {}, {})
        found = False
        for a in actions + [a for v in wanted for a in self._actions(v)]:
            found |= _apply(snap, a)
        if not found:
            raise ValueError("the log has no metadata")
        if snap.protocol.get("minReaderVersion", 1) > 3 or set(snap.protocol.get("readerFeatures", [])) - READER_FEATURES:
            raise UnsupportedProtocol(f"can't read {snap.protocol}")
        snap.timestamp = self._time(version)
        return snap

    def _time(self, version: int) -> int:
        return next((a["commitInfo"].get("inCommitTimestamp", a["commitInfo"]["timestamp"]) for a in self._actions(version) if "commitInfo" in a), 0)

    def commit(self, snap: Snapshot, actions: list[dict], operation: str, appends: bool = False, tries: int = 20) -> int:
        """Write the version after snap's. A commit that only appends is tried again on top of another writer's, unless that changed the metadata."""
        known = set(snap.protocol.get("writerFeatures", [])) - WRITER_FEATURES
        if snap.protocol.get("minWriterVersion", 2) > 7 or known:
            raise UnsupportedProtocol(f"can't write {snap.protocol}")
        version = snap.version + 1
        for _ in range(tries):
            last = self._time(version - 1)
            info = _info(operation)
            info["commitInfo"]["inCommitTimestamp"] = max(info["commitInfo"]["timestamp"], last + 1)
            if self.store.write_new(_name(version), _lines([info, *actions])):
                if version % int(snap.properties.get("delta.checkpointInterval", 10)) == 0:
                    self.checkpoint()
                return version
            if not appends or any("metaData" in a or "protocol" in a for a in self._actions(version)):
                break
            version += 1
        raise Conflict(f"version {version} was written by another writer")

    # -- checkpoints and log compaction

    def checkpoint(self) -> int:
        """All live actions of the latest version as one Parquet file of JSON lines."""
        snap = self.snapshot()
        live = [{"protocol": snap.protocol}, {"metaData": _metadata(snap.schema, snap.partition_columns, snap.properties, snap.metadata_id)}]
        live += [{"add": a} for a in snap.files.values()] + [{"txn": {"appId": k, "version": v}} for k, v in snap.txns.items()]
        live += [{"domainMetadata": {"domain": k, "configuration": v, "removed": False}} for k, v in snap.domains.items()]
        lines = [(json.dumps(a),) for a in live]
        self.spark.createDataFrame(lines, "action string").write.mode("overwrite").parquet(f"{self.path}/_delta_log/{snap.version:020d}.checkpoint.parquet")
        return snap.version

    def _checkpoints(self) -> list[int]:
        done = [n for n, _, _ in self.store.list("_delta_log", deep=True) if n.endswith(".checkpoint.parquet/_SUCCESS")]
        return sorted(int(n[11:31]) for n in done)

    def _read_checkpoint(self, version: int) -> list[dict]:
        rows = self.spark.read.parquet(f"{self.path}/_delta_log/{version:020d}.checkpoint.parquet").collect()
        return [json.loads(r["action"]) for r in rows]

    def compact_log(self, start: int, end: int) -> str:
        """The net effect of versions start to end as one file of actions; removed domains stay removed, metadata stays."""
        adds, removes, last = {}, {}, {}
        for v in range(start, end + 1):
            for a in self._actions(v):
                if "add" in a:
                    removes.pop(a["add"]["path"], None)
                    adds[a["add"]["path"]] = a
                elif "remove" in a:
                    adds.pop(a["remove"]["path"], None)
                    removes[a["remove"]["path"]] = a
                elif "cdc" not in a and "commitInfo" not in a:
                    kind = next(iter(a))
                    last[kind, a[kind].get("appId") or a[kind].get("domain")] = a
        name = f"_delta_log/{start:020d}.{end:020d}.compacted.json"
        self.store.write_new(name, _lines([*last.values(), *removes.values(), *adds.values()]))
        return name

    # -- reading

    def read(self, columns: list[str] | None = None, predicate: E.Predicate | None = None, version: int | None = None, timestamp: int | None = None) -> DataFrame:
        snap = self.snapshot(version, timestamp)
        files = self.plan(snap, predicate)
        df = self._rows(snap, files)
        df = E.where(df, predicate) if predicate is not None else df
        return E.project(df, columns) if columns is not None else df.select(*(F.col(E.quoted(c)) for c in snap.schema.names))

    def plan(self, snap: Snapshot, predicate: E.Predicate | None = None) -> list[dict]:
        """The files that may hold matching rows, by partition values and statistics in one pass over file entries."""
        files = list(snap.files.values())
        if predicate is None or not files:
            return files
        schema = _entry_schema(snap.schema)
        rows = [(f["path"], json.loads(f.get("stats") or "{}").get("numRecords"), json.dumps(_entry_stats(snap, f))) for f in files]
        entries = self.spark.createDataFrame(rows, "path string, num_records long, stats string").withColumn("stats", F.from_json("stats", schema))
        keep = {r["path"] for r in entries.filter(skipping.may_match(predicate, snap.schema)).select("path").collect()}
        return [f for f in files if f["path"] in keep]

    def _physical(self, snap: Snapshot) -> T.StructType:
        return T.StructType([T.StructField(_stored(f), f.dataType, True) for f in snap.schema.fields])

    def _files_df(self, snap: Snapshot, files: list[dict], kept: bool = False) -> DataFrame:
        """Rows of files with __file (the path in the log) and __row; no deletion vectors applied. Partition values come from folder names.

        With kept, also the row ids and versions that a rewrite carried on, null where the file's own hold.
        """
        paths = [f"{self.path}/{unquote(f['path'])}" for f in files]
        carried = {snap.properties[p]: c for c, p in _KEPT.items() if kept and p in snap.properties}
        schema = T.StructType([*self._physical(snap).fields, *(T.StructField(c, T.LongType()) for c in carried)])
        df = self.spark.read.schema(schema).option("basePath", self.path).parquet(*paths)
        name = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
        below = F.substring(name, F.length(F.regexp_extract(name, "^.*?" + _regex(self.path.split("://")[-1].removeprefix("file:")) + "/", 0)) + 1, F.lit(1 << 20))
        df = df.withColumns({"__file": below, "__row": F.col("_metadata.row_index")})
        return df.withColumnsRenamed({_stored(f): f.name for f in snap.schema.fields if _stored(f) != f.name} | carried)

    def _rows(self, snap: Snapshot, files: list[dict], keep_place: bool = False, kept: bool = False) -> DataFrame:
        if not files:
            empty = T.StructType([*snap.schema.fields, *([T.StructField("__file", T.StringType()), T.StructField("__row", T.LongType())] if keep_place else [])])
            return self.spark.createDataFrame([], empty)
        marked = [f for f in files if f.get("deletionVector")]
        plain = [f for f in files if not f.get("deletionVector")]
        parts = [self._files_df(snap, plain, kept)] if plain else []
        if marked:
            vectors = [(unquote(f["path"]), json.dumps(f["deletionVector"])) for f in marked]
            gone = self.spark.createDataFrame(vectors, "__file string, vector string").repartition(min(len(vectors), 200)).mapInPandas(_expand, "__file string, __row long")
            parts.append(self._files_df(snap, marked, kept).join(gone, ["__file", "__row"], "left_anti"))
        df = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return df if keep_place else df.drop("__file", "__row")

    def row_ids(self) -> DataFrame:
        """Rows with their row_id and row_commit_version, the version that last changed them (row tracking on).

        Updates and compaction keep a row's id. Both are null for rows of files from before row tracking.
        """
        snap = self.snapshot()
        return self._identified(snap, list(snap.files.values())).withColumnsRenamed({ROW_ID: "row_id", ROW_VERSION: "row_commit_version"})

    def _identified(self, snap: Snapshot, files: list[dict]) -> DataFrame:
        """Rows of files with ROW_ID and ROW_VERSION: those carried on by a rewrite, else by the file and the place in it."""
        if not files:
            return self._rows(snap, files).withColumns({ROW_ID: F.lit(None).cast("long"), ROW_VERSION: F.lit(None).cast("long")})
        entries = [(unquote(f["path"]), f.get("baseRowId"), f.get("defaultRowCommitVersion")) for f in files]
        df = self._rows(snap, files, True, True).join(self.spark.createDataFrame(entries, "__file string, __base long, __since long"), "__file")
        own = {ROW_ID: F.col("__base") + F.col("__row"), ROW_VERSION: F.col("__since")}
        df = df.withColumns({c: F.coalesce(F.col(c), x) if c in df.columns else x for c, x in own.items()})
        return df.select(*(F.col(E.quoted(c)) for c in snap.schema.names), ROW_ID, ROW_VERSION)

    # -- writing

    def _write_files(self, snap: Snapshot, df: DataFrame, folder: str = "", partitioned: bool = True) -> list[dict]:
        """Write rows as new files with unique names and describe each in an add, with statistics. ROW_ID and ROW_VERSION are carried on if df has them."""
        mark = uuid.uuid4().hex
        stage = f"{self.path}/{folder}_stage-{mark}"
        carried = [F.col(c).cast("long").alias(snap.properties[p]) for c, p in _KEPT.items() if not folder and c in df.columns and p in snap.properties]
        named = df.select(*(F.col(E.quoted(f.name)).cast(f.dataType).alias(_stored(f)) for f in snap.schema.fields), *([F.col("_change_type")] if folder else []), *carried)
        keys = [_stored(snap.schema[c]) for c in snap.partition_columns] if partitioned else []
        w = named.write.option("parquet.page.write-checksum.enabled", "true")
        (w.partitionBy(*keys) if keys else w).parquet(stage)
        adds = []
        stage_store = Store(self.spark, stage)
        found = [x for x in stage_store.list("", deep=True) if x[0].endswith(".parquet")]
        if not found:
            stage_store.delete("")
            return []
        stats = {}
        if not folder:
            physical = T.StructType([T.StructField(_stored(f), f.dataType) for f in snap.schema.fields if f.name not in snap.partition_columns])
            for r in skipping.file_statistics(self.spark.read.schema(physical).parquet(*(f"{stage}/{n}" for n, _, _ in found))).collect():
                stats[unquote(r["file"]).partition(f"_stage-{mark}/")[2]] = (r["num_records"], r["stats"].asDict(recursive=True))
        for name, size, at in found:
            if not folder and name not in stats:  # of an empty partition
                continue
            parent, _, file = name.rpartition("/")
            target = f"{folder}{parent + '/' if parent else ''}{mark}-{file}"
            self.store.fs.mkdirs(self.store._path(target).getParent())
            if not self.store.fs.rename(stage_store._path(name), self.store._path(target)):
                raise OSError(f"can't move {name}")
            values = {unquote(k): None if v == "__HIVE_DEFAULT_PARTITION__" else unquote(v) for k, v in (p.split("=", 1) for p in parent.split("/") if p)}
            entry = {"path": quote(target, safe="/=:@!$&'()*,;~"), "partitionValues": values, "size": size, "modificationTime": at, "dataChange": True}
            if name in stats:
                n, by_column = stats[name]
                entry["stats"] = json.dumps({
                    "numRecords": n, "minValues": {c: _plain(s["min"]) for c, s in by_column.items() if s and s["min"] is not None and _plain(s["min"]) is not None},
                    "maxValues": {c: _plain(s["max"]) for c, s in by_column.items() if s and s["max"] is not None and _plain(s["max"]) is not None},
                    "nullCount": {c: s["nulls"] for c, s in by_column.items() if s},
                })
            adds.append(entry)
        stage_store.delete("")
        return adds

    def _tracked(self, snap: Snapshot, adds: list[dict]) -> list[dict]:
        """Adds with base row ids, and the new mark, if the table tracks rows."""
        if not _tracks(snap):
            return [{"add": a} for a in adds]
        mark, out = snap.row_id_mark, []
        for a in adds:
            out.append({"add": a | {"baseRowId": mark + 1, "defaultRowCommitVersion": snap.version + 1}})
            mark += json.loads(a["stats"])["numRecords"]
        return out + [{"domainMetadata": {"domain": "delta.rowTracking", "configuration": json.dumps({"rowIdHighWaterMark": mark}), "removed": False}}]

    def write(self, df: DataFrame, mode: str = "append", app_id: str | None = None, app_version: int | None = None) -> int | None:
        """Append to the table or replace its rows. With app_id, a version already seen for it writes nothing and returns None."""
        if mode not in ("append", "overwrite"):
            raise ValueError(mode)
        snap = self.snapshot()
        if app_id is not None and snap.txns.get(app_id, -1) >= app_version:
            return None
        df, meta = self._identities(snap, df)
        missing = set(df.columns) ^ set(snap.schema.names)
        if missing:
            raise ValueError(f"columns differ: {sorted(missing)}")
        adds = self._write_files(snap, df)
        removes = [_remove(f) for f in snap.files.values()] if mode == "overwrite" else []
        txn = [{"txn": {"appId": app_id, "version": app_version}}] if app_id is not None else []
        tracked = _tracks(snap)
        return self.commit(snap, [*meta, *txn, *removes, *self._tracked(snap, adds)], "WRITE", appends=mode == "append" and not meta and not txn and not tracked)

    def _identities(self, snap: Snapshot, df: DataFrame) -> tuple[DataFrame, list[dict]]:
        """df with identity columns filled: dense numbers in two passes (rows of each partition, then offsets)."""
        wanted = [f for f in snap.schema.fields if "delta.identity.start" in f.metadata and f.name not in df.columns]
        explicit = [f for f in snap.schema.fields if "delta.identity.start" in f.metadata and f.name in df.columns]
        if any(not f.metadata.get("delta.identity.allowExplicitInsert") for f in explicit):
            raise ValueError("an identity column is given")
        if not wanted and not explicit:
            return df, []
        fields = {f.name: f for f in snap.schema.fields}
        if wanted:
            df = df.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()).checkpoint() if _can_checkpoint(self.spark) else df
            counts = df.groupBy("__part").count()
            before = counts.select("__part", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
            place = (F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__before")).cast("long")
            df = df.join(F.broadcast(before), "__part")  # a row for each partition
            total = counts.agg(F.sum("count")).first()[0] or 0
            for f in wanted:
                start, step, mark = (f.metadata.get(f"delta.identity.{k}") for k in ("start", "step", "highWaterMark"))
                first = start if mark is None else mark + step
                df = df.withColumn(f.name, F.lit(first).cast("long") + place * step)
                if total:
                    fields[f.name] = T.StructField(f.name, f.dataType, f.nullable, f.metadata | {"delta.identity.highWaterMark": first + (total - 1) * step})
            df = df.drop("__part", "__at", "__before")
        for f in explicit:
            step, mark = f.metadata["delta.identity.step"], f.metadata.get("delta.identity.highWaterMark")
            top = df.agg(F.max(E.quoted(f.name)) if step > 0 else F.min(E.quoted(f.name))).first()[0]
            marks = [x for x in (top, mark) if x is not None]
            if marks:
                fields[f.name] = T.StructField(f.name, f.dataType, f.nullable, f.metadata | {"delta.identity.highWaterMark": (max if step > 0 else min)(marks)})
        schema = T.StructType([fields[n] for n in snap.schema.names])
        return df, [{"metaData": _metadata(schema, snap.partition_columns, snap.properties, snap.metadata_id)}]

    # -- changing rows

    def _changes_on(self, snap: Snapshot) -> bool:
        return snap.properties.get("delta.enableChangeDataFeed") == "true"

    def delete(self, predicate: E.Predicate) -> tuple[int, int]:
        """Mark the rows for which predicate is true in deletion vectors. (rows, version); no match: no commit."""
        snap = self.snapshot()
        hit = E.where(self._rows(snap, self.plan(snap, predicate), True), predicate)
        places = hit.select("__file", "__row").groupBy("__file").applyInPandas(_pack, "file string, rows long, vector binary").collect()  # a bitmap for each file
        if not places:
            return 0, snap.version
        by_path = {unquote(p): f for p, f in snap.files.items()}
        actions, total = [], 0
        for r in places:
            old = by_path[r["file"]]
            rows = bitmaps.from_bytes(bytes(r["vector"]))
            total += len(rows)
            if old.get("deletionVector"):
                rows = np.union1d(rows, _vector(old["deletionVector"]))
            actions.append(_remove(old))
            if len(rows) < json.loads(old["stats"])["numRecords"]:
                data = bitmaps.to_bytes(rows)
                actions.append({"add": old | {"deletionVector": {"storageType": "i", "pathOrInlineDv": bitmaps.base85(data), "sizeInBytes": len(data), "cardinality": len(rows)}}})
        if self._changes_on(snap):
            actions += [{"cdc": c | {"dataChange": False}} for c in self._write_files(snap, hit.withColumn("_change_type", F.lit("delete")), "_change_data/")]
        return total, self.commit(snap, actions, "DELETE")

    def update(self, predicate: E.Predicate, assignments: dict[str, Column | E.Expression]) -> tuple[int, int]:
        """Set columns where predicate is true; every expression sees the old row. Files without a match stay. (rows, version).

        Where rows are tracked they keep their id, and those not changed the version that last changed them.
        """
        snap = self._tracking_named()
        for c in assignments:
            E.field_type(snap.schema, c)
        files = self.plan(snap, predicate)
        rows = self._rows(snap, files, True)
        true = F.coalesce(E.to_column(predicate, snap.schema), F.lit(False))
        touched = {r["__file"]: r["n"] for r in rows.filter(true).groupBy("__file").agg(F.count("*").alias("n")).collect()}
        if not touched:
            return 0, snap.version
        olds = [f for f in files if unquote(f["path"]) in touched]
        rows = self._identified(snap, olds) if _tracks(snap) else self._rows(snap, olds)
        new = {c: F.when(true, E.to_column(v, snap.schema) if isinstance(v, E.Expression) else v).otherwise(F.col(E.quoted(c))) for c, v in assignments.items()}
        after = rows.select(*(new.get(f.name, F.col(E.quoted(f.name))).cast(f.dataType).alias(f.name) for f in snap.schema.fields), *([F.col(ROW_ID), F.when(~true, F.col(ROW_VERSION)).alias(ROW_VERSION)] if _tracks(snap) else []))
        adds = self._write_files(snap, after)
        actions = [_remove(f) for f in olds] + self._tracked(snap, adds)
        if self._changes_on(snap):
            before = rows.filter(true).select(*(F.col(E.quoted(c)) for c in snap.schema.names), F.lit("update_preimage").alias("_change_type"))
            changed = rows.filter(true).select(*(new.get(f.name, F.col(E.quoted(f.name))).cast(f.dataType).alias(f.name) for f in snap.schema.fields), F.lit("update_postimage").alias("_change_type"))
            actions += [{"cdc": c | {"dataChange": False}} for c in self._write_files(snap, before.unionByName(changed), "_change_data/")]
        return sum(touched.values()), self.commit(snap, actions, "UPDATE")

    def changes(self, start: int, end: int | None = None) -> DataFrame:
        """Row changes of versions start to end with _change_type, _commit_version and _commit_timestamp.

        Versions with change files give these; others their added and removed files, where
        of a file whose deletion vector grew only the newly deleted rows count.
        """
        there = self.versions()
        end = there[-1] if end is None else end
        if start > end:
            raise ValueError("start is after end")
        parts = []
        for v in range(start, end + 1):
            actions, snap = self._actions(v), self.snapshot(v)
            cdc = [a["cdc"] for a in actions if "cdc" in a]
            if cdc:
                physical = T.StructType([*self._physical(snap).fields, T.StructField("_change_type", T.StringType())])
                df = self.spark.read.schema(physical).option("basePath", f"{self.path}/_change_data").parquet(*(f"{self.path}/{unquote(c['path'])}" for c in cdc))
                found = [df.withColumnsRenamed({_stored(f): f.name for f in snap.schema.fields if _stored(f) != f.name})]
            else:
                changed = lambda k: {a[k]["path"]: a[k] for a in actions if k in a and a[k].get("dataChange", True)}
                adds, removes = changed("add"), changed("remove")
                old = self.snapshot(v - 1) if v else None
                found = []
                fresh = [a for p, a in adds.items() if p not in removes]
                gone = [old.files[p] for p in removes if p not in adds and p in old.files] if old else []
                both = [p for p in adds if p in removes]
                if fresh:
                    found.append(self._rows(snap, fresh).withColumn("_change_type", F.lit("insert")))
                if gone:
                    found.append(self._rows(snap, gone).withColumn("_change_type", F.lit("delete")))
                if both:
                    was = self._rows(snap, [old.files[p] for p in both], True)
                    left = self._rows(snap, [adds[p] for p in both], True).select("__file", "__row")
                    found.append(was.join(left, ["__file", "__row"], "left_anti").drop("__file", "__row").withColumn("_change_type", F.lit("delete")))
            for df in found:
                parts.append(df.select(*(F.col(E.quoted(c)) for c in snap.schema.names), "_change_type", F.lit(v).cast("long").alias("_commit_version"), F.timestamp_millis(F.lit(self._time(v))).alias("_commit_timestamp")))
        if not parts:
            schema = self.snapshot(end).schema
            return self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("_change_type", T.StringType()), T.StructField("_commit_version", T.LongType()), T.StructField("_commit_timestamp", T.TimestampType())]))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    # -- maintenance

    def compact(self, small: int = 32 << 20, target: int = 128 << 20, most: int = 100) -> int | None:
        """Rewrite small files of each partition into larger ones, deletion vectors applied; no change of data, row ids stay. None if there is nothing to do."""
        snap = self._tracking_named()
        groups: dict[str, list[dict]] = {}
        for f in snap.files.values():
            if f["size"] < small or f.get("deletionVector"):
                groups.setdefault(json.dumps(f["partitionValues"], sort_keys=True), []).append(f)
        actions, adds, rows = [], [], self._identified if _tracks(snap) else self._rows
        for files in groups.values():
            files = files[:most]
            if len(files) < 2 and not any(f.get("deletionVector") for f in files):
                continue
            parts = max(1, -(-sum(f["size"] for f in files) // target))
            adds += [a | {"dataChange": False} for a in self._write_files(snap, rows(snap, files).coalesce(parts))]
            actions += [_remove(f, False) for f in files]
        actions += self._tracked(snap, adds) if actions else []
        return self.commit(snap, actions, "OPTIMIZE") if actions else None

    def vacuum(self, retention_ms: int = 7 * 86_400_000, dry_run: bool = False, now: int | None = None) -> list[str]:
        """Delete files that no version younger than the retention refers to, and are older themselves."""
        now = int(time.time() * 1000) if now is None else now
        used: set[str] = set()
        there = self.versions()
        for v in there:
            if v == there[-1] or self._time(v) >= now - retention_ms or (v + 1 in there and self._time(v + 1) >= now - retention_ms):
                used |= {unquote(p) for p in self.snapshot(v).files}
                used |= {unquote(a["cdc"]["path"]) for a in self._actions(v) if "cdc" in a}
        old = [n for n, _, at in self.store.list("", deep=True) if not n.startswith("_delta_log/") and not n.rpartition("/")[2].startswith(".") and n not in used and at < now - retention_ms]
        if not dry_run:
            for n in old:
                self.store.delete(n)
        return old

    # -- metadata

    def _change_schema(self, schema: T.StructType, operation: str, properties: dict | None = None) -> int:
        snap = self.snapshot()
        return self.commit(snap, [{"metaData": _metadata(schema, snap.partition_columns, _with_kept(snap.properties | (properties or {})), snap.metadata_id)}], operation)

    def _tracking_named(self) -> Snapshot:
        """The snapshot; where rows are tracked, the columns that carry on their ids have names in it."""
        snap = self.snapshot()
        if _tracks(snap) and _with_kept(snap.properties) != snap.properties:
            self.set_properties({})
            return self.snapshot()
        return snap

    def set_properties(self, properties: dict[str, str]) -> int:
        return self._change_schema(self.snapshot().schema, "SET TBLPROPERTIES", properties)

    def add_column(self, name: str, kind: T.DataType) -> int:
        """A nullable column; older files read as NULL."""
        snap = self.snapshot()
        if name in snap.schema.names:
            raise ValueError(f"{name} exists")
        new = T.StructField(name, kind)
        properties = {}
        if "delta.columnMapping.mode" in snap.properties:
            n = int(snap.properties["delta.columnMapping.maxColumnId"]) + 1
            new, properties = _mapped_field(new, n), {"delta.columnMapping.maxColumnId": str(n)}
        return self._change_schema(T.StructType([*snap.schema.fields, new]), "ADD COLUMNS", properties)

    def rename_column(self, old: str, new: str) -> int:
        snap = self.snapshot()
        if "delta.columnMapping.mode" not in snap.properties:
            raise ValueError("renames need column mapping")
        E.field_type(snap.schema, old)
        fields = [T.StructField(new, f.dataType, f.nullable, f.metadata) if f.name == old else f for f in snap.schema.fields]
        return self._change_schema(T.StructType(fields), "RENAME COLUMN")

    def widen_column(self, name: str, kind: T.DataType) -> int:
        """A wider type; older files are cast on read, and the change is kept in the field's history."""
        snap = self.snapshot()
        f = snap.schema[name]
        check_type_change(f.dataType, kind)
        past = [*f.metadata.get("delta.typeChanges", []), {"fromType": f.dataType.simpleString(), "toType": kind.simpleString()}]
        fields = [T.StructField(name, kind, x.nullable, x.metadata | {"delta.typeChanges": past}) if x.name == name else x for x in snap.schema.fields]
        return self._change_schema(T.StructType(fields), "CHANGE COLUMN")

    def type_changes(self, name: str) -> list[dict]:
        return self.snapshot().schema[name].metadata.get("delta.typeChanges", [])

    def domain(self, name: str) -> str | None:
        return self.snapshot().domains.get(name)

    def set_domain(self, name: str, configuration: str | None) -> int:
        """Set, or remove with None, a domain's configuration; system domains are protected."""
        if name.startswith(SYSTEM_DOMAIN):
            raise ValueError(f"{name} belongs to the system")
        snap = self.snapshot()
        return self.commit(snap, [{"domainMetadata": {"domain": name, "configuration": configuration or "", "removed": configuration is None}}], "DOMAIN METADATA")


def identity_field(name: str, start: int = 1, step: int = 1, explicit: bool = False) -> T.StructField:
    if step == 0:
        raise ValueError("a step of zero")
    return T.StructField(name, T.LongType(), False, {"delta.identity.start": start, "delta.identity.step": step, "delta.identity.allowExplicitInsert": explicit})


def _tracks(snap: Snapshot) -> bool:
    return snap.properties.get("delta.enableRowTracking") == "true"


def _with_kept(properties: dict[str, str]) -> dict[str, str]:
    """properties with names for the columns that carry on row ids and versions, if rows are tracked."""
    if properties.get("delta.enableRowTracking") != "true":
        return properties
    return {p: f"_{c.strip('_').replace('_', '-')}-{uuid.uuid4()}" for c, p in _KEPT.items() if p not in properties} | properties


def _can_checkpoint(spark: SparkSession) -> bool:
    if spark.sparkContext.getCheckpointDir() is None:
        import tempfile

        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidelake-"))
    return True


def _mapped_field(f: T.StructField, number: int) -> T.StructField:
    return T.StructField(f.name, f.dataType, f.nullable, f.metadata | {"delta.columnMapping.id": number, "delta.columnMapping.physicalName": f"col-{uuid.uuid4()}"})


def _mapped(schema: T.StructType) -> T.StructType:
    return T.StructType([_mapped_field(f, i) for i, f in enumerate(schema.fields, 1)])


def _stored(f: T.StructField) -> str:
    return f.metadata.get("delta.columnMapping.physicalName", f.name)


def _metadata(schema: T.StructType, partition_by: list[str], properties: dict, ident: str = "") -> dict:
    return {"id": ident or str(uuid.uuid4()), "format": {"provider": "parquet", "options": {}}, "schemaString": schema.json(), "partitionColumns": partition_by, "configuration": properties}


def _info(operation: str) -> dict:
    return {"commitInfo": {"timestamp": int(time.time() * 1000), "operation": operation, "txnId": str(uuid.uuid4())}}


def _lines(actions: list[dict]) -> bytes:
    return "".join(json.dumps(a) + "\n" for a in actions).encode()


def _remove(f: dict, changes: bool = True) -> dict:
    out = {"path": f["path"], "deletionTimestamp": int(time.time() * 1000), "dataChange": changes, "partitionValues": f["partitionValues"], "size": f["size"]}
    return {"remove": out | ({"deletionVector": f["deletionVector"]} if f.get("deletionVector") else {})}


def _apply(snap: Snapshot, a: dict) -> bool:
    """Bring a snapshot up to date with one action; true for metadata."""
    if "add" in a:
        snap.files[a["add"]["path"]] = a["add"]
    elif "remove" in a:
        snap.files.pop(a["remove"]["path"], None)
    elif "protocol" in a:
        snap.protocol = a["protocol"]
    elif "txn" in a:
        snap.txns[a["txn"]["appId"]] = a["txn"]["version"]
    elif "domainMetadata" in a:
        d = a["domainMetadata"]
        snap.domains.pop(d["domain"], None)
        if not d.get("removed"):
            snap.domains[d["domain"]] = d["configuration"]
    elif "metaData" in a:
        m = a["metaData"]
        snap.schema, snap.partition_columns = T.StructType.fromJson(json.loads(m["schemaString"])), m["partitionColumns"]
        snap.properties, snap.metadata_id = m["configuration"], m["id"]
        return True
    return False


def _vector(dv: dict) -> np.ndarray:
    if dv["storageType"] != "i":
        raise UnsupportedProtocol("a deletion vector outside the log")
    return bitmaps.from_bytes(bitmaps.from_base85(dv["pathOrInlineDv"], dv["sizeInBytes"]))


def _expand(batches):
    import pandas as pd

    for pdf in batches:
        for path, dv in zip(pdf["__file"], pdf["vector"]):
            rows = _vector(json.loads(dv)).astype(np.int64)
            yield pd.DataFrame({"__file": [path] * len(rows), "__row": rows})


def _pack(pdf):
    import pandas as pd

    return pd.DataFrame({"file": [pdf["__file"].iloc[0]], "rows": [len(pdf)], "vector": [bitmaps.to_bytes(pdf["__row"].to_numpy())]})


def _plain(v):
    """A bound as JSON; NaN and infinities, which JSON lacks, are unknown."""
    import datetime as dt
    import math

    if isinstance(v, float) and not math.isfinite(v):
        return None
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return v if isinstance(v, (bool, int, float, str)) else str(v)


def _entry_schema(schema: T.StructType) -> T.StructType:
    fields = [schema[c] for c in skipping.ordered_columns(schema)]
    return T.StructType([T.StructField(f.name, T.StructType([T.StructField("min", f.dataType), T.StructField("max", f.dataType), T.StructField("nulls", T.LongType())])) for f in fields])


def _entry_stats(snap: Snapshot, f: dict) -> dict:
    """min, max and nulls of a file by column; a partition column has one value, or nulls alone."""
    stats, out = json.loads(f.get("stats") or "{}"), {}
    n = stats.get("numRecords", 0)
    for c in skipping.ordered_columns(snap.schema):
        field_, stored = snap.schema[c], _stored(snap.schema[c])
        if c in snap.partition_columns:
            v = f["partitionValues"].get(stored)
            kind = field_.dataType
            if v is not None and not isinstance(kind, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)):
                v = v == "true" if isinstance(kind, T.BooleanType) else json.loads(v) if not isinstance(kind, T.DecimalType) else v
            out[c] = {"min": v, "max": v, "nulls": n if v is None else 0}
        else:
            low, high = stats.get("minValues", {}).get(stored), stats.get("maxValues", {}).get(stored)
            out[c] = {"min": low, "max": high, "nulls": stats.get("nullCount", {}).get(stored)}
    return out


def _regex(text: str) -> str:
    import re

    return re.escape(text).replace("/", "/+")
