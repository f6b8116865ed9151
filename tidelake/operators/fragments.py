"""Fragment datasets: numbered versions of fragments (one file each), row offsets, deletion files and secondary indices.

A version is a manifest (JSON) that lists fragments in order, each with its data file, rows
and deletion file, and the indices. Manifests are created exclusively. Indices are Parquet:
(value, fragment, offset) sorted by value, or (value, fragments) for bitmaps; they prune
fragments before a scan, and the exact filter follows.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import expressions as E
from ..sources.store import Store


class FragmentDataset:
    def __init__(self, spark: SparkSession, path: str, version: int | None = None, as_of: int | None = None):
        self.spark, self.path, self.store = spark, path.rstrip("/"), Store(spark, path.rstrip("/"))
        there = self.versions()
        if as_of is not None:
            older = [v for v in there if self._manifest(v)["timestamp"] <= as_of]
            if not older:
                raise ValueError("the dataset is younger")
            version = older[-1]
        if version is not None and version not in there or not there:
            raise FileNotFoundError(f"no version {version} at {path}")
        self.manifest = self._manifest(there[-1] if version is None else version)

    def versions(self) -> list[int]:
        return sorted(int(n.split("/")[1].split(".")[0]) for n, _, _ in self.store.list("_versions") if n.endswith(".manifest"))

    def _manifest(self, version: int) -> dict:
        return json.loads(self.store.read(f"_versions/{version}.manifest"))

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(self.manifest["schema"])

    @property
    def rows(self) -> int:
        return sum(f["rows"] - f["deleted"] for f in self.manifest["fragments"])

    # -- writing

    @classmethod
    def create(cls, spark: SparkSession, df: DataFrame, path: str) -> FragmentDataset:
        store = Store(spark, path.rstrip("/"))
        if store.exists("_versions"):
            raise FileExistsError(path)
        return cls._commit(spark, path, {"version": 0, "schema": df.schema.jsonValue(), "fragments": [], "next": 0, "indices": []}, new=df)

    def append(self, df: DataFrame) -> FragmentDataset:
        if df.schema.simpleString() != self.schema.simpleString():
            raise ValueError("another schema")
        return self._commit(self.spark, self.path, self.manifest, new=df)

    def overwrite(self, df: DataFrame) -> FragmentDataset:
        return self._commit(self.spark, self.path, self.manifest | {"fragments": [], "indices": [], "schema": df.schema.jsonValue()}, new=df)

    @classmethod
    def _commit(cls, spark, path, manifest: dict, new: DataFrame | None = None) -> FragmentDataset:
        path = path.rstrip("/")
        store = Store(spark, path)
        manifest = manifest | {"fragments": list(manifest["fragments"])}
        if new is not None:
            folder = f"data/{uuid.uuid4().hex}"
            new.write.parquet(f"{path}/{folder}")
            counts = {r["f"].rpartition("/")[2]: r["n"] for r in spark.read.schema(new.schema).parquet(f"{path}/{folder}").groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count("*").alias("n")).collect()}
            for name in sorted(counts):
                manifest["fragments"].append({"id": manifest["next"], "file": f"{folder}/{name}", "rows": counts[name], "deleted": 0, "deletions": None})
                manifest["next"] += 1
        manifest |= {"version": manifest["version"] + 1, "timestamp": int(time.time() * 1000)}
        if not store.write_new(f"_versions/{manifest['version']}.manifest", json.dumps(manifest).encode()):
            raise RuntimeError(f"version {manifest['version']} was written by another writer")
        return cls(spark, path, manifest["version"])

    # -- reading

    def _scan(self, fragments: list[dict], deletions: bool = True) -> DataFrame:
        """Rows of fragments with __fragment and __offset."""
        if not fragments:
            return self.spark.createDataFrame([], T.StructType([*self.schema.fields, T.StructField("__fragment", T.LongType()), T.StructField("__offset", T.LongType())]))
        number = self.spark.createDataFrame([(f["file"].rpartition("/")[2], f["id"]) for f in fragments], "__name string, __fragment long")
        df = self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f['file']}" for f in fragments))
        df = df.withColumns({"__name": F.col("_metadata.file_name"), "__offset": F.col("_metadata.row_index")}).join(F.broadcast(number), "__name").drop("__name")  # a row for each file
        gone = [f"{self.path}/{f['deletions']}" for f in fragments if f["deletions"]]
        if deletions and gone:
            df = df.join(self.spark.read.parquet(*gone).select("__fragment", "__offset"), ["__fragment", "__offset"], "left_anti")
        return df

    def read(self, columns: list[str] | None = None, predicate: E.Predicate | None = None, use_indices: bool = True) -> DataFrame:
        fragments = self.manifest["fragments"]
        if predicate is not None:
            for c in E.references(predicate):
                E.field_type(self.schema, c)
            keep = self.candidates(predicate) if use_indices else None
            fragments = fragments if keep is None else [f for f in fragments if f["id"] in keep]
        df = self._scan(fragments)
        df = df.filter(E.to_column(predicate, self.schema)) if predicate is not None else df
        return E.project(df, columns) if columns is not None else df.drop("__fragment", "__offset")

    # -- deletes and updates

    def delete_rows(self, offsets: DataFrame) -> FragmentDataset:
        """Delete rows by (fragment, offset); both must exist."""
        size = {f["id"]: f["rows"] for f in self.manifest["fragments"]}
        limits = self.spark.createDataFrame(list(size.items()) or [(-1, 0)], "fragment long, size long")
        bad = offsets.join(F.broadcast(limits), "fragment", "left").filter("size is null or offset < 0 or offset >= size").take(1)
        if bad:
            raise IndexError(f"no such row: {bad[0]}")
        new = offsets.select(F.col("fragment").alias("__fragment"), F.col("offset").alias("__offset"))
        return self._commit(self.spark, self.path, self._with_deletions(new))

    def _with_deletions(self, new: DataFrame) -> dict:
        touched = {r[0] for r in new.select("__fragment").distinct().collect()}
        old = [f"{self.path}/{f['deletions']}" for f in self.manifest["fragments"] if f["id"] in touched and f["deletions"]]
        every = new.unionByName(self.spark.read.parquet(*old)) if old else new
        folder = f"_deletions/{uuid.uuid4().hex}"
        every.filter(F.col("__fragment").isin(list(touched))).distinct().withColumn("of", F.col("__fragment")).write.partitionBy("of").parquet(f"{self.path}/{folder}")
        counts = {r["__fragment"]: r["n"] for r in self.spark.read.parquet(f"{self.path}/{folder}").groupBy("__fragment").agg(F.count("*").alias("n")).collect()}
        out = [f | {"deleted": counts[f["id"]], "deletions": f"{folder}/of={f['id']}"} if f["id"] in counts else f for f in self.manifest["fragments"]]
        return self.manifest | {"fragments": [f for f in out if f["deleted"] < f["rows"]]}

    def delete(self, predicate: E.Predicate) -> FragmentDataset:
        hit = self._scan(self.manifest["fragments"]).filter(E.to_column(predicate, self.schema)).select("__fragment", "__offset")
        return self._commit(self.spark, self.path, self._with_deletions(hit)) if hit.take(1) else self

    def update(self, predicate: E.Predicate, assignments: dict[str, E.Expression]) -> tuple[int, FragmentDataset]:
        """Matching rows move, changed, to new fragments; every expression sees the old row; one version."""
        hit = self._scan(self.manifest["fragments"]).filter(E.to_column(predicate, self.schema))
        n = hit.count()
        if not n:
            return 0, self
        new = hit.select(*((E.to_column(assignments[f.name], self.schema) if f.name in assignments else F.col(E.quoted(f.name))).cast(f.dataType).alias(f.name) for f in self.schema.fields))
        return n, self._commit(self.spark, self.path, self._with_deletions(hit.select("__fragment", "__offset")), new=new)

    def compact(self) -> FragmentDataset:
        """Rows of the fragments with deletions, as new fragments."""
        old = [f for f in self.manifest["fragments"] if f["deletions"]]
        if not old:
            return self
        gone = {f["id"] for f in old}
        rest = self.manifest | {"fragments": [f for f in self.manifest["fragments"] if f["id"] not in gone]}
        return self._commit(self.spark, self.path, rest, new=self._scan(old).drop("__fragment", "__offset"))

    def vacuum(self, retain: int = 1, dry_run: bool = False) -> list[str]:
        """Delete versions but the last `retain`, and files that none of these names."""
        if retain < 1:
            raise ValueError("one version at least")
        kept = self.versions()[-retain:]
        used = set()
        for v in kept:
            m = self._manifest(v)
            used |= {f["file"] for f in m["fragments"]} | {f["deletions"] for f in m["fragments"] if f["deletions"]} | {i["path"] for i in m["indices"]}
        old = [n for n, _, _ in self.store.list("", deep=True) if not n.startswith("_versions/") and n not in used and not any(n.startswith(u + "/") for u in used)]
        old += [f"_versions/{v}.manifest" for v in self.versions() if v not in kept]
        if not dry_run:
            for n in old:
                self.store.delete(n)
        return old

    # -- indices

    def create_index(self, column: str, kind: str = "btree") -> FragmentDataset:
        """btree: (value, fragment, offset) in ranges of value, for equality and ranges; bitmap: (value, fragments), for equality."""
        E.field_type(self.schema, column)
        rows = self._scan(self.manifest["fragments"], False).select(F.col(E.quoted(column)).alias("value"), F.col("__fragment").alias("fragment"), F.col("__offset").alias("offset")).filter("value is not null")
        folder = f"_indices/{uuid.uuid4().hex}"
        if kind == "btree":
            rows.repartitionByRange("value").sortWithinPartitions("value").write.parquet(f"{self.path}/{folder}")
        elif kind == "bitmap":
            rows.groupBy("value").agg(F.collect_set("fragment").alias("fragments")).write.parquet(f"{self.path}/{folder}")
        else:
            raise ValueError(kind)
        index = {"column": column, "kind": kind, "path": folder, "fragments": [f["id"] for f in self.manifest["fragments"]]}
        others = [i for i in self.manifest["indices"] if (i["column"], i["kind"]) != (column, kind)]
        return self._commit(self.spark, self.path, self.manifest | {"indices": [*others, index]})

    def indices(self) -> list[dict]:
        return self.manifest["indices"]

    def lookup(self, index: dict, p: E.Predicate) -> DataFrame | None:
        """(fragment) by an index for a comparison or membership of its column; None if it can't tell."""
        rows = self.spark.read.parquet(f"{self.path}/{index['path']}")
        as_value = lambda x: E.Ref("value") if isinstance(x, E.Ref) else x
        if isinstance(p, E.Compare):
            if p.op == "<>" or any(isinstance(x, E.Lit) and x.value is None for x in (p.left, p.right)) or index["kind"] == "bitmap" and p.op not in ("=", "<=>"):
                return None
            p = E.Compare(p.op, as_value(p.left), as_value(p.right))
        elif isinstance(p, E.Member) and not p.negated and None not in p.values:
            p = E.Member(E.Ref("value"), p.values)
        else:
            return None
        hit = E.where(rows, p)
        return hit.select(F.explode("fragments").alias("fragment")).distinct() if index["kind"] == "bitmap" else hit.select("fragment").distinct()

    def candidates(self, p: E.Predicate) -> set[int] | None:
        """Ids of fragments that may hold matching rows; None: all. AND intersects, OR unites; a part no index knows leaves all."""
        if isinstance(p, E.Junction):
            parts = [self.candidates(x) for x in p.parts]
            if p.op == "and":
                known = [x for x in parts if x is not None]
                return set.intersection(*known) if known else None
            return None if None in parts else set().union(*parts)
        columns = E.references(p)
        if not isinstance(p, (E.Compare, E.Member)) or len(columns) != 1 or any(isinstance(x, E.Expression) and not isinstance(x, (E.Ref, E.Lit)) for x in vars(p).values()):
            return None
        for index in self.indices():
            if columns == {index["column"]} and (found := self.lookup(index, p)) is not None:
                later = {f["id"] for f in self.manifest["fragments"]} - set(index["fragments"])
                return {r[0] for r in found.collect()} | later  # numbers of fragments
        return None
