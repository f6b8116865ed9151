import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.operators.versioned import Conflict, VersionedTable, identity_field
from tidelake.plans import expressions as E

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("region", T.StringType()), T.StructField("v", T.DoubleType())])


def rows(spark, n, start=0):
    return spark.range(start, start + n).select("id", F.when(F.col("id") % 3 == 0, None).otherwise(F.concat(F.lit("r "), (F.col("id") % 3).cast("string"))).alias("region"), (F.col("id") * 1.5).alias("v"))


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.mark.parametrize("partition", [None, ["region"]])
def test_history(spark, tmp_path, partition):
    t = VersionedTable.create(spark, str(tmp_path / "a b"), SCHEMA, partition, {"delta.enableChangeDataFeed": "true"})
    t.write(rows(spark, 30))
    t.write(rows(spark, 10, 30))
    assert ids(t.read()) == list(range(40))
    assert t.delete(E.less("id", 5))[0] == 5
    assert t.delete(E.equal("id", 7))[0] == 1
    assert t.delete(E.less("id", 5)) == (0, 4)
    n, _ = t.update(E.is_null("region"), {"v": F.lit(-1.0)})
    assert n == len([i for i in range(40) if i % 3 == 0 and i >= 5])
    want = [i for i in range(40) if i >= 5 and i != 7]
    assert ids(t.read()) == want
    assert ids(t.read(predicate=E.is_null("region"))) == [i for i in want if i % 3 == 0]
    assert {r["v"] for r in t.read(predicate=E.is_null("region")).collect()} == {-1.0}
    assert t.compact() is not None
    assert ids(t.read()) == want
    assert ids(t.read(version=1)) == list(range(30))
    kinds = {(r["_change_type"], r["_commit_version"]): r["n"] for r in t.changes(1).groupBy("_change_type", "_commit_version").agg(F.count("*").alias("n")).collect()}
    assert kinds == {("insert", 1): 30, ("insert", 2): 10, ("delete", 3): 5, ("delete", 4): 1, ("update_preimage", 5): n, ("update_postimage", 5): n}
    assert t.vacuum(dry_run=True) == []
    gone = t.vacuum(retention_ms=-1)
    assert gone and ids(t.read()) == want


def test_skipping_reads_fewer_files(spark, tmp_path):
    t = VersionedTable.create(spark, str(tmp_path / "t"), SCHEMA)
    for i in range(3):
        t.write(rows(spark, 10, 10 * i).coalesce(1))
    assert len(t.plan(t.snapshot(), E.greater("id", 25))) == 1
    assert ids(t.read(predicate=E.greater("id", 25))) == [26, 27, 28, 29]


def test_race_and_idempotent_write(spark, tmp_path):
    t = VersionedTable.create(spark, str(tmp_path / "t"), SCHEMA)
    snap = t.snapshot()
    assert t.write(rows(spark, 3), app_id="job", app_version=1) == 1
    assert t.write(rows(spark, 3), app_id="job", app_version=1) is None
    with pytest.raises(Conflict):
        t.commit(snap, [], "UPDATE")
    assert t.commit(snap, [], "WRITE", appends=True) == 2


def test_checkpoint_replays(spark, tmp_path):
    t = VersionedTable.create(spark, str(tmp_path / "t"), SCHEMA, properties={"delta.checkpointInterval": "2"})
    for i in range(5):
        t.write(rows(spark, 2, 2 * i).coalesce(1))
    t.set_domain("mine", "x")
    t.set_domain("mine", None)
    assert t.domain("mine") is None
    assert t._checkpoints() == [2, 4, 6]
    assert ids(t.read()) == list(range(10))
    assert t.compact_log(1, 3).endswith("compacted.json")


def test_schema_changes(spark, tmp_path):
    t = VersionedTable.create(spark, str(tmp_path / "t"), T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())]), column_mapping="name")
    t.write(spark.createDataFrame([(1, "x")], "a int, b string"))
    t.rename_column("b", "c")
    t.widen_column("a", T.LongType())
    t.add_column("d", T.DateType())
    t.write(spark.createDataFrame([(1 << 40, "y", None)], "a long, c string, d date"))
    assert sorted(map(tuple, t.read().collect())) == [(1, "x", None), (1 << 40, "y", None)]
    assert t.type_changes("a") == [{"fromType": "int", "toType": "bigint"}]
    with pytest.raises(ValueError):
        t.widen_column("c", T.LongType())


def test_identity_and_row_ids(spark, tmp_path):
    schema = T.StructType([identity_field("k", 10, 5), T.StructField("s", T.StringType())])
    t = VersionedTable.create(spark, str(tmp_path / "t"), schema, properties={"delta.enableRowTracking": "true"})
    for _ in range(2):
        t.write(spark.range(7).repartition(3).select(F.col("id").cast("string").alias("s")))
    assert sorted(r["k"] for r in t.read().collect()) == [10 + 5 * i for i in range(14)]
    t.delete(E.equal("k", 10))
    assert sorted(r["row_id"] for r in t.row_ids().collect()).__len__() == 13
    assert t.row_ids().select("row_id").distinct().count() == 13


def test_rows_keep_their_ids(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("p", T.IntegerType()), T.StructField("v", T.StringType())])
    tracked = {"delta.enableRowTracking": "true", "delta.enableChangeDataFeed": "true"}
    t = VersionedTable.create(spark, str(tmp_path / "t"), schema, ["p"], properties=tracked)
    rows = lambda a, b: spark.range(a, b).select(F.col("id").alias("k"), (F.col("id") % 2).cast("int").alias("p"), F.lit("x").alias("v"))
    ids = lambda: {r["k"]: (r["row_id"], r["row_commit_version"]) for r in t.row_ids().collect()}
    t.write(rows(0, 10).repartition(2))
    t.write(rows(10, 20).repartition(2))
    first = ids()
    assert sorted(i for i, _ in first.values()) == list(range(20))
    assert t.update(E.isin("k", [3, 12]), {"v": E.Lit("y")}) == (2, 3)
    assert ids() == first | {k: (first[k][0], 3) for k in (3, 12)}
    t.delete(E.equal("k", 4))
    t.compact()  # of two partitions, in one commit
    kept = {k: v for k, v in (first | {k: (first[k][0], 3) for k in (3, 12)}).items() if k != 4}
    assert ids() == kept
    t.update(E.equal("k", 5), {"v": F.lit(None).cast("string"), "p": E.Lit(0)})  # a row that was carried on before, to another partition
    assert ids() == kept | {5: (kept[5][0], 6)}
    t.write(rows(20, 23))
    assert {k: v for k, v in ids().items() if k < 20} == kept | {5: (kept[5][0], 6)}
    every = [i for i, _ in ids().values()]
    assert len(every) == len(set(every)) == 22
    bases = [f["baseRowId"] for f in t.snapshot().files.values()]
    assert len(bases) == len(set(bases))
    assert t.read().columns == ["k", "p", "v"] and t.read().count() == 22
    got = sorted((r["k"], r["_change_type"], r["v"]) for r in t.changes(3, 3).collect())
    assert got == [(k, f"update_{w}", v) for k in (3, 12) for w, v in (("postimage", "y"), ("preimage", "x"))]


def test_tracking_turned_on_later(spark, tmp_path):
    t = VersionedTable.create(spark, str(tmp_path / "t"), T.StructType([T.StructField("k", T.LongType())]))
    t.write(spark.range(4).toDF("k").coalesce(1))
    t.set_properties({"delta.enableRowTracking": "true"})
    t.write(spark.range(8).toDF("k").repartition(3).filter("k < 0"))
    assert [r["row_id"] for r in t.row_ids().collect()] == [None] * 4
    t.update(E.equal("k", 2), {"k": E.Lit(9)})
    assert sorted(r["row_id"] for r in t.row_ids().collect()) == [0, 1, 2, 3]


def test_a_wrong_mode_writes_nothing(spark, tmp_path):
    t = VersionedTable.create(spark, str(tmp_path / "t"), T.StructType([T.StructField("k", T.LongType())]))
    with pytest.raises(ValueError):
        t.write(spark.range(3).toDF("k"), mode="merge")
    assert not list((tmp_path / "t").glob("*.parquet"))
