import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.operators import catalog
from tidelake.operators.fragments import FragmentDataset
from tidelake.operators.versioned import VersionedTable
from tidelake.plans import expressions as E
from tidelake.streaming import feed


def test_fragments(spark, tmp_path):
    df = lambda a, b: spark.range(a, b).select(F.col("id").cast("int").alias("x"), F.lit("v").alias("s")).coalesce(1)
    ds = FragmentDataset.create(spark, df(0, 10), str(tmp_path / "d")).append(df(10, 20)).append(df(20, 30))
    assert ds.rows == 30 and ds.versions() == [1, 2, 3]
    ds = ds.create_index("x").create_index("x", "bitmap")
    p = E.And(E.greater("x", 12), E.less("x", 15))
    assert ds.candidates(p) == {1}
    assert ds.candidates(E.Or(E.equal("x", 3), E.isin("x", [25]))) == {0, 2}
    assert ds.candidates(E.Or(E.equal("x", 3), E.equal("s", "v"))) is None
    assert sorted(r["x"] for r in ds.read(predicate=p).collect()) == [13, 14]
    ds = ds.delete(E.less("x", 3))
    n, ds = ds.update(E.equal("x", 11), {"x": E.Lit(99)})
    assert n == 1 and ds.rows == 27
    assert sorted(r["x"] for r in ds.read(["x"]).collect()) == sorted([*range(3, 11), *range(12, 30), 99])
    assert [r["x"] for r in ds.read(predicate=E.equal("x", 99)).collect()] == [99]
    ds = ds.compact()
    assert ds.rows == 27 and all(f["deletions"] is None for f in ds.manifest["fragments"])
    with pytest.raises(IndexError):
        ds.delete_rows(spark.createDataFrame([(0, 999)], "fragment long, offset long"))
    assert FragmentDataset(spark, str(tmp_path / "d"), version=1).rows == 10
    assert ds.vacuum() and sorted(r["x"] for r in ds.read().collect())[:2] == [3, 4]


def test_snapshots(spark, tmp_path):
    cat = catalog.FileCatalog(spark, str(tmp_path / "c"))
    cat.create_namespace("n")
    meta = cat.create_table("n", "t", T.StructType([T.StructField("id", T.IntegerType(), False), T.StructField("s", T.StringType())]), str(tmp_path / "t"))
    rows = lambda a, b: spark.range(a, b).select(F.col("id").cast("int").alias("id"), F.lit("x").alias("s")).coalesce(1)
    one = cat.commit("n", "t", meta, meta.append(catalog.write_data(spark, meta, rows(0, 10)), now=1000))
    two = one.append(catalog.write_data(spark, one, rows(10, 20)), now=2000).set_tag("v2", 0 or one.current().id)
    assert catalog.Scan(spark, two, predicate=E.greater("id", 12)).plan()[0].__len__() == 1
    assert catalog.Scan(spark, two).rows().count() == 20
    assert two.as_of(1500).id == one.current().id and two.resolve("v2").id == one.current().id
    gone = spark.createDataFrame([(12,)], "id int")
    gone.write.parquet(str(tmp_path / "e"))
    three = two.delete_files([{"path": str(tmp_path / "e"), "content": "equality", "columns": ["id"]}], now=3000)
    assert catalog.Scan(spark, three).rows().count() == 19
    four = three.rename_column("s", "t").promote_column("id", T.LongType()).add_column("s", T.DateType())
    got = catalog.Scan(spark, four).rows()
    assert got.columns == ["id", "t", "s"] and got.filter("t = 'x' and s is null").count() == 19
    assert four.rollback(one.current().id).current().id == one.current().id
    branch = one.append(catalog.write_data(spark, one, rows(50, 55)), now=2500, branch="b")
    picked = branch.append(catalog.write_data(spark, one, rows(90, 91)), now=2600).cherry_pick(branch.refs["b"].snapshot, now=2700)
    assert catalog.Scan(spark, picked).rows().count() == 16
    assert branch.fast_forward("main", "b").current().id == branch.refs["b"].snapshot
    assert len(three.expire(older_than=2900).snapshots) == 2
    with pytest.raises(ValueError):
        two.set_tag("v2", one.current().id)
    assert catalog.FileCatalog(spark, str(tmp_path / "c")).load_table("n", "t") == one
    spec = four.add_partition("id", "bucket", 16).add_partition("t", "truncate", 1)
    assert rows(34, 35).withColumn("t", F.col("s")).select(F.col("id").cast("long").alias("id"), "t").withColumns(spec.partition_values()).first()["id_bucket"] == 2017239379 % 16


def test_streams(spark, tmp_path):
    rows = spark.range(20).select("id")
    for i in range(2):
        rows.filter(F.col("id") % 2 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    VersionedTable.create(spark, str(tmp_path / "t"), rows.schema)
    for _ in range(2):  # the second run has nothing new
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = feed.write_once(stream, str(tmp_path / "t"), "s").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120) or not q.isActive
    t = VersionedTable(spark, str(tmp_path / "t"))
    assert t.read().count() == 20
    seen = []
    assert feed.follow_changes(spark, str(tmp_path / "t"), str(tmp_path / "o"), lambda df, a, b: seen.append((a, b, df.count()))) == t.versions()[-1]
    assert feed.follow_changes(spark, str(tmp_path / "t"), str(tmp_path / "o"), None) is None
    assert seen[0][2] == 20


def test_a_lost_commit_leaves_the_catalog_as_it_is_stored(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.IntegerType())])
    one = catalog.FileCatalog(spark, str(tmp_path / "c"))
    one.create_namespace("n")
    meta = one.create_table("n", "t", schema, str(tmp_path / "t"))
    two = catalog.FileCatalog(spark, str(tmp_path / "c"))
    won = one.commit("n", "t", meta, meta.append([], now=1000))
    with pytest.raises(RuntimeError):
        two.commit("n", "t", meta, meta.append([], now=2000))
    assert two.load_table("n", "t") == won
    with pytest.raises(RuntimeError):
        two.commit("n", "t", meta, meta.append([], now=2000))
    again = two.commit("n", "t", won, won.append([], now=3000))
    assert catalog.FileCatalog(spark, str(tmp_path / "c")).load_table("n", "t") == again
    with pytest.raises(RuntimeError):
        one.drop_table("n", "t", purge=spark)
    assert one.load_table("n", "t") == again
