import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.plans import expressions as E
from tidelake.sources import avro, files


@pytest.mark.parametrize("codec", ["null", "deflate", "snappy", "zstandard"])
def test_container_round_trip(spark, tmp_path, codec):
    spark.dataSource.register(avro.AvroContainer)
    df = spark.range(50).select(
        "id", F.when(F.col("id") % 5 != 0, F.col("id").cast("string")).alias("s"), (F.col("id") / 3).alias("d"), F.array("id", F.lit(None).cast("long")).alias("a"),
        F.create_map(F.lit("k"), "id").alias("m"), F.struct(F.col("id").cast("int").alias("x")).alias("r"), F.lit("1.25").cast("decimal(5,2)").alias("c"),
        F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("day"),
    )
    df.write.format("avro_container").option("codec", codec).mode("append").save(str(tmp_path / "a"))
    want = sorted(map(str, df.collect()))
    assert sorted(map(str, spark.read.format("avro_container").load(str(tmp_path / "a")).collect())) == want
    assert sorted(map(str, avro.read_avro(spark, str(tmp_path / "a" / "*.avro")).collect())) == want


def test_resolution():
    old = {"type": "record", "name": "R", "fields": [{"name": "a", "type": "int"}, {"name": "e", "type": {"type": "enum", "name": "E", "symbols": ["X", "Y"]}}]}
    new = {"type": "record", "name": "R", "fields": [{"name": "b", "aliases": ["a"], "type": "double"}, {"name": "e", "type": {"type": "enum", "name": "E", "symbols": ["X", "Z"], "default": "Z"}}, {"name": "n", "type": "string", "default": "d"}]}
    data = avro.write_container([{"a": 1, "e": "X"}, {"a": 2, "e": "Y"}], old)
    assert list(avro.read_container(data, new)) == [{"b": 1.0, "e": "X", "n": "d"}, {"b": 2.0, "e": "Z", "n": "d"}]
    with pytest.raises(avro.AvroError):
        list(avro.read_container(data, {"type": "record", "name": "R", "fields": [{"name": "z", "type": "int"}]}))
    with pytest.raises(avro.AvroError):
        list(avro.read_container(data[:-3]))


@pytest.mark.parametrize("frame,key", [("single_object", None), ("id4", 7), ("id8", 9), ("raw", None)])
def test_messages(spark, frame, key):
    schema = {"type": "record", "name": "M", "fields": [{"name": "id", "type": "long"}, {"name": "s", "type": ["null", "string"]}]}
    store = avro.SchemaStore()
    store.register(schema)
    if key is not None:
        store.set(key, schema)
    df = spark.createDataFrame([(1, "x"), (2, None)], "id long, s string").select(F.struct("id", "s").alias("v"))
    out = df.select(avro.encode_messages(F.col("v"), schema, frame, key).alias("m")).select(avro.decode_messages(F.col("m"), schema, store, frame).alias("v")).select("v.*")
    assert sorted(map(tuple, out.collect())) == [(1, "x"), (2, None)]


def test_files(spark, tmp_path):
    df = spark.range(1000).select("id", (F.col("id") % 10).cast("string").alias("k")).coalesce(1).sortWithinPartitions("id")
    p = str(tmp_path / "p")
    files.write_parquet(df, p, row_group_rows=250, bloom={"k": 10})
    foot = files.parquet_footers(spark, p + "/*.parquet")
    assert foot.select("row_group").distinct().count() == 4
    one = [f for f in (tmp_path / "p").iterdir() if f.suffix == ".parquet"][0]
    assert [r["id"] for r in files.row_group(spark, str(one), 1, ["id"]).collect()] == list(range(250, 500))
    assert files.read_parquet(spark, p, ["id"], E.less("id", 5), verify_checksums=True).count() == 5
    assert files.bloom_candidates(spark, p, "k", ["3"]).count() == 1
    files.write_orc(df, str(tmp_path / "o"), bloom=["k"])
    assert files.read_orc(spark, str(tmp_path / "o"), ["k"], E.equal("k", "3")).count() == 100
    assert sum(b.num_rows for b in files.batches(df, 300)) == 1000
