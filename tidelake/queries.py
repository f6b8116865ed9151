"""Registered queries over the star-schema tables, and the SQL that must give the same rows."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import transforms
from .operators import catalog
from .operators.fragments import FragmentDataset
from .operators.versioned import VersionedTable, identity_field
from .plans import expressions as E
from .plans import skipping
from .session import ship
from .sources import avro, files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workspace(spark: SparkSession) -> str:
    """A fresh folder that all executors share, for tables that a query makes."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="tidelake-")
    return f"{shared.rstrip('/')}/query-{uuid.uuid4().hex}"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue, count(*) AS n FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1994-01-01' AND l_shipdate < TIMESTAMP '1996-01-01' AND l_discount IN (0.05, 0.06, 0.07) AND l_quantity < 24""")
def filtered_revenue(spark, sf_dir):
    """The flagship: scan, filter by a predicate tree, project, aggregate."""
    import datetime as dt

    p = E.And(E.greater_equal("l_shipdate", dt.datetime(1994, 1, 1)), E.less("l_shipdate", dt.datetime(1996, 1, 1)), E.isin("l_discount", [0.05, 0.06, 0.07]), E.less("l_quantity", 24.0))
    df = E.where(table(spark, sf_dir, "lineitem"), p)
    return df.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT l_orderkey, l_partkey FROM lineitem")
def scan_project(spark, sf_dir):
    return E.project(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"])


def _filter(name: str, source: str, columns: list[str], predicate: E.Predicate, where: str, prepare: Callable[[DataFrame], DataFrame] | None = None, base: str | None = None) -> None:
    def run(spark, sf_dir):
        df = table(spark, sf_dir, source)
        return E.project(E.where(prepare(df) if prepare else df, predicate), columns)

    run.__name__ = name
    query(f"SELECT {', '.join(columns)} FROM {base or source} WHERE {where}")(run)


_L = ["l_orderkey", "l_linenumber", "l_quantity"]
for _name, _build, _op in (("eq", E.equal, "="), ("ne", E.not_equal, "<>"), ("lt", E.less, "<"), ("le", E.less_equal, "<="), ("gt", E.greater, ">"), ("ge", E.greater_equal, ">=")):
    _filter(f"filter_{_name}", "lineitem", _L, _build("l_quantity", 24.0), f"l_quantity {_op} 24")


def _nulled(df: DataFrame) -> DataFrame:
    return df.withColumn("event_type", F.nullif("event_type", F.lit("click"))).withColumn("value", F.when(F.col("value") > 50, F.lit(float("nan"))).otherwise(F.col("value")))


_EVENTS = "(SELECT event_id, nullif(event_type, 'click') AS event_type, CASE WHEN value > 50 THEN 'nan'::DOUBLE ELSE value END AS value FROM events)"
for _name, _p, _where in (
    ("filter_null_safe_eq", E.null_safe_equal("event_type", None), "event_type IS NOT DISTINCT FROM NULL"),
    ("filter_is_null", E.is_null("event_type"), "event_type IS NULL"),
    ("filter_is_not_null", E.not_null("event_type"), "event_type IS NOT NULL"),
    ("filter_is_nan", E.is_nan("value"), "isnan(value)"),
    ("filter_is_not_nan", E.not_nan("value"), "NOT isnan(value)"),
    ("filter_in", E.isin("event_type", ["view", "purchase"]), "event_type IN ('view', 'purchase')"),
    ("filter_not_in", E.not_in("event_type", ["view"]), "event_type NOT IN ('view')"),
    ("filter_in_with_null", E.isin("event_type", ["view", None]), "event_type IN ('view', NULL)"),
    ("filter_not_in_with_null", E.not_in("event_type", ["view", None]), "event_type NOT IN ('view', NULL)"),
    ("filter_empty_in", E.isin("event_type", []), "false"),
    ("filter_nan_order", E.greater("value", 20.0), "value > 20"),
    ("filter_and_or_not", E.Or(E.And(E.equal("event_type", "view"), E.less("value", 10.0)), E.Not(E.Or(E.is_null("event_type"), E.less("value", 40.0)))),
     "(event_type = 'view' AND value < 10) OR NOT (event_type IS NULL OR value < 40)"),
):
    _filter(_name, "events", ["event_id", "event_type"], _p, _where, _nulled, _EVENTS)
_filter("filter_starts_with", "part", ["p_partkey", "p_name"], E.starts_with("p_name", "r"), "starts_with(p_name, 'r')")
_filter("filter_not_starts_with", "part", ["p_partkey", "p_name"], E.not_starts_with("p_name", "r"), "NOT starts_with(p_name, 'r')")
_filter("col_vs_col", "lineitem", _L, E.Compare(">", E.Ref("l_tax"), E.Ref("l_discount")), "l_tax > l_discount")
_filter("function_call", "part", ["p_partkey"], E.Compare("=", E.call("substring", "p_type", E.Lit(1), E.Lit(3)), E.Lit("PRO")), "substring(p_type, 1, 3) = 'PRO'")
_filter("type_mismatch_is_null", "part", ["p_partkey"], E.Not(E.equal("p_size", "big")), "false")


@query("SELECT l_orderkey, l_linenumber, l_quantity < 10 AS small FROM lineitem")
def predicate_as_value(spark, sf_dir):
    return E.evaluate(table(spark, sf_dir, "lineitem"), small=E.less("l_quantity", 10.0)).select("l_orderkey", "l_linenumber", "small")


@query("SELECT min(l_quantity) AS min_q, max(l_quantity) AS max_q, count(*) - count(l_quantity) AS nulls_q, min(l_shipdate) AS min_d, max(l_shipdate) AS max_d, count(*) AS n FROM lineitem")
def file_stats(spark, sf_dir):
    s = skipping.file_statistics(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_shipdate"])
    return s.agg(F.min("stats.l_quantity.min").alias("min_q"), F.max("stats.l_quantity.max").alias("max_q"), F.sum("stats.l_quantity.nulls").alias("nulls_q"),
                 F.min("stats.l_shipdate.min").alias("min_d"), F.max("stats.l_shipdate.max").alias("max_d"), F.sum("num_records").alias("n"))


def _ranged(spark, sf_dir) -> str:
    path = workspace(spark)
    table(spark, sf_dir, "orders").repartitionByRange(8, "o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(path)
    return path


def _pruned(name: str, p: E.Predicate, where: str) -> None:
    def run(spark, sf_dir):
        path = _ranged(spark, sf_dir)
        data = spark.read.parquet(path)
        df, _, _ = skipping.pruned_scan(lambda paths: spark.read.schema(data.schema).parquet(*paths), skipping.file_statistics(data), p, data.schema)
        return (df if df is not None else data.limit(0)).select("o_orderkey", "o_custkey")

    run.__name__ = name
    query(f"SELECT o_orderkey, o_custkey FROM orders WHERE {where}")(run)


_pruned("pruned_scan_range", E.And(E.greater("o_orderkey", 100), E.less("o_orderkey", 900)), "o_orderkey > 100 AND o_orderkey < 900")
_pruned("pruned_scan_in", E.isin("o_orderkey", [1, 7, 10**9]), "o_orderkey IN (1, 7, 1000000000)")
_pruned("pruned_scan_starts_with", E.And(E.starts_with("o_orderpriority", "1"), E.less("o_orderkey", 500)), "starts_with(o_orderpriority, '1') AND o_orderkey < 500")
_pruned("pruned_scan_nothing", E.less("o_orderkey", -5), "false")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (5, 6, 7)")
def bloom_eq(spark, sf_dir):
    path = workspace(spark)
    orders = table(spark, sf_dir, "orders")
    files.write_parquet(orders, path, bloom={"o_orderkey": 100_000})
    return files.read_parquet(spark, path, ["o_orderkey", "o_custkey"], E.isin("o_orderkey", [5, 6, 7]))


_CUSTOMERS = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"


def _customers(spark, sf_dir, partition_by=None, properties=None, column_mapping="none") -> tuple[VersionedTable, DataFrame]:
    df = table(spark, sf_dir, "customer")
    t = VersionedTable.create(spark, workspace(spark), df.schema, partition_by, properties, column_mapping)
    return t, df


@query(f"SELECT {_CUSTOMERS} FROM customer WHERE c_mktsegment = 'BUILDING'")
def pruned_scan_partition(spark, sf_dir):
    t, df = _customers(spark, sf_dir, ["c_mktsegment"])
    t.write(df)
    return t.read(predicate=E.equal("c_mktsegment", "BUILDING"))


@query(f"SELECT {_CUSTOMERS.replace('c_mktsegment', chr(39) + chr(39) + ' AS c_mktsegment').replace(chr(39) * 2, 'nullif(c_mktsegment, ' + chr(39) + 'BUILDING' + chr(39) + ')')} FROM customer")
def partitioned_write_read(spark, sf_dir):
    t, df = _customers(spark, sf_dir, ["c_mktsegment"])
    t.write(df.withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING"))))
    return t.read()


@query(f"SELECT {_CUSTOMERS} FROM customer UNION ALL SELECT {_CUSTOMERS} FROM customer WHERE c_nationkey < 5")
def append_two(spark, sf_dir):
    t, df = _customers(spark, sf_dir)
    t.write(df)
    t.write(df.filter("c_nationkey < 5"))
    return t.read()


@query(f"SELECT {_CUSTOMERS} FROM customer WHERE c_nationkey < 5")
def overwrite(spark, sf_dir):
    t, df = _customers(spark, sf_dir)
    t.write(df)
    t.write(df.filter("c_nationkey < 5"), "overwrite")
    return t.read()


_KEPT = f"SELECT {_CUSTOMERS} FROM customer WHERE NOT coalesce(c_acctbal < 1000, false)"


@query(_KEPT)
def delete_where(spark, sf_dir):
    t, df = _customers(spark, sf_dir)
    t.write(df.repartition(4, "c_custkey"))
    t.delete(E.less("c_acctbal", 1000.0))
    return t.read()


@query(_KEPT)
def delete_then_compact(spark, sf_dir):
    t, df = _customers(spark, sf_dir, ["c_mktsegment"])
    t.write(df.repartition(4, "c_custkey"))
    t.delete(E.less("c_acctbal", 1000.0))
    t.compact()
    return t.read()


@query(f"SELECT {_CUSTOMERS.replace('c_acctbal', 'CASE WHEN c_nationkey = 3 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal')} FROM customer")
def update_set(spark, sf_dir):
    t, df = _customers(spark, sf_dir)
    t.write(df.repartition(4, "c_custkey"))
    t.update(E.equal("c_nationkey", 3), {"c_acctbal": F.col("c_acctbal") + 1})
    return t.read()


@query(f"SELECT {_CUSTOMERS} FROM customer")
def time_travel_version(spark, sf_dir):
    t, df = _customers(spark, sf_dir)
    v = t.write(df)
    t.delete(E.less("c_acctbal", 1000.0))
    return t.read(version=v)


@query(f"SELECT {_CUSTOMERS} FROM customer")
def time_travel_asof(spark, sf_dir):
    t, df = _customers(spark, sf_dir)
    at = t.snapshot(t.write(df)).timestamp
    t.delete(E.less("c_acctbal", 1000.0))
    return t.read(timestamp=at)


@query("""SELECT c_custkey, c_acctbal, 'insert' AS _change_type, 1::BIGINT AS _commit_version FROM customer
UNION ALL SELECT c_custkey, c_acctbal, 'delete', 2 FROM customer WHERE c_acctbal < 1000
UNION ALL SELECT c_custkey, c_acctbal, 'update_preimage', 3 FROM customer WHERE c_acctbal >= 1000 AND c_nationkey = 3
UNION ALL SELECT c_custkey, 0.0, 'update_postimage', 3 FROM customer WHERE c_acctbal >= 1000 AND c_nationkey = 3""")
def changes_feed(spark, sf_dir):
    t, df = _customers(spark, sf_dir, properties={"delta.enableChangeDataFeed": "true"})
    t.write(df)
    t.delete(E.less("c_acctbal", 1000.0))
    t.update(E.equal("c_nationkey", 3), {"c_acctbal": F.lit(0.0)})
    return t.changes(1).select("c_custkey", "c_acctbal", "_change_type", "_commit_version")


@query("""SELECT c_custkey, 'insert' AS _change_type FROM customer UNION ALL SELECT c_custkey, 'delete' FROM customer WHERE c_acctbal < 1000""")
def changes_without_files(spark, sf_dir):
    t, df = _customers(spark, sf_dir)
    t.write(df)
    t.delete(E.less("c_acctbal", 1000.0))
    return t.changes(1).select("c_custkey", "_change_type")


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part UNION ALL SELECT 10000000000, 10000000001")
def type_widening(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    t = VersionedTable.create(spark, workspace(spark), df.schema)
    t.write(df)
    t.widen_column("p_size", T.LongType())
    t.write(spark.createDataFrame([(10**10, 10**10 + 1)], "p_partkey long, p_size long"))
    return t.read()


@query("SELECT c_custkey AS id, c_name AS customer, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def column_mapping_rename(spark, sf_dir):
    t, df = _customers(spark, sf_dir, column_mapping="name")
    t.write(df.filter("c_custkey % 2 = 0"))
    t.rename_column("c_custkey", "id")
    t.rename_column("c_name", "customer")
    t.write(df.filter("c_custkey % 2 = 1").withColumnsRenamed({"c_custkey": "id", "c_name": "customer"}))
    return t.read()


@query("SELECT count(*) AS n, 100 AS low, 100 + 10 * (count(*) - 1) AS high, count(*) AS n_ids FROM customer")
def identity_generate(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_name")
    t = VersionedTable.create(spark, workspace(spark), T.StructType([identity_field("k", 100, 10), T.StructField("c_name", T.StringType())]))
    t.write(df.repartition(5))
    return t.read().agg(F.count("*").alias("n"), F.min("k").cast("int").alias("low"), F.max("k").alias("high"), F.countDistinct("k").alias("n_ids"))


@query("SELECT count(*) AS n, 0::BIGINT AS low, count(*) - 1 AS high, count(*) AS n_ids FROM customer")
def row_tracking(spark, sf_dir):
    t, df = _customers(spark, sf_dir, properties={"delta.enableRowTracking": "true"})
    t.write(df.repartition(5))
    return t.row_ids().agg(F.count("*").alias("n"), F.min("row_id").alias("low"), F.max("row_id").alias("high"), F.countDistinct("row_id").alias("n_ids"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'changed' ELSE c_name END AS c_name, true AS same_id, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS row_commit_version FROM customer")
def row_tracking_rewrites(spark, sf_dir):
    """Row ids after an update and a compaction, against those before."""
    t, df = _customers(spark, sf_dir, properties={"delta.enableRowTracking": "true"})
    t.write(df.repartition(5))
    before = t.row_ids().select("c_custkey", F.col("row_id").alias("was"))
    t.update(E.Compare("=", E.call("pmod", "c_custkey", E.Lit(3)), E.Lit(0)), {"c_name": E.Lit("changed")})
    t.compact()
    after = t.row_ids().join(before, "c_custkey")
    return after.select("c_custkey", "c_name", (F.col("row_id") == F.col("was")).alias("same_id"), "row_commit_version")


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total, grouping(c_nationkey)::INT AS g FROM customer GROUP BY ROLLUP (c_nationkey, c_mktsegment)")
def rollup_over_scan(spark, sf_dir):
    t, df = _customers(spark, sf_dir, ["c_mktsegment"])
    t.write(df)
    rolled = t.read(["c_nationkey", "c_mktsegment", "c_acctbal"]).rollup("c_nationkey", "c_mktsegment")
    return rolled.agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"), F.grouping("c_nationkey").cast("int").alias("g"))


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0 INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def set_operations(spark, sf_dir):
    t, df = _customers(spark, sf_dir)
    t.write(df)
    rich = t.read(["c_nationkey"], E.greater("c_acctbal", 0)).withColumnRenamed("c_nationkey", "k")
    return rich.intersect(table(spark, sf_dir, "supplier").select("s_nationkey")).subtract(table(spark, sf_dir, "nation").filter("n_regionkey = 1").select("n_nationkey"))


@query("""SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey
WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer) AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey AND o.o_orderstatus = 'P') GROUP BY c_custkey""")
def subquery_and_outer_join(spark, sf_dir):
    """A scalar subquery, an anti join and an outer join over versioned tables, as SQL."""
    t, df = _customers(spark, sf_dir)
    t.write(df)
    orders = table(spark, sf_dir, "orders")
    return spark.sql(
        """WITH above AS (SELECT c_custkey FROM {c} WHERE c_acctbal > (SELECT avg(c_acctbal) FROM {c})),
        quiet AS (SELECT c_custkey FROM above WHERE NOT EXISTS (SELECT 1 FROM {o} o WHERE o.o_custkey = c_custkey AND o.o_orderstatus = 'P'))
        SELECT c_custkey, count(o_orderkey) AS n_orders FROM quiet LEFT JOIN {o} ON o_custkey = c_custkey GROUP BY c_custkey""",
        c=t.read(), o=orders,
    )


@query("SELECT n_nationkey, n_name, 'x' AS newcol FROM nation")
def schema_evolution_default(spark, sf_dir):
    df = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    schema = avro.avro_schema(df.schema)
    path = workspace(spark)
    _write_avro(df, path)
    wider = schema | {"fields": [*schema["fields"], {"name": "newcol", "type": "string", "default": "x"}]}
    for f in wider["fields"]:
        f["type"] = f["type"] if f["name"] == "newcol" else ["null", f["type"]] if isinstance(f["type"], str) else f["type"]
    return avro.read_avro(spark, f"{path}/*.avro", reader=wider)


def _write_avro(df: DataFrame, path: str, codec: str = "deflate") -> None:
    df.sparkSession.dataSource.register(avro.AvroContainer)
    df.write.format("avro_container").option("codec", codec).mode("append").save(path.removeprefix("file://"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def avro_roundtrip(spark, sf_dir):
    path = workspace(spark)
    _write_avro(table(spark, sf_dir, "nation"), path)
    return avro.read_avro(spark, f"{path}/*.avro")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def avro_messages(spark, sf_dir):
    df = table(spark, sf_dir, "nation")
    schema = avro.avro_schema(df.schema, nullable=False)
    store = avro.SchemaStore()
    store.register(schema)
    sent = df.select(avro.encode_messages(F.struct(*df.columns), schema).alias("m"))
    return sent.select(avro.decode_messages(F.col("m"), schema, store).alias("v")).select("v.*")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def orc_roundtrip(spark, sf_dir):
    path = workspace(spark)
    files.write_orc(table(spark, sf_dir, "orders"), path, bloom=["o_orderkey"])
    return files.read_orc(spark, path)


@query("SELECT o_orderkey, o_custkey FROM orders")
def row_groups(spark, sf_dir):
    path = workspace(spark)
    orders = table(spark, sf_dir, "orders")
    files.write_parquet(orders.repartition(3), path, row_group_rows=5000)
    spans = files.parquet_footers(spark, f"{path}/*.parquet").select(F.regexp_extract("file", "[^/]+$", 0).alias("file"), "row_group", "first_row", "num_rows").distinct()
    rows = spark.read.parquet(path).select("o_orderkey", "o_custkey", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    return rows.join(spans, "file").filter(F.col("at").between(F.col("first_row"), F.col("first_row") + F.col("num_rows") - 1)).select("o_orderkey", "o_custkey")


@query("""SELECT o_orderkey, year(o_orderdate) - 1970 AS y, (year(o_orderdate) - 1970) * 12 + month(o_orderdate) - 1 AS m, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS d,
CAST(floor(epoch(o_orderdate) / 3600) AS INT) AS h, o_custkey - (o_custkey % 100) AS t, substr(o_orderpriority, 1, 2) AS p FROM orders""")
def transform_time_truncate(spark, sf_dir):
    df, c = table(spark, sf_dir, "orders"), F.col("o_orderdate")
    return df.select("o_orderkey", transforms.year(c).alias("y"), transforms.month(c).alias("m"), transforms.day(c).alias("d"), transforms.hour(c).alias("h"),
                     transforms.truncate(F.col("o_custkey"), 100, T.LongType()).alias("t"), transforms.truncate(F.col("o_orderpriority"), 2, T.StringType()).alias("p"))


def _murmur3(value: str, rows: str) -> str:
    """SQL for the 32-bit hash (seed 0) of a whole number's 8 little-endian bytes: rows with a column h."""
    low = "4294967295"
    steps, k = [f"SELECT *, 0::UBIGINT AS h, (({value})::HUGEINT & {low})::UBIGINT AS a, ((({value})::HUGEINT >> 32) & {low})::UBIGINT AS b FROM {rows}"], 0
    for word in ("a", "b"):
        steps.append(f"SELECT * REPLACE ({word} * 3432918353 & {low} AS {word}) FROM s{k}")
        steps.append(f"SELECT * REPLACE ((({word} << 15 & {low}) | ({word} >> 17)) * 461845907 & {low} AS {word}) FROM s{k + 1}")
        steps.append(f"SELECT * REPLACE (xor(h, {word}) AS h) FROM s{k + 2}")
        steps.append(f"SELECT * REPLACE (((h << 13 & {low}) | (h >> 19)) * 5 + 3864292196 & {low} AS h) FROM s{k + 3}")
        k += 4
    steps.append(f"SELECT * REPLACE (xor(h, 8) AS h) FROM s{k}")
    for i, (shift, factor) in enumerate(((16, 2246822507), (13, 3266489909), (16, 1)), k + 1):
        steps.append(f"SELECT * REPLACE (xor(h, h >> {shift}) * {factor} & {low} AS h) FROM s{i}")
    return "WITH " + ", ".join(f"s{i} AS ({s})" for i, s in enumerate(steps)) + f" SELECT * FROM s{len(steps) - 1}"


@query(f"SELECT o_orderkey, ((h & 2147483647) % 16)::INT AS bucket FROM ({_murmur3('o_orderkey', 'orders')})")
def transform_bucket(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", transforms.bucket(F.col("o_orderkey"), 16).alias("bucket"))


def _indexed(name: str, kind: str, p: E.Predicate, where: str) -> None:
    def run(spark, sf_dir):
        df = table(spark, sf_dir, "events").select("event_id", "user_id")
        path = workspace(spark)
        ds = FragmentDataset.create(spark, df.filter("event_id < 200"), path).append(df.filter("event_id >= 200"))
        return ds.create_index("event_id", kind).read(predicate=p)

    run.__name__ = name
    query(f"SELECT event_id, user_id FROM events WHERE {where}")(run)


_indexed("index_eq", "bitmap", E.equal("event_id", 77), "event_id = 77")
_indexed("index_range", "btree", E.And(E.greater_equal("event_id", 190), E.less("event_id", 195)), "event_id >= 190 AND event_id < 195")
_indexed("index_in", "btree", E.isin("event_id", [3, 400]), "event_id IN (3, 400)")


@query("SELECT event_id, CASE WHEN user_id = 5 THEN -1 ELSE user_id END AS user_id FROM events WHERE event_id >= 100")
def fragment_update_delete(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "user_id")
    ds = FragmentDataset.create(spark, df, workspace(spark)).delete(E.less("event_id", 100))
    return ds.update(E.equal("user_id", 5), {"user_id": E.Lit(-1)})[1].compact().read()


def _snapshots(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "user_id")
    meta = catalog.new_metadata(workspace(spark), df.schema)
    one = meta.append(catalog.write_data(spark, meta, df.filter("event_id % 2 = 0")), now=1000)
    two = one.append(catalog.write_data(spark, one, df.filter("event_id % 2 = 1")), now=2000)
    return one, two


@query("SELECT event_id, user_id FROM events WHERE user_id > 10")
def snapshot_scan(spark, sf_dir):
    return catalog.Scan(spark, _snapshots(spark, sf_dir)[1], predicate=E.greater("user_id", 10)).rows()


@query("SELECT event_id, user_id FROM events WHERE event_id % 2 = 0")
def snapshot_travel(spark, sf_dir):
    _, two = _snapshots(spark, sf_dir)
    return catalog.Scan(spark, two, two.as_of(1500).id).rows()


@query("SELECT event_id, user_id FROM events WHERE event_id % 2 = 0 AND user_id <> 7")
def snapshot_branch_deletes(spark, sf_dir):
    one, _ = _snapshots(spark, sf_dir)
    path = f"{one.location}/gone"
    spark.createDataFrame([(7,)], "user_id long").write.parquet(path)
    return catalog.Scan(spark, one.delete_files([{"path": path, "content": "equality", "columns": ["user_id"]}])).rows()


@query("""SELECT o_orderpriority, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE o_orderkey < 2000 GROUP BY o_orderpriority""")
def join_pruned_scan(spark, sf_dir):
    path = _ranged(spark, sf_dir)
    data = spark.read.parquet(path)
    df, _, _ = skipping.pruned_scan(lambda paths: spark.read.schema(data.schema).parquet(*paths), skipping.file_statistics(data), E.less("o_orderkey", 2000), data.schema)
    joined = table(spark, sf_dir, "lineitem").join(df, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer WHERE NOT coalesce(c_acctbal < 1000, false) GROUP BY c_nationkey")
def agg_over_snapshot(spark, sf_dir):
    return delete_where(spark, sf_dir).groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("""SELECT c_custkey, _change_type, row_number() OVER (PARTITION BY c_custkey ORDER BY _change_type) AS nth FROM
(SELECT c_custkey, 'insert' AS _change_type FROM customer UNION ALL SELECT c_custkey, 'delete' FROM customer WHERE c_acctbal < 1000)""")
def window_over_changes(spark, sf_dir):
    w = Window.partitionBy("c_custkey").orderBy("_change_type")
    return changes_without_files(spark, sf_dir).withColumn("nth", F.row_number().over(w).cast("long"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topk_over_scan(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(20)


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark, sf_dir):
    from .streaming.feed import windowed_counts as counts

    df = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return counts(df, "ts", ["event_type"], "1 hour", "10 minutes").select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n")
