import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidelake.functions import bitmaps, transforms
from tidelake.plans import expressions as E
from tidelake.plans import skipping


def random_predicate(rng, depth=2):
    if depth and rng.random() < 0.6:
        parts = [random_predicate(rng, depth - 1) for _ in range(2)]
        return rng.choice([E.And, E.Or])(*parts) if rng.random() < 0.8 else E.Not(parts[0])
    c = rng.choice(["i", "d", "s"])
    v = {"i": lambda: rng.randint(-2, 42), "d": lambda: rng.choice([rng.uniform(-1, 22), float("nan")]), "s": lambda: f"k{rng.randint(0, 45):02d}"}[c]
    op = rng.choice([E.equal, E.not_equal, E.less, E.less_equal, E.greater, E.greater_equal, E.null_safe_equal])
    return rng.choice([
        lambda: op(c, v()), lambda: E.isin(c, [v(), v()]), lambda: E.not_in(c, [v()]), lambda: E.is_null(c), lambda: E.not_null(c),
        lambda: E.starts_with("s", "k1"), lambda: E.not_starts_with("s", "k1"), lambda: E.isin(c, [v(), None]), lambda: E.is_nan("d"), lambda: E.null_safe_equal(c, None),
    ])()


def test_skipping_is_sound(spark, tmp_path):
    df = spark.range(40).select(
        F.when(F.col("id") % 7 != 0, F.col("id").cast("int")).alias("i"),
        F.when(F.col("id") == 13, F.lit(float("nan"))).when((F.col("id") < 8) | (F.col("id") > 11), F.col("id") / 2).alias("d"),
        F.format_string("k%02d", F.col("id")).alias("s"),
    )
    df.repartitionByRange(8, "s").write.parquet(str(tmp_path / "f"))
    data = spark.read.parquet(str(tmp_path / "f"))
    stats = skipping.file_statistics(data).checkpoint() if spark.sparkContext.getCheckpointDir() else skipping.file_statistics(data).persist()
    rng = random.Random(5)
    cases = [random_predicate(rng) for _ in range(60)]
    marks = stats.select("file", *(skipping.may_match(p, data.schema).alias(f"p{k}") for k, p in enumerate(cases))).collect()
    hits = data.groupBy(F.col("_metadata.file_path").alias("file")).agg(*(F.count_if(E.to_column(p, data.schema)).alias(f"p{k}") for k, p in enumerate(cases))).collect()
    may = {r["file"]: r for r in marks}
    skipped = 0
    for r in hits:
        for k, p in enumerate(cases):
            assert may[r["file"]][f"p{k}"] or not r[f"p{k}"], (p, r["file"])
            skipped += not may[r["file"]][f"p{k}"]
    assert skipped > 60


def test_three_valued_logic(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (None, None, float("nan")), (3, "b", None)], "x int, s string, d double")

    def value(p):
        return [r[0] for r in df.select(E.to_column(p, df.schema)).collect()]

    assert value(E.isin("x", [])) == [False, None, False]
    assert value(E.not_in("x", [1, None])) == [False, None, None]
    assert value(E.not_nan("d")) == [True, False, None]
    assert value(E.is_nan("d")) == [False, True, False]
    assert value(E.equal("x", "a")) == [None, None, None]
    assert value(E.null_safe_equal("x", None)) == [False, True, False]
    assert value(E.call("upper", "s")) == ["A", None, "B"]
    with pytest.raises(E.UnresolvedColumn):
        value(E.equal("nope", 1))
    assert E.bind(E.equal("nope", 1), df.schema, lenient=True) == E.equal("nope", 1)
    assert E.And(E.TRUE, E.FALSE) == E.FALSE and E.Not(E.Not(E.is_null("x"))) == E.is_null("x")


@pytest.mark.parametrize("n", [0, 1, 5000, 70000])
def test_bitmaps(n):
    import numpy as np

    rows = np.unique(np.random.default_rng(n).integers(0, 200000, n).astype(np.uint64) + np.uint64(3 << 32))
    data = bitmaps.to_bytes(rows)
    assert (bitmaps.from_bytes(data) == rows).all()
    assert bitmaps.from_base85(bitmaps.base85(data), len(data)) == data


def test_bucket_hash_has_the_published_values():
    import datetime as dt
    import decimal

    for v, want in ((34, 2017239379), (dt.date(2017, 11, 16), -653330422), ("iceberg", 1210000089), (b"\0\1\2\3", -188683207), (decimal.Decimal("14.20"), -500754589)):
        assert transforms.murmur3(transforms.bucket_bytes(v)) == want


def test_fingerprint_of_a_primitive():
    assert int.from_bytes(transforms.fingerprint("null"), "little") == 0x63DD24E7CC258F8A
    assert transforms.canonical_schema({"type": "record", "name": "A", "namespace": "n", "doc": "x", "fields": [{"name": "f", "type": {"type": "int"}}]}) == '{"name":"n.A","type":"record","fields":[{"name":"f","type":"int"}]}'
