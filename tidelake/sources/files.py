"""Parquet and ORC through Spark's own sources, with footers as tables and row groups by number."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import expressions as E


def read_parquet(spark: SparkSession, paths, columns: list[str] | None = None, predicate: E.Predicate | None = None, verify_checksums: bool = False) -> DataFrame:
    """A scan; the predicate and the columns reach the files through Catalyst (row groups, page index, bloom filters)."""
    reader = spark.read.option("parquet.page.verify-checksum.enabled", str(verify_checksums).lower())
    df = reader.parquet(*([paths] if isinstance(paths, str) else paths))
    df = E.where(df, predicate) if predicate is not None else df
    return E.project(df, columns) if columns is not None else df


def read_orc(spark: SparkSession, paths, columns: list[str] | None = None, predicate: E.Predicate | None = None) -> DataFrame:
    df = spark.read.orc(paths)
    df = E.where(df, predicate) if predicate is not None else df
    return E.project(df, columns) if columns is not None else df


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", codec: str = "snappy", row_group_rows: int = 1_000_000, row_group_bytes: int = 128 << 20,
                  page_bytes: int = 1 << 20, v2_pages: bool = True, bloom: dict[str, int] | None = None, bloom_fpp: float = 0.05, partition_by: list[str] | None = None) -> None:
    """bloom: columns with a bloom filter and the distinct values each is sized for."""
    w = df.write.mode(mode).option("compression", codec).option("parquet.block.size", row_group_bytes).option("parquet.block.row.count.limit", row_group_rows)
    w = w.option("parquet.page.size", page_bytes).option("parquet.writer.version", "v2" if v2_pages else "v1").option("parquet.page.write-checksum.enabled", "true")
    for c, n in (bloom or {}).items():
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", n).option(f"parquet.bloom.filter.fpp#{c}", bloom_fpp)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_orc(df: DataFrame, path: str, mode: str = "errorifexists", codec: str = "zstd", stripe_bytes: int = 64 << 20, stride: int = 10_000, bloom: list[str] | None = None, fpp: float = 0.05) -> None:
    w = df.write.mode(mode).option("compression", codec).option("orc.stripe.size", stripe_bytes).option("orc.row.index.stride", stride)
    if bloom:
        w = w.option("orc.bloom.filter.columns", ",".join(bloom)).option("orc.bloom.filter.fpp", fpp)
    w.orc(path)


_FOOTER = "file string, row_group int, first_row long, num_rows long, total_bytes long, column string, min string, max string, nulls long, codec string, compressed long"


def parquet_footers(spark: SparkSession, paths) -> DataFrame:
    """A row for each column chunk of each file. Tasks parse the footers of files that Spark hands them."""

    def run(batches: Iterator):
        import io

        import pandas as pd
        import pyarrow.parquet as pq

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                meta, first = pq.ParquetFile(io.BytesIO(bytes(content))).metadata, 0
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    for c in range(group.num_columns):
                        chunk = group.column(c)
                        s = chunk.statistics
                        known = s is not None and s.has_min_max
                        rows.append((path, g, first, group.num_rows, group.total_byte_size, chunk.path_in_schema, str(s.min) if known else None, str(s.max) if known else None,
                                     s.null_count if s is not None and s.has_null_count else None, chunk.compression, chunk.total_compressed_size))
                    first += group.num_rows
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _FOOTER.split(", ")])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, _FOOTER)


def row_group(spark: SparkSession, path: str, number: int, columns: list[str] | None = None) -> DataFrame:
    """The rows of one row group of a file, by their places."""
    found = parquet_footers(spark, path).filter(F.col("row_group") == number).select("first_row", "num_rows").first()
    if found is None:
        raise IndexError(f"no row group {number}")
    df = spark.read.parquet(path)
    df = df.filter(F.col("_metadata.row_index").between(found[0], found[0] + found[1] - 1))
    return E.project(df, columns) if columns is not None else df


def bloom_candidates(spark: SparkSession, path: str, column: str, values: list) -> DataFrame:
    """(file) of the files that hold one of some values; Spark's reader drops row groups by bounds and bloom filters before reading."""
    return spark.read.parquet(path).filter(F.col(E.quoted(column)).isin(values)).select(F.col("_metadata.file_path").alias("file")).distinct()


def batches(df: DataFrame, rows: int = 10_000):
    """Arrow batches of at most so many rows, partition by partition."""
    for table in df.toLocalIterator(prefetchPartitions=True) if rows <= 0 else _arrow(df, rows):
        yield table


def _arrow(df: DataFrame, rows: int):
    import pyarrow as pa

    part: list = []
    for r in df.toLocalIterator(prefetchPartitions=True):
        part.append(r.asDict(recursive=True))
        if len(part) == rows:
            yield pa.Table.from_pylist(part)
            part = []
    if part:
        yield pa.Table.from_pylist(part)
