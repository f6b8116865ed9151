"""Change feeds as streams, and writes that a restarted stream doesn't repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.versioned import VersionedTable


def write_once(stream: DataFrame, path: str, app_id: str) -> DataStreamWriter:
    """A writer that appends each micro-batch to a versioned table exactly once: the batch number goes into the commit."""

    def batch(df: DataFrame, number: int) -> None:
        VersionedTable(df.sparkSession, path).write(df, app_id=app_id, app_version=number)

    return stream.writeStream.foreachBatch(batch)


def follow_changes(spark: SparkSession, path: str, offsets: str, handle, app_id: str = "changes") -> int | None:
    """Hand the changes of versions not seen before to handle(df, first, last); the last version seen is kept in a versioned table at offsets.

    handle runs before the offset is kept, so a crash between them repeats a range of
    versions: handle should use the range as its own batch number. Returns the last version,
    or None if there was nothing new.
    """
    from pyspark.sql import types as T

    seen = VersionedTable.open_or_create(spark, offsets, T.StructType([T.StructField("app", T.StringType()), T.StructField("version", T.LongType())]))
    last = seen.snapshot().txns.get(app_id, -1)
    table = VersionedTable(spark, path)
    newest = table.versions()[-1]
    if newest <= last:
        return None
    handle(table.changes(last + 1, newest), last + 1, newest)
    seen.write(spark.createDataFrame([(app_id, newest)], "app string, version long"), app_id=app_id, app_version=newest)
    return newest


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Counts by key and tumbling window, rows later than the watermark left out; for streams and batches."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), *keys).agg(F.count("*").alias("n"))
