"""Session helpers: sensible defaults, and shipping this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent

#: Settings that the library relies on or that suit any size; partition counts stay with the cluster.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
}


def session(app: str = "tidelake", **conf: str) -> SparkSession:
    """A session with DEFAULTS; keyword arguments use __ for dots."""
    builder = SparkSession.builder.appName(app)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers; once for each Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_tidelake_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="tidelake-ship-")
    path = os.path.join(folder, "tidelake.zip")
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted(ROOT.rglob("*.py")):
            z.write(file, str(Path("tidelake") / file.relative_to(ROOT)))
    sc.addPyFile(path)
    sc._tidelake_shipped = True
