"""Session defaults."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}

_shipped: set[str] = set()


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, **more: str) -> SparkSession:
    """A single-machine session for tests and benchmarks; on a cluster bring your own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lexigrid")
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.ui.enabled": "false"} | more
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship_package(spark)


def ship_package(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package: from where the driver found it, and on a cluster from a copy sent to them."""
    root = str(Path(__file__).resolve().parents[1])
    if not spark.sparkContext.master.startswith("local") and spark.sparkContext.applicationId not in _shipped:
        base = Path(tempfile.mkdtemp(prefix="lexigrid-ship-")) / "lexigrid"
        spark.sparkContext.addPyFile(shutil.make_archive(str(base), "zip", root, "lexigrid"))
        _shipped.add(spark.sparkContext.applicationId)
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *have])
    return spark
