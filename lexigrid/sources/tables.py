"""Tables in the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where a local session leaves it unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that every executor reaches")
        found = "file://" + tempfile.mkdtemp(prefix="lexigrid-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, until the driver's Python ends.

    Its plan runs once, its lineage ends there, and it survives the loss of any executor.
    """
    path = f"{shared_dir(df.sparkSession)}/lexigrid-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            delete(spark, path)
        except Exception:  # the session may be gone; the files are only temporary
            pass
    _written.clear()


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of any URI that Spark reaches."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    system, at = hadoop_path(spark, path)
    return system.exists(at)


def byte_size(spark: SparkSession, path: str) -> int:
    system, at = hadoop_path(spark, path)
    return system.getContentSummary(at).getLength() if system.exists(at) else 0


def delete(spark: SparkSession, path: str) -> bool:
    system, at = hadoop_path(spark, path)
    return system.delete(at, True)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, such as an index's description."""
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    system, at = hadoop_path(spark, path)
    out = system.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()
