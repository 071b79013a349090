"""Shared plumbing of the training-data operators: shapes of inputs; tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import materialize, shared_dir

__all__ = ["doc_text", "materialize", "partitions_for", "read", "shared_dir"]


def doc_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, so no other column can clash with ours."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def partitions_for(n_bytes: int, each: int) -> int:
    return max(1, -(-n_bytes // each))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
