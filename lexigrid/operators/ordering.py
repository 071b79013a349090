"""Places in a total order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialize


def dense_ids(df: DataFrame, order_by: list[str | Column] | None, start: int = 0, name: str = "internal_id") -> DataFrame:
    """``df`` with ``name``: start, start + 1, ... in the given order, else in the order read.

    Rows are written sorted by range; a count for each partition then gives its first
    place.
    """
    placed = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by) if order_by else df
    # the partition is in the high bits, the row within it in the low 33
    placed = materialize(placed.withColumn("_place", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_place", 33)
    counts = sorted(placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    firsts, at = [], start
    for part_no, n in counts:
        firsts.append((part_no, at))
        at += n
    first = df.sparkSession.createDataFrame(firsts, "_part long, _first long")
    joined = placed.withColumn("_part", part).join(F.broadcast(first), "_part")  # a row for each partition
    return joined.withColumn(name, F.col("_first") + F.col("_place").bitwiseAND((1 << 33) - 1)).drop("_part", "_first", "_place")
