"""An index that follows a stream of documents (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.analysis import Analyzer, default
from ..operators.index import Patch, SearchIndex
from ..sources.tables import exists


def write_patches(docs: DataFrame, index: SearchIndex, patch_url: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Each micro-batch becomes the patch of its number; a batch done again writes the same version.

    ``patch_url`` holds ``{version}``; readers follow with ``SearchIndex.sync``.
    """
    spark, state = index.spark, {"index": index}

    def url(version: int) -> str:
        return patch_url.replace("{version}", str(version))

    def add(batch: DataFrame, batch_id: int) -> None:
        now, version = state["index"], index.version + batch_id + 1
        while now.version < version - 1:  # after a restart
            now = now.apply_patch(Patch.read(spark, url(now.version + 1)))
        if not exists(spark, f"{url(version)}/description.json"):
            now.create_patch(batch).write(spark, url(version))
        state["index"] = now.apply_patch(Patch.read(spark, url(version))) if now.version < version else now

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def running_term_counts(docs: DataFrame, text: str, analyzer: Analyzer | None = None) -> DataFrame:
    """(term, n) over all of a stream so far, for complete or update mode."""
    analyzer = analyzer or default()
    terms = analyzer.terms(analyzer.tokenize(F.col(text)))
    return docs.select(F.explode(terms).alias("term")).filter("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def windowed_term_counts(docs: DataFrame, text: str, time: str, window: str = "1 hour", late: str = "1 hour", analyzer: Analyzer | None = None) -> DataFrame:
    """(window, term, n) by event time; rows later than ``late`` are dropped."""
    analyzer = analyzer or default()
    terms = analyzer.terms(analyzer.tokenize(F.col(text)))
    rows = docs.withWatermark(time, late).select(F.col(time).alias("at"), F.explode(terms).alias("term")).filter("term <> ''")
    return rows.groupBy(F.window("at", window), "term").agg(F.count(F.lit(1)).alias("n"))
