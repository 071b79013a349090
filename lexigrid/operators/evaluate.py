"""Ranking quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ndcg(ranked: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg) for every query with judgements.

    ``ranked`` has (query_id, doc_id, rank from 1), ``judged`` (query_id, doc_id, relevance).
    A query whose judgements are all 0 has 0.
    """
    gain = F.col("relevance") / F.log2(F.col("rank") + 1)
    got = ranked.filter(F.col("rank") <= k).join(judged, ["query_id", "doc_id"]).groupBy("query_id").agg(F.sum(gain).alias("dcg"))
    best = Window.partitionBy("query_id").orderBy(F.desc("relevance"))
    ideal = judged.select("query_id", "relevance", F.row_number().over(best).alias("rank")).filter(F.col("rank") <= k).groupBy("query_id").agg(F.sum(gain).alias("idcg"))
    return ideal.join(got, "query_id", "left").select("query_id", F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def mean_ndcg(ranked: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """One row: (queries, ndcg)."""
    return ndcg(ranked, judged, k).agg(F.count(F.lit(1)).alias("queries"), F.avg("ndcg").alias("ndcg"))
