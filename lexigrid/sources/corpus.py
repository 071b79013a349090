"""Test collections in the BEIR layout: corpus.jsonl, queries.jsonl and qrels/<split>.tsv."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluate import mean_ndcg
from ..operators.index import SearchIndex


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(id, title, text)."""
    rows = spark.read.schema("_id string, title string, text string").json(f"{folder}/corpus.jsonl")
    return rows.select(F.col("_id").alias("id"), "title", "text")


def read_queries(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, text)."""
    rows = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl")
    return rows.select(F.col("_id").alias("query_id"), "text")


def read_judgements(spark: SparkSession, folder: str, split: str = "test") -> DataFrame:
    """(query_id, doc_id, relevance)."""
    rows = spark.read.csv(f"{folder}/qrels/{split}.tsv", sep="\t", header=True, schema="query_id string, corpus_id string, score int")
    return rows.select("query_id", F.col("corpus_id").alias("doc_id"), F.col("score").alias("relevance"))


def evaluate(index: SearchIndex, queries: DataFrame, judged: DataFrame, k: int = 10, fields: list[str] | None = None) -> DataFrame:
    """One row (queries, ndcg): all judged queries searched in one job."""
    asked = queries.join(judged.select("query_id").distinct(), "query_id", "left_semi")
    found = index.search_batch(asked, fields=fields, limit=k).select("query_id", F.col("id").alias("doc_id"), "rank")
    return mean_ndcg(found, judged, k)
