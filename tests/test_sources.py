import json

import pytest

from lexigrid.operators.index import SearchIndex
from lexigrid.plans.options import IndexOptions
from lexigrid.sources import corpus
from lexigrid.sources.storage import CatalogDriver


def test_collection_and_evaluation(spark, tmp_path):
    docs = [("d1", "Red foxes", "A fox ran."), ("d2", "Dogs", "The dog slept."), ("d3", "Foxes and dogs", "Both ran.")]
    (tmp_path / "corpus.jsonl").write_text("\n".join(json.dumps({"_id": i, "title": t, "text": x, "metadata": {}}) for i, t, x in docs))
    (tmp_path / "queries.jsonl").write_text("\n".join(json.dumps({"_id": q, "text": t}) for q, t in (("q1", "foxes"), ("q2", "dogs slept"), ("q3", "unjudged"))))
    (tmp_path / "qrels").mkdir()
    (tmp_path / "qrels/test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t1\nq2\td2\t2\nq2\td3\t1\n")
    index = SearchIndex(spark, IndexOptions(language="english", order_by=("id",))).insert(corpus.read_corpus(spark, str(tmp_path)))
    got = corpus.evaluate(index, corpus.read_queries(spark, str(tmp_path)), corpus.read_judgements(spark, str(tmp_path))).first()
    assert got.queries == 2 and got.ndcg == pytest.approx(1.0)


def test_catalog_driver(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS kept LOCATION '{tmp_path}/kept'")
    driver = CatalogDriver("kept", "words")
    assert driver.get(spark) is None
    rows = [("1", "hello there"), ("2", "hello world")]
    index = SearchIndex(spark, IndexOptions(storage=driver, order_by=("id",))).insert(spark.createDataFrame(rows, "id string, text string"))
    assert index.persist() and index.persist()
    again, result = SearchIndex(spark, IndexOptions(storage=driver)).sync(persist=False)
    assert result.has_loaded_index_from_storage and {r.id for r in again.search("hello", include_docs=False).collect()} == {"1", "2"}
    driver.delete(spark)
    assert driver.get(spark) is None
