"""Every registered query against its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from lexigrid.catalogue import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    return tuple(v) if isinstance(v, list) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want
    assert want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())


def test_document_frequency_moves_terms_alone(spark, tmp_path):
    """Ids given twice, no id, a word in several fields; the SQL on the same rows."""
    rows = [(1, "en word word", "en", "src"), (2, "other Word", "en", None), (None, "lost word", "xx", "src"), (3, None, "en", "other"), (4, "", "de", "src4")]
    for twice, given in ((False, rows), (True, rows + [(2, "Word again", "en", "src"), (None, "lost", None, None)])):
        at = tmp_path / str(twice)
        docs = spark.createDataFrame(given, "doc_id long, text string, lang string, source string")
        docs.coalesce(1).write.parquet(str(at / "documents.parquet"))
        got = QUERIES["document_frequency"](spark, str(at))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and ("hashpartitioning(term" in plan) and (twice or "id" not in plan.partition("hashpartitioning(")[2].partition(")")[0])
        want = duckdb.sql(ORACLE_SQL["document_frequency"].replace("FROM documents", f"FROM '{at}/documents.parquet/*.parquet'")).fetchall()
        assert sorted(map(tuple, got.select("term", "df").collect())) == sorted(want) and ("lost", 0) in want
