import json

from pyspark.sql import functions as F

from lexigrid.operators.flatten import flatten

SCHEMA = (
    "id string, title string, n int, flag boolean, tags array<string>, "
    "content struct<text:string, names:array<array<string>>, deep:struct<a:struct<b:string>>, count:double>, m map<string,string>, items array<struct<k:string,v:int>>, `odd name` string"
)


def found(df):
    return sorted((r.id, r.field, r.value) for r in df.collect())


def test_typed_rows(spark):
    rows = [
        ("1", "t", 5, True, ["x", None, ""], ("hello", [["Ada"], ["Bob", "Cyd"]], (("z",),), 1.5), {"k": "v"}, [("p", 1), (None, 2)], "o"),
        ("2", None, None, None, None, None, None, None, None),
        ("3", None, None, None, [], (None, [], None, None), {}, [], None),
    ]
    got = found(flatten(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("id", "key"), ["key"]).withColumnRenamed("key", "id"))
    want = [
        ("1", "content.deep.a.b", "z"), ("1", "content.names.0.0", "Ada"), ("1", "content.names.1.0", "Bob"), ("1", "content.names.1.1", "Cyd"), ("1", "content.text", "hello"),
        ("1", "items.0.k", "p"), ("1", "m.k", "v"), ("1", "odd name", "o"), ("1", "tags.0", "x"), ("1", "tags.2", ""), ("1", "title", "t"),
    ]
    assert [x for x in got if x[1] != "key"] == want + []


def test_json_of_any_shape(spark):
    docs = {
        "1": {"a": {"b": "x", "c": [1, "y", {"d": None, "e": "z"}]}, "f": True, "g": {}},
        "2": ["p", ["q"]],
        "3": {"names": ["Hugo", ["Lina", "Henry"]]},
    }
    rows = [(i, json.dumps(d)) for i, d in docs.items()] + [("4", "not json"), ("5", None), ("6", '"alone"')]
    got = found(flatten(spark.createDataFrame(rows, "id string, body string"), ["id"], ["body"]).filter("field <> 'id'"))
    assert got == [
        ("1", "body.a.b", "x"), ("1", "body.a.c.1", "y"), ("1", "body.a.c.2.e", "z"), ("2", "body.0", "p"), ("2", "body.1.0", "q"),
        ("3", "body.names.0", "Hugo"), ("3", "body.names.1.0", "Lina"), ("3", "body.names.1.1", "Henry"), ("6", "body", "alone"),
    ]


def test_variant(spark):
    df = spark.createDataFrame([("1", '{"a": ["u", 3]}')], "id string, j string").select("id", F.parse_json("j").alias("v"))
    assert found(flatten(df, ["id"]).filter("field <> 'id'")) == [("1", "v.a.0", "u")]


def test_nothing_to_flatten(spark):
    assert flatten(spark.createDataFrame([(1,)], "n int"), ["n"]).count() == 0
