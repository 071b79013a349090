import random

import pytest
from pyspark.sql import functions as F

from lexigrid.operators.dictionary import Dictionary
from lexigrid.operators.fuzzy import auto_expansions, fuzzy_join, fuzzy_matches, nearest_word, prefix_matches
from lexigrid.operators.highlight import highlight
from lexigrid.functions import analysis

from test_analysis import plain_distance

F8 = "survey surveys surgery surfing serve service serge super".split()


def words(spark, ws):
    return spark.createDataFrame([(w,) for w in ws], "word string")


def in_order(df):
    return [r.word for r in sorted(df.collect(), key=lambda r: r["rank"])]


def test_golden_order(spark):
    table = words(spark, F8)
    want = "survey surveys serve surgery serge super service surfing".split()
    assert in_order(fuzzy_matches(table, "survey", 5)) == want
    assert in_order(fuzzy_matches(table, "survey", 2)) == want[:4]
    assert in_order(fuzzy_matches(table, "survey", 5, 3)) == want[:3]
    assert in_order(fuzzy_matches(table, "survey", 5, collation="UNICODE")) == want
    for wrong in ((-1, None), (1, 0)):
        with pytest.raises(ValueError):
            fuzzy_matches(table, "a", *wrong)


def random_words(n, seed):
    rng = random.Random(seed)
    return sorted({"".join(rng.choices("abcd", k=rng.randint(1, 7))) for _ in range(n)})


def test_fuzzy_equals_brute_force(spark):
    ws = random_words(300, 1)
    table = words(spark, ws).cache()
    for query, k, limit in ((["abcd"], 2, None), (["abcd", "dd", "dcba"], 1, 7), (["a", "bbbbbbb"], 3, 20)):
        near = {w: min(plain_distance(w, q) for q in query) for w in ws}
        want = [w for w in sorted(ws, key=lambda w: (near[w], w)) if near[w] <= k][:limit]
        assert in_order(fuzzy_matches(table, query, k, limit)) == want
    pairs = {(a, b): plain_distance(a, b) for a in ws[:80] for b in ws}
    for k in (0, 1, 2):
        got = fuzzy_join(words(spark, ws[:80]), table, k).collect()
        assert {(r.left_word, r.right_word): r.distance for r in got} == {p: d for p, d in pairs.items() if d <= k}
    got = nearest_word(table, spark.createDataFrame([("zzz",), ("abca",)], "query string")).collect()
    assert {r.query: r.word for r in got} == {q: min(ws, key=lambda w: (plain_distance(w, q), w)) for q in ("zzz", "abca")}
    got = auto_expansions(table, ["ab", "abcd", "abcdab"], 3).collect()
    for q, k in (("ab", 0), ("abcd", 1), ("abcdab", 2)):
        want = [w for w in sorted(ws, key=lambda w: (plain_distance(w, q), w)) if plain_distance(w, q) <= k][:3]
        assert sorted(r.word for r in got if r.bucket == k) == sorted(want)


def test_both_queries_of_a_batch_are_found(spark):
    assert in_order(fuzzy_matches(words(spark, ["hello", "xyzzyx"]), ["hello", "xyzzyx"], 1)) == ["hello", "xyzzyx"]


def test_prefix(spark):
    table = words(spark, "apple appetite banana band bandana bandit zebra café cafeteria Apple hello helloxa".split())
    assert in_order(prefix_matches(table, "band", None)) == ["band", "bandana", "bandit"] and in_order(prefix_matches(table, "ba", 2)) == ["banana", "band"]
    assert in_order(prefix_matches(table, "café")) == ["café"] and in_order(prefix_matches(table, "hex")) == [] and len(in_order(prefix_matches(table, "", None))) == 12


def test_dictionary(spark):
    d = Dictionary.empty(spark)
    for word, value in (("bandano", 1), ("bandana", 2), ("bandit", 3), ("box", 4)):
        d = d.insert(word, value)
    assert in_order(d.prefix("b")) == ["bandana", "bandano", "bandit", "box"]
    assert in_order(d.prefix("b", keep=F.exists("values", lambda v: v % 2 == 0))) == ["bandana", "box"]
    d = d.insert("toast", 1).insert("toaster", 3, 4).insert("toast", 2, fuzzy=True).insert_no_fuzzy("toasts", 9)
    assert d.lookup("toast") == [1, 2] and d.lookup("toaster") == [3, 4] and d.lookup("nothing") is None and d.lookup("") == [] and d.has("box") and not d.has("x")
    assert in_order(d.fuzzy("toast", 2)) == ["toast", "toaster"] and in_order(d.fuzzy("toast", 2, limit=1)) == ["toast"]
    assert in_order(d.fuzzy(["toast", "bix"], 1)) == ["toast", "box"] and d.nearest("bandito") in ("bandano", "bandit")
    with pytest.raises(ValueError, match="Missing key!"):
        d.insert("", 1)
    assert d.insert("empty").lookup("empty") is None
    custom = Dictionary.of(words(spark, ["ab", "abc", "xy"]), distance=lambda a, b: F.abs(F.length(a) - F.length(b)))
    assert in_order(custom.fuzzy("qq", 0)) == ["ab", "xy"]
    assert Dictionary.empty(spark).nearest("a") is None


def test_highlight_keeps_all_else(spark):
    rng = random.Random(3)
    texts = ["", "!!!", None, "a  b", "A-b,a"] + ["".join(rng.choices(["a", "bc", " ", "\n", ".", "é"], k=20)) for _ in range(30)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.h for r in rows.select("i", highlight(F.col("t"), ["a", "bc"], analysis.default(), "[", "]").alias("h")).collect()}
    assert got[2] is None and got[4] == "[A]-b,[a]"
    assert all(got[i] is None or got[i].replace("[", "").replace("]", "") == t for i, t in enumerate(texts))


def test_nearest_and_find_take_any_distance(spark):
    from pyspark.sql import functions as F

    from lexigrid.operators.dictionary import Dictionary

    words = spark.createDataFrame([("ab",), ("zzz",), ("abcdef",)], "word string")
    by_length = Dictionary.of(words, distance=lambda a, b: F.abs(F.length(a) - F.length(b)))
    assert by_length.nearest("abc") == "zzz" and Dictionary.of(words).nearest("abc") == "ab"
    assert [(r.word, r.distance) for r in by_length.find("abc").orderBy("rank").collect()] == [("zzz", 0), ("ab", 1), ("abcdef", 3)]
    assert [(r.word, r.distance) for r in Dictionary.of(words).find("abc").orderBy("rank").collect()] == [("ab", 1), ("abcdef", 3), ("zzz", 3)]
    assert [r.word for r in Dictionary.of(words).find("abc", 1).collect()] == ["ab"]
