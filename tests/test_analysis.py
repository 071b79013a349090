import re

import pytest
from pyspark.sql import functions as F

from lexigrid.functions import analysis
from lexigrid.functions.stemmers import cistem_stem, porter_stem
from lexigrid.functions.text import auto_fuzziness, common_prefix, edit_distance, field_weights, parse_field


def analyzed(spark, analyzer, words):
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    return [r.t for r in rows.select("i", analyzer.analyze(F.col("w")).alias("t")).orderBy("i").collect()]


def test_english(spark):
    got = analyzed(spark, analysis.english(), ["Houses,", "running", "runners", "the", "and", "foo_bar", "!!!"])
    assert got == ["hous", "run", "runner", "", "", "foobar", ""]


def test_german(spark):
    got = analyzed(spark, analysis.german(), ["Häuser,", "Laufend", "Läufer", "der", "und"])
    assert got == ["hau", "lauf", "lauf", "", ""]


@pytest.mark.parametrize(
    "word,stem",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("ties", "ti"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("bled", "bled"),
        ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"), ("falling", "fall"), ("hissing", "hiss"),
        ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("rational", "ration"), ("digitizer", "digit"),
        ("vietnamization", "vietnam"), ("hopefulness", "hope"), ("triplicate", "triplic"), ("formative", "form"), ("electrical", "electr"), ("goodness", "good"),
        ("revival", "reviv"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"),
        ("is", "is"), ("a", "a"),
    ],
)
def test_porter_examples_of_the_paper(word, stem):
    assert porter_stem(word) == stem


def test_cistem_details():
    assert cistem_stem("1000t") == "1000t"  # a digit in front counts as a capital
    assert cistem_stem("Gebäude") == "baud"[: len(cistem_stem("Gebäude"))]
    assert cistem_stem("sagt") == "sag" and cistem_stem("Sagt") == "Sagt".lower()
    assert cistem_stem("Sagt", case_insensitive=True) == "sag" and cistem_stem("") == ""


def test_tokens(spark):
    texts = ["Läufer foo_bar 1a", "", "!!!", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.select(analysis.word_tokens(F.col("t")).alias("a"), analysis.unicode_tokens(F.col("t")).alias("u")).orderBy("i").collect()
    assert [r.a for r in got] == [re.findall(r"\w+", t or "", re.ASCII) for t in texts]
    assert got[0].u == ["Läufer", "foo_bar", "1a"] and got[3].u == []


def test_custom_analyzer_and_language_names(spark):
    python = analysis.custom("ends", python=lambda w: w[:2])
    assert analyzed(spark, python, ["Hello", "a"]) == ["he", "a"]
    split = analysis.custom("commas", tokenize=lambda c: F.split(c, ","), prepare=F.upper)
    one = spark.createDataFrame([("a,b c",)], "t string").select(split.terms(split.tokenize(F.col("t"))).alias("x")).first()
    assert one.x == ["A", "B C"]
    assert analysis.resolve(None).name == "default"
    with pytest.raises(ValueError):
        analysis.resolve("klingon")


def test_field_weights():
    assert [parse_field(x) for x in ("field^2.5", "field", "field^3", "f^.5", "a^b")] == [("field", 2.5), ("field", 1.0), ("field", 3.0), ("f", 0.5), ("a^b", 1.0)]
    assert field_weights(None, ["a", "b"]) == field_weights([], ["a", "b"]) == {"a": 1.0, "b": 1.0}
    assert field_weights(["a^2", "a^3", "b^0"], ["a", "b", "c"]) == {"a": 3.0}
    with pytest.raises(ValueError, match="Unknown field 'x'!"):
        field_weights(["x"], ["a"])


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def test_scalars_equal_plain_versions(spark):
    words = ["kitten", "sitting", "sunday", "saturday", "intention", "execution", "", "abc", "café", "cafe", "straße", "strasse", "ab", "abd"]
    pairs = [(a, b) for a in words for b in words]
    rows = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", edit_distance("a", "b").alias("d"), edit_distance("a", "b", 2).alias("d2"), common_prefix(F.col("a"), F.col("b")).alias("p"), auto_fuzziness(F.col("a")).alias("f")
    )
    for r in rows.collect():
        d = plain_distance(r.a, r.b)
        assert r.d == d and r.d2 == (d if d <= 2 else -1)
        shared = next((i for i in range(min(len(r.a), len(r.b))) if r.a[i] != r.b[i]), min(len(r.a), len(r.b)))
        assert r.p == r.a[:shared] and r.f == (0 if len(r.a) < 3 else 1 if len(r.a) < 6 else 2)
    assert plain_distance("kitten", "sitting") == plain_distance("sunday", "saturday") == 3 and plain_distance("intention", "execution") == 5
