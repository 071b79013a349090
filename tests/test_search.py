import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexigrid.operators.evaluate import mean_ndcg, ndcg
from lexigrid.operators.index import SearchIndex
from lexigrid.plans.options import IndexOptions, SearchOptions

F1 = [("1", "The quick brown fox", "A speedy canine")] + [("2", "Jumps over the lazy dog", "High leap"), ("3", "Bright blue sky", "Clear and sunny day")]
F2 = [("1", "greetings world", "hello"), ("2", "farewell", "goodbye world")]


def index(spark, rows, schema="id string, title string, content string", **options):
    return SearchIndex(spark, IndexOptions(**{"keep_documents": True, "order_by": ("id",)} | options)).insert(spark.createDataFrame(rows, schema))


@pytest.fixture(scope="module")
def greetings(spark):
    return index(spark, F2, enable_autocomplete=True)


def ids(found):
    return [r.id for r in sorted(found.collect(), key=lambda r: r.rank)]


@pytest.mark.parametrize("language,score", [("english", 0.5430196556466306), ("default", 0.5406145489041012)])
def test_golden_scores(spark, language, score):
    got = index(spark, F1, "id string, text string, additionalText string", language=language).search("fox").collect()
    assert [(r.id, r.rank) for r in got] == [("1", 1)] and got[0].score == pytest.approx(score, rel=1e-14)


def brute(docs, query, weights, k1=1.2, b=0.75):
    tokens = {d: {f: re.findall(r"\w+", t.lower(), re.ASCII) for f, t in fields.items()} for d, fields in docs.items()}
    n = max(sum(f in x for x in tokens.values()) for f in weights)
    average = sum(w * sum(len(x[f]) for x in tokens.values() if f in x) for f, w in weights.items()) / n
    scores = defaultdict(float)
    for term in set(re.findall(r"\w+", query.lower())):
        hits = {}
        for d, fields in tokens.items():
            tf = {f: Counter(fields[f])[term] for f in weights if f in fields}
            if any(tf.values()):
                hits[d] = (sum(weights[f] * c for f, c in tf.items()), sum(weights[f] * len(fields[f]) for f, c in tf.items() if c))
        for d, (tf, dl) in hits.items():
            scores[d] += tf / (tf + k1 * (1 - b + b * dl / average)) * math.log(1 + (n - len(hits) + 0.5) / (len(hits) + 0.5))
    return scores


def test_scores_equal_brute_force(spark):
    docs = {
        "a": {"title": "red fox", "content": "the red fox ran"}, "b": {"title": "fox", "content": ""}, "c": {"title": "!!!", "content": "red red blue"},
        "d": {"content": "constructor of a fox"}, "e": {"title": "blue", "content": "nothing"},
    }
    rows = [(i, d.get("title"), d.get("content")) for i, d in docs.items()]
    built = index(spark, rows)
    for fields, weights in ((None, {"title": 1, "content": 1}), (["title^2", "content^0.5"], {"title": 2, "content": 0.5}), (["content", "title^0"], {"content": 1})):
        got = {r.id: r.score for r in built.search("red fox constructor red", fields=fields, k1=1.5, b=0.6).collect()}
        assert got == pytest.approx(brute(docs, "red fox constructor", weights, 1.5, 0.6))
    assert built.search("zzz !!!").count() == 0 and built.search("").count() == 0
    assert built.search("red", fields=["title^0"]).count() == 0
    stats = {r.field: (r.doc_count, r.total_dl) for r in built.table("field_stats").collect()}
    assert stats == {"title": (4, 4), "content": (5, 12)}
    queries = spark.createDataFrame([(1, "red fox"), (2, "blue"), (3, "zzz")], "query_id long, text string")
    batch = built.search_batch(queries, limit=2).collect()
    for q, text in ((1, "red fox"), (2, "blue")):
        want = [(r.id, r.rank, pytest.approx(r.score)) for r in built.search(text, limit=2).orderBy("rank").collect()]
        assert sorted([(r.id, r.rank, r.score) for r in batch if r.query_id == q], key=lambda x: x[1]) == want
    assert {r.query_id for r in batch} == {1, 2}


def test_weights_and_order(spark, greetings):
    got = greetings.search("world", fields=["title", "content^2"]).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [("2", pytest.approx(0.11762681083480943)), ("1", pytest.approx(0.10724797458467919))]
    got = index(spark, [("1", "greetings world", "hello world"), ("2", "farewell", "goodbye world")]).search("world", fields=["title", "content"]).orderBy("rank").collect()
    assert [r.id for r in got] == ["1", "2"] and got[0].score > got[1].score


def test_highlighting(spark, greetings):
    got = greetings.search("farewell world", fields=["title", "content^2"], highlighted_fields=["title", "content"]).orderBy("rank").collect()
    assert [(r.highlighted_title, r.highlighted_content) for r in got] == [("<b>farewell</b>", "goodbye <b>world</b>"), ("greetings <b>world</b>", "hello")]
    assert got[0].score == pytest.approx(0.5797249312081063)
    asked = "How is the weather in {}? It is {}."
    text = " ".join(["Hello, how are you?", "I am fine, thank you.", asked.format("New York", "sunny"), asked.format("London", "rainy")])
    english = index(spark, [("1", "greetings world", text)], language="english")
    got = english.search("How is the weather in London? Is it sunny?", highlighted_fields=["title", "content"]).first()
    marked = text.replace("weather", "<b>weather</b>").replace("sunny", "<b>sunny</b>").replace("London", "<b>London</b>")
    assert (got.highlighted_title, got.highlighted_content) == ("greetings world", marked)


def test_filter_paging_and_ties(spark):
    built = index(spark, [(f"id-{i}", "same words here", None) for i in (1, 2, 3)])
    assert ids(built.search("words")) == ["id-1", "id-2", "id-3"]
    assert ids(built.search("words", id_filter=lambda c: c.isin("id-1", "id-3"))) == ["id-1", "id-3"]
    assert built.search("words", id_filter=lambda c: F.lit(False)).count() == 0
    assert ids(built.search("words", limit=1, offset=1)) == ["id-2"] and ids(built.search("words", offset=2)) == ["id-3"]
    for wrong in ({"limit": 0}, {"offset": -1}, {"max_expansions": 0}, {"fuzziness": -1}, {"fuzziness": "SOME"}):
        with pytest.raises(ValueError):
            SearchOptions(**wrong)


def test_nested_fields(spark):
    rows = [("1", '{"text": "Hugo writes", "names": [["x", "Lina"], "b"]}'), ("2", '{"text": "other", "title": "title", "names": [["y", "Henry"]]}')]
    built = index(spark, rows, "id string, content string", json_columns=("content",), indexed_fields=("content.text", "content.names.0.1"))
    assert ids(built.search("Henry")) == ["2"] and ids(built.search("Lina")) == ["1"] and ids(built.search("hugo")) == ["1"]
    assert built.search("title").count() == 0 and built.search("x").count() == 0


def test_autocomplete(spark, greetings):
    words = lambda *a, **k: [r.word for r in greetings.autocomplete(*a, **k).orderBy("rank").collect()]
    assert words("hel") == ["hello"] and words("fare") == ["farewell"] and words("unknown") == [] and words("g") == ["goodbye", "greetings"]
    assert words("") == ["farewell", "goodbye", "greetings", "hello", "world"] and words("HEL") == ["hello"]
    assert words("helo", method="fuzzy") == ["hello"] and words("fare", method="fuzzy") == [] and words("", method="fuzzy") == []
    assert words("fare", method="fuzzy", fuzziness=4) == ["farewell", "world"] and words("goodby", method="fuzzy") == ["goodbye"]
    with pytest.raises(ValueError, match="Autocomplete is not enabled!"):
        index(spark, F2).autocomplete("a")


def test_fuzzy_search(spark, greetings):
    assert greetings.search("word").count() == 2
    assert greetings.search("word", fuzziness=0).count() == 0 and greetings.search("wurd", fuzziness=2).count() == 2
    assert index(spark, F2).search("word").count() == 0  # without autocomplete nothing is expanded


def test_documents_of_the_page(spark):
    bare = index(spark, F2, keep_documents=False)
    with pytest.raises(ValueError, match="get_document is required"):
        bare.search("world")
    assert bare.search("world", include_docs=False).columns == ["rank", "id", "score"]
    get = lambda i: {"id": i} if i == "1" else None
    assert sorted((r.id, r.doc) for r in bare.search("world", get_document=get).collect()) == [("1", '{"id": "1"}'), ("2", None)]

    def broken(i):
        raise KeyError(i)

    assert [r.doc for r in bare.search("world", get_document=broken, ignore_errors=True).collect()] == [None, None]
    with pytest.raises(Exception, match="KeyError"):
        bare.search("world", get_document=broken).collect()
    assert index(spark, F2).get_document("2") == {"id": "2", "title": "farewell", "content": "goodbye world"}
    assert index(spark, F2).get_document("9") is None and bare.get_document("1") is None


def test_fetched_by_address(spark, tmp_path):
    for i in "12":
        (tmp_path / f"{i}.json").write_text('{"n": %s}' % i)
    built = index(spark, F2, keep_documents=False, fetch_document_url=f"file://{tmp_path}/{{id}}.json")
    assert sorted(r.doc for r in built.search("world").collect()) == ['{"n": 1}', '{"n": 2}']


def test_option_rules():
    for wrong in ({"keep_documents": True, "get_document": len}, {"indexed_fields": ()}, {"patch_url": "/x/patch"}, {"fetch_document_url": "/x"}, {"index_url": "nothing"}):
        with pytest.raises(ValueError):
            IndexOptions(**wrong)


def test_bad_ids(spark):
    with pytest.raises(Exception, match="required 'id' field is missing"):
        index(spark, [("", "a", "b")])
    with pytest.raises(Exception, match="required 'id' field is missing"):
        index(spark, [(None, "a", "b")])
    with pytest.raises(ValueError, match="required 'key' field"):
        index(spark, F2, id_field="key")
    with pytest.raises(ValueError, match="Duplicate document ID: 1"):
        index(spark, [("1", "a", "b"), ("1", "c", "d")])


def test_ndcg(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "a", 1), (3, "x", 1)], "query_id int, doc_id string, rank int")
    judged = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (1, "z", 1), (2, "q", 1), (4, "x", 0)], "query_id int, doc_id string, relevance int")
    got = {r.query_id: r.ndcg for r in ndcg(ranked, judged).collect()}
    want = (1 / math.log2(3) + 2 / 2) / (2 + 1 / math.log2(3) + 1 / 2)
    assert got == {1: pytest.approx(want), 2: 0.0, 4: 0.0}
    assert mean_ndcg(ranked, judged).first().ndcg == pytest.approx(want / 3)


def test_columns_with_names_of_ours(spark):
    rows = [("a", "mongo7", 5, "x", 1, 2, "title words", "dotted value")]
    schema = "id string, _id string, internal_id int, _place string, _part int, _first int, body string, `a.b` string"
    built = SearchIndex(spark, IndexOptions(keep_documents=True, order_by=("a.b", "_place"))).insert(spark.createDataFrame(rows, schema))
    for word in ("mongo7", "x", "title", "dotted"):
        assert ids(built.search(word)) == ["a"]
    assert built.get_document("a") == {"id": "a", "_id": "mongo7", "internal_id": 5, "_place": "x", "_part": 1, "_first": 2, "body": "title words", "a.b": "dotted value"}


def test_the_querys_getter_goes_first(spark, greetings, tmp_path):
    own = greetings.search("world", get_document=lambda i: {"own": i})
    assert [r.doc for r in own.collect()] == ['{"own": "1"}', '{"own": "2"}']
    (tmp_path / "1.json").write_text('{"from": "address"}')
    (tmp_path / "2.json").write_text('{"from": "address"}')
    both = index(spark, F2, keep_documents=False, fetch_document_url=f"file://{tmp_path}/{{id}}.json", get_document=lambda i: {"from": "getter"})
    assert {r.doc for r in both.search("world").collect()} == {'{"from": "address"}'}


def test_results_come_in_order(spark):
    built = index(spark, [(f"{i:03}", " ".join(["fox"] * (1 + i % 5)) + " dog" * (i % 7), None) for i in range(60)])
    for how in ({}, {"limit": 25}, {"limit": 10, "offset": 5}, {"include_docs": False}):
        got = [r.rank for r in built.search("fox dog", **how).collect()]
        assert got == sorted(got) and len(got) > 9


def test_removed_documents_are_not_counted(spark):
    built = index(spark, F2).remove(["1"])
    assert built.doc_count == 1 and ids(built.search("world")) == ["2"]
    again = built.insert(spark.createDataFrame([("1", "world", "new")], "id string, title string, content string"))
    assert again.doc_count == 2 and sorted(r.internal_id for r in again.table("doc_ids").collect()) == [1, 2]


def test_a_tokenizer_in_python(spark):
    from lexigrid.functions.analysis import custom

    built = index(spark, [("1", "a-b c", None), ("2", "c", None)], language=custom("dashes", python_tokenize=lambda t: t.split("-")))
    assert ids(built.search("B c")) == ["1"] and ids(built.search("c")) == ["2"]


def test_a_table_of_queries_moves_no_pairs(spark, monkeypatch):
    """Only the best of each block leave it; ties, several groups and blocks, and sums that are nothing or negative."""
    import random

    from lexigrid.operators import bm25f

    rng = random.Random(5)
    words = "a b c d e f g h".split()
    asked = {q: set(rng.sample(words, rng.randint(1, 5))) | ({"zzz"} if q % 3 else set()) for q in range(13)} | {99: {"zzz"}}
    points = {(w, d): rng.choice([-0.5, 0.1, 0.25, 0.5]) for d in range(90) for w in words if rng.random() < 0.3}
    scores = spark.createDataFrame([(w, d, s) for (w, d), s in points.items()], "term string, internal_id long, score double").repartition(5)
    queries = spark.createDataFrame([(q, w) for q, some in asked.items() for w in some], "query_id int, term string")
    want = []
    for q, some in asked.items():
        sums = {}
        for w in sorted(some):
            for d in range(90):
                if (w, d) in points:
                    sums[d] = sums.get(d, 0.0) + points[w, d]
        want += [(q, k + 1, d, s) for k, (d, s) in enumerate(sorted(sums.items(), key=lambda x: (-x[1], x[0])))]
    for name, n in (("BLOCK_SCORES", 160), ("GROUP_QUERIES", 5), ("CELLS", 60)):
        monkeypatch.setattr(bm25f, name, n)
        for limit, offset in ((4, 0), (3, 2), (None, 0), (None, 3)):
            got = bm25f.rank_many(scores, queries, limit, offset)
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "collect_list" not in plan and "Join" not in plan
            assert sorted(map(tuple, got.collect())) == [r for r in sorted(want) if offset < r[1] <= offset + (limit or 1000)]


def test_terms_are_counted_in_the_jvm(spark):
    """No Python worker holds a batch of texts; the counts are those of a Counter."""
    from lexigrid.functions import analysis
    from lexigrid.operators import bm25f

    texts = {1: "b a B c_1 a, a", 2: "", 3: "?!", 4: "x " * 3000 + "Y", 5: " ".join(f"w{i % 700}" for i in range(2000)), 6: "one"}
    leaves = spark.createDataFrame([(i, "text", t) for i, t in texts.items()], "internal_id long, field string, value string")
    for only in (None, ["a", "y", "w3", "nothing"]):
        post = bm25f.postings(bm25f.analysed(leaves, analysis.default()), only)
        assert "Python" not in post._jdf.queryExecution().executedPlan().toString() and post.schema.simpleString() == "struct<term:string,internal_id:bigint,field:string,tf:int,dl:int>"
        got = sorted(map(tuple, post.collect()))
        words = {i: re.findall(r"\w+", t.lower()) for i, t in texts.items()}
        assert got == sorted((w, i, "text", n, len(some)) for i, some in words.items() for w, n in Counter(some).items() if only is None or w in only)
