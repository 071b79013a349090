import random

import numpy as np
import pyarrow as pa
import pytest

from lexigrid.llm import lang_id as li
from lexigrid.llm.textkit import buffers

SCHEMA = "doc_id long, text string, lang string, language int, confidence string, mark int, bucket string"
SYLLABLES = {"aa": "ka lo mi tu ren sa".split(), "bb": "schu gen über ig ßen a".split(), "cc": "чта ние про ка ло".split()}


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(3, 60))]
        rows.append((i, " ".join(words).capitalize() + ".", lang, 1, "c", 2, "b"))
    return rows


def test_held_out_accuracy(spark):
    train = spark.createDataFrame(corpus(300, 1), SCHEMA)
    model = li.train(train)
    test = corpus(200, 2)
    got = {r.doc_id: r for r in li.identify(spark.createDataFrame(test, SCHEMA), model).collect()}
    right = np.mean([got[r[0]].language == r[2] for r in test])
    assert right > 0.97
    assert np.mean([r.confidence for r in got.values()]) == pytest.approx(right, abs=0.05)


def test_accuracy_on_the_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = li.identify(docs, li.train(docs, bound=100)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.language == r.lang for r in got]) > 0.9


def test_document_frequencies_equal_plain_counts(spark):
    rows = corpus(40, 3)
    df, n = li.document_frequencies(spark.createDataFrame(rows, SCHEMA))
    want = np.zeros(li.BUCKETS, int)
    for r in rows:
        flat, _ = li.char_ngrams(*buffers(pa.array([r[1]])))
        want[np.unique(flat)] += 1
    assert n == 40 and (df == want).all()


def test_ngrams_equal_plain_ones():
    texts = ["Ab, c", "", "é日😀x", "...", None, "a  b"]
    raw, off = buffers(pa.array(texts))
    flat, row = li.char_ngrams(raw, off)
    for i, text in enumerate(texts):
        plain = ""
        for c in text or "":
            c = c.lower() if c.isalpha() or ord(c) > 0xFFFF else " "
            plain += "" if c == " " and plain.endswith(" ") else c
        count = sum(max(0, len(plain) - n + 1) for n in li.ORDERS) - plain.count(" ")
        if plain.strip():
            assert (row == i).sum() == count
    assert set(row[np.isin(row, [1, 3, 4])]) == set()
    one, other = (li.char_ngrams(*buffers(pa.array([t])))[0].tolist() for t in ("AB!c", "ab c"))
    assert one == other


def test_sparse_and_regularised():
    rng = np.random.default_rng(0)
    rows, y = [], rng.integers(0, 2, 200)
    for label in y:
        rows.append((np.r_[label, rng.integers(100, 400, 5)], np.ones(6)))
    w, _ = li.ftrl(rows, y, 2)
    assert w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0]
    assert (w == 0).mean() > 0.99


def test_temperature():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 4000)
    p = np.full((4000, 3), 0.1)
    p[np.arange(4000), np.where(rng.random(4000) < 0.8, y, (y + 1) % 3)] = 0.8
    assert li.fit_temperature(np.log(p) * 5, y) == pytest.approx(5, rel=0.4)
    assert li.fit_temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


def test_odd_rows(spark):
    rows = corpus(60, 4)
    odd = [(900, None, "aa", 1, "", 1, ""), (901, "", None, 1, "", 1, ""), (902, "12 .", "bb", 1, "", 1, ""), (None, "kalomi turen", None, 1, "", 1, ""), (903, "über schugen " * 40_000, None, 1, "", 1, "")]
    docs = spark.createDataFrame(rows + odd + odd, SCHEMA)
    got = li.identify(docs, li.train(docs)).collect()
    assert len(got) == 70
    by = {r.doc_id: r for r in got}
    assert by[900].language is None and by[900].confidence is None
    assert by[901].language == by[902].language == "und" and by[901].confidence is None
    assert by[903].language == "bb" and by[None].language == "aa"
    empty = docs.limit(0)
    assert li.train(empty) is None and li.identify(empty, None).count() == 0
    assert {r.language for r in li.identify(docs, None).collect()} == {"und", None}
    one = docs.filter("lang = 'aa'")
    assert {r.language for r in li.identify(one.filter("text is not null"), li.train(one)).collect()} == {"aa"}


def test_the_bound_holds_whatever_repeats(spark):
    same = spark.range(5000).selectExpr("id as doc_id", "'one text' as text", "'en' as lang")
    assert li._sample(same, 100).num_rows == 1
    rows = spark.range(5000).selectExpr("1L as doc_id", "concat('text ', id) as text", "if(id % 500 = 0, 'xx', 'en') as lang")
    got = li._sample(rows.unionByName(rows), 200)
    langs = got.column("lang").to_pylist()
    assert 150 <= got.num_rows <= 200 and langs.count("xx") == 10  # a rare language comes whole
    assert li.quotas({"a": 1000, "b": 3, "c": 1000}, 100) == {"a": 48, "c": 49, "b": 3}
    assert sum(li.quotas({str(i): 1 for i in range(500)}, 100).values()) == 100


def test_ftrl_equals_a_plain_one():
    """McMahan's per-coordinate update for softmax, one coordinate at a time."""
    rng = np.random.default_rng(5)
    k, rows = 3, []
    y = rng.integers(0, k, 60)
    for label in y:
        bucket = np.unique(np.r_[label, rng.integers(10, 40, 6)])
        rows.append((bucket, rng.random(len(bucket)) * 2))
    z, n = {}, {}

    def weight(key):
        if key not in z:
            return 0.0
        l1 = 0.0 if key[0] == "bias" else li.L1
        if abs(z[key]) <= l1:
            return 0.0
        return -(z[key] - np.sign(z[key]) * l1) / ((li.BETA + np.sqrt(n[key])) / li.ALPHA + li.L2)

    for _ in range(li.EPOCHS):
        for (bucket, value), label in zip(rows, y):
            x = dict(zip(bucket.tolist(), value.tolist())) | {"bias": 1.0}
            w = {(f, c): weight((f, c)) for f in x for c in range(k)}
            s = np.array([sum(w[f, c] * v for f, v in x.items()) for c in range(k)])
            p = np.exp(s - s.max())
            p /= p.sum()
            for f, v in x.items():
                for c in range(k):
                    g = (p[c] - (c == label)) * v
                    before = n.get((f, c), 0.0)
                    sigma = (np.sqrt(before + g * g) - np.sqrt(before)) / li.ALPHA
                    z[f, c] = z.get((f, c), 0.0) + g - sigma * w[f, c]
                    n[f, c] = before + g * g
    w, bias = li.ftrl(rows, y, k)
    assert np.allclose(bias, [weight(("bias", c)) for c in range(k)])
    for b in range(40):
        assert np.allclose(w[b], [weight((b, c)) for c in range(k)])


def test_scores_equal_plain_ones(spark):
    """TF-IDF, weights, softmax and temperature by dictionaries, on whole texts."""
    rows = corpus(120, 6)
    docs = spark.createDataFrame(rows, SCHEMA)
    model = li.train(docs)
    got = {r.doc_id: r for r in li.identify(docs, model).collect()}
    for r in rows:
        flat = li.char_ngrams(*buffers(pa.array([r[1]])))[0].tolist()
        s = [sum(float(model.table[b, c]) for b in flat) / len(flat) + model.bias[c] for c in range(len(model.languages))]
        e = np.exp((np.array(s) - max(s)) / model.temperature)
        p = e / e.sum()
        assert got[r[0]].language == model.languages[int(p.argmax())]
        assert got[r[0]].confidence == pytest.approx(p.max(), rel=1e-4)
