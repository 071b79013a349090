import random

import numpy as np
import pyarrow as pa
import pytest

from lexigrid.llm import toxicity as tx
from lexigrid.llm.linear import chi_square, fit_logistic, sigmoid

DOCS = "doc_id long, text string, rejected int, p_toxic string, same int, y0 int, words string"
LABELS = "doc_id long, quality int, toxic int, text string"
BAD = ["gnarlox", "vilebrak", "hatezug"]


def corpus(n, seed, at=0):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(at, at + n):
        toxic, poor = rng.random() < 0.25, rng.random() < 0.3
        words = rng.choices(vocabulary, k=rng.randint(10, 60))
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        text = " ".join(words) + (" $$$ BUY NOW !!!" * 3 if poor else ".")
        docs.append((i, text, 1, "p", 2, 3, "w"))
        labels.append((i, int(not poor), int(toxic), "l"))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(600, 1)
    chain = tx.train(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    more, truth = corpus(300, 2, at=1000)
    got = {r.doc_id: r for r in tx.score(spark.createDataFrame(more, DOCS), chain).collect()}
    assert np.mean([got[i].rejected == bool(toxic) for i, _, toxic, _ in truth]) > 0.97
    assert np.mean([(got[i].p_low_quality < 0.5) == bool(quality) for i, quality, _, _ in truth]) > 0.97
    kept = tx.drop_toxic(spark.createDataFrame(docs + more, DOCS), spark.createDataFrame(labels, LABELS))
    again = {r.doc_id for r in kept.collect()}
    assert {i for i in got if not got[i].rejected} == {i for i in again if i >= 1000}
    assert kept.columns == ["doc_id", "text", "rejected", "p_toxic", "same", "y0", "words"]


def test_training_is_repeatable_and_bounded(spark):
    docs, labels = corpus(200, 3)
    frames = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    a, b = tx.train(*frames, bound=150), tx.train(frames[0].repartition(7), frames[1].repartition(3), bound=150)
    assert all((x.words == y.words).all() and np.allclose(x.weights, y.weights) and x.threshold == y.threshold for x, y in zip(a, b))
    assert tx._training_rows(*frames, tx.CATEGORIES, 150).num_rows == 150


def test_later_models_see_earlier_probabilities(spark):
    docs, labels = corpus(300, 4)
    chain = tx.train(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    assert len(chain[0].weights) == len(chain[0].words) + 4 + 1
    assert len(chain[1].weights) == len(chain[1].words) + 4 + 1 + 1


def test_odd_rows(spark):
    docs, labels = corpus(200, 5)
    odd = [(9000, None), (9001, ""), (9002, " ..."), (None, "gnarlox " * 3), (9003, "plain words " * 100_000), (9003, "gnarlox vilebrak hatezug")]
    odd = [(i, t, 1, "p", 2, 3, "w") for i, t in odd]
    more = [(None, 1, 1, ""), (9000, 1, 1, ""), (9001, None, None, ""), (5, 1, 1, ""), (77_777, 0, 1, "")]
    frames = spark.createDataFrame(docs + odd, DOCS), spark.createDataFrame(labels + more, LABELS)
    got = tx.score(frames[0], tx.train(*frames)).filter("doc_id is null or doc_id >= 9000").collect()
    assert len(got) == 6
    null = next(r for r in got if r.doc_id == 9000)
    assert null.p_toxic is None and null.rejected is False
    assert sorted(r.rejected for r in got if r.doc_id == 9003) == [False, True]
    assert next(r for r in got if r.doc_id is None).rejected
    empty = frames[0].limit(0), frames[1].limit(0)
    assert tx.score(empty[0], tx.train(*empty)).count() == 0
    assert tx.drop_toxic(frames[0], empty[1]).count() == len(docs) + 6  # nothing learnt, nothing rejected
    assert tx.drop_toxic(empty[0], frames[1]).count() == 0


def test_logistic_and_chi_square():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < sigmoid(x @ [2.0, -1.0] + 0.5)).astype(float)
    assert fit_logistic(x, y, 0.1) == pytest.approx([2, -1, 0.5], abs=0.25)
    a, b, c, d = 30, 10, 20, 40
    want = 100 * (a * d - b * c) ** 2 / (40 * 60 * 50 * 50)
    assert chi_square(np.array([40]), np.array([30]), 100, 50)[0] == pytest.approx(want)
    assert tx.best_threshold(np.array([0.9, 0.8, 0.2]), np.array([1.0, 1.0, 0.0])) == pytest.approx(0.5)
    assert isinstance(pa.array([1]), pa.Array)


def test_the_bound_holds_whatever_repeats(spark):
    one = spark.range(3000).selectExpr("5L as doc_id", "concat('text ', id % 3) as text")
    labels = spark.createDataFrame([(5, 1, 1)], "doc_id long, quality int, toxic int")
    assert tx._training_rows(one, labels, tx.CATEGORIES, 100).num_rows == 1
    same = spark.range(3000).selectExpr("id as doc_id", "'one text' as text")
    many = spark.range(3000).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    assert tx._training_rows(same, many, tx.CATEGORIES, 100).column("doc_id").to_pylist() == [0]
    other = spark.range(3000).selectExpr("id as doc_id", "concat('text ', id) as text")
    assert tx._training_rows(other, many, tx.CATEGORIES, 100).num_rows == 100
    assert tx._training_rows(other, many.unionByName(many), tx.CATEGORIES, 100).num_rows == 100


def test_labels_without_a_document_cost_nothing(spark):
    docs = spark.range(500).selectExpr("id as doc_id", "concat('text ', id) as text")
    labels = spark.range(100_000).selectExpr("id as doc_id", "1 as quality", "cast(id % 2 as int) as toxic")
    assert tx._training_rows(docs, labels, tx.CATEGORIES, 1000).num_rows == 500


def plain_weights(rows, y):
    """Ridge logistic regression by plain gradient descent with momentum; the intercept is free."""
    x = np.array([[*r, 1.0] for r in rows])
    w, v = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    ridge = np.r_[np.full(x.shape[1] - 1, tx.RIDGE), 0]
    step = 1 / (0.25 * np.linalg.norm(x, 2) ** 2 + tx.RIDGE)
    for t in range(20_000):
        ahead = w + t / (t + 3) * v
        new = ahead - step * (x.T @ (1 / (1 + np.exp(-x @ ahead)) - y) + ridge * ahead)
        v, w = new - w, new
    return w


def test_equals_a_plain_chain_of_three(spark, monkeypatch):
    """Words counted in sets, out-of-fold predictions by hand, weights by gradient descent."""
    monkeypatch.setattr(tx, "RIDGE", 1.0)
    rng = random.Random(8)
    texts, labels = [], []
    for _ in range(160):
        words = rng.choices(["ab", "cd", "ef", "gh", "ij", "kl", "mn"], k=9)
        a = rng.random() < 0.4
        b = rng.random() < (0.8 if a else 0.2)
        c = rng.random() < (0.8 if b else 0.2)
        for on, bad in ((a, "aaa"), (b, "bbb"), (c, "ccc")):
            if on and rng.random() < 0.8:
                words.append(bad)
        texts.append(" ".join(words))
        labels.append([int(a), int(b), int(c)])
    labels[3][1] = -1
    labels = np.array(labels)
    raw, off = tx.buffers(pa.array(texts))
    flat, row = tx.word_features(raw, off)
    pairs = sorted(set(zip(row.tolist(), flat.tolist())))
    chain = tx.fit_chain(np.array([f for _, f in pairs]), np.array([r for r, _ in pairs]), tx._shares(raw, off), labels)
    got = tx.apply_chain(chain, raw, off)

    held = [set(t.split()) for t in texts]
    shares = tx._shares(raw, off).tolist()

    def chosen(used, y):
        out = []
        for w in set().union(*held):
            n = len(used)
            a = sum(w in held[i] and y[i] for i in used)
            p, k = sum(y[i] for i in used), sum(w in held[i] for i in used)
            b, c = k - a, p - a
            d = n - p - b
            bottom = k * (n - k) * p * (n - p)
            if k >= tx.MIN_PRESENT and bottom and n * (a * d - b * c) ** 2 / bottom >= tx.MIN_CHI:
                out.append(w)
        return sorted(out)

    def design(words, i, before):
        return [*(float(w in held[i]) for w in words), *shares[i], *before]

    out_of_fold, final = [[] for _ in texts], [[] for _ in texts]
    for c in range(3):
        y = labels[:, c] == 1
        known = [i for i in range(len(texts)) if labels[i, c] >= 0]
        fresh = {}
        for f in range(tx.FOLDS):
            used = [i for i in known if i % tx.FOLDS != f]
            words = chosen(used, y)
            w = plain_weights([design(words, i, out_of_fold[i]) for i in used], y[used])
            for i in range(f, len(texts), tx.FOLDS):
                fresh[i] = 1 / (1 + np.exp(-np.dot(w, [*design(words, i, out_of_fold[i]), 1.0])))
        words = chosen(known, y)
        w = plain_weights([design(words, i, out_of_fold[i]) for i in known], y[known])
        for i in range(len(texts)):
            final[i].append(1 / (1 + np.exp(-np.dot(w, [*design(words, i, final[i]), 1.0]))))
        for i, p in fresh.items():
            out_of_fold[i].append(p)
    assert np.allclose(got, final, atol=2e-3)


def test_noise_is_not_predicted_out_of_fold(monkeypatch):
    monkeypatch.setattr(tx, "MIN_CHI", 4.0)
    rng = np.random.default_rng(3)
    n = 400
    row = np.repeat(np.arange(n), 50)
    flat = rng.integers(1, 3000, len(row))
    pairs = np.unique(np.c_[row, flat], axis=0)
    y = rng.integers(0, 2, n)
    seen = []
    real = tx.best_threshold
    monkeypatch.setattr(tx, "best_threshold", lambda p, t: seen.append((p, t)) or real(p, t))
    tx.fit_chain(pairs[:, 1], pairs[:, 0], np.zeros((n, 4)), y[:, None])
    p, t = seen[0]
    better = (p[t == 1][:, None] > p[t == 0]).mean()
    assert 0.4 < better < 0.6
