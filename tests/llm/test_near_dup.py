import random
from collections import defaultdict

import numpy as np
import pytest

from lexigrid.llm import near_dup as nd

from brute import signature_groups

SCHEMA = "doc_id long, text string, sig string, rep int, gone long, token string, u int, group_id int, doc_ids string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, 2, "t", 3, 4, "d") for i, t in rows], SCHEMA)


def corpus(n=120, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            text = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, max(1, len(text) // 8))):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
        else:
            text = rng.choices(vocabulary, k=rng.randint(1, 80))
        rows.append((i, " ".join(text)))
    return rows


def grouped(rows):
    """Classes of two documents or more."""
    out = defaultdict(list)
    for r in rows:
        out[r.class_id].append(r.doc_id)
    return sorted(sorted(g) for g in out.values() if len(g) > 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_brute_force(spark, seed):
    docs = frame(spark, corpus(seed=seed))
    rows = [(r.doc_id, np.frombuffer(bytes(r.sig), "<u4")) for r in nd.signatures(docs).collect()]
    want = signature_groups(rows, nd.MIN_MATCHES)
    got = nd.near_duplicate_classes(docs).collect()
    assert len(want) > 5
    assert grouped(got) == want
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    by = dict(rows)
    for r in got:
        assert r.class_id <= r.doc_id
        partners = sum((by[r.doc_id] == x).sum() >= nd.MIN_MATCHES and (by[r.doc_id] != x).any() for i, x in rows)
        assert r.n_links <= partners and bool(r.n_links) == bool(partners)


def test_many_copies_and_close_copies(spark):
    base = " ".join(f"word{i}" for i in range(200))
    rows = [(i, base) for i in range(300)] + [(1000 + i, base.replace(f"word{i + 50}", "other")) for i in range(100)] + [(5000, "nothing in common here at all")]
    got = grouped(nd.near_duplicate_classes(frame(spark, rows)).collect())
    assert [(g[0], len(g)) for g in got] == [(0, 400)]
    left = nd.drop_near_duplicates(frame(spark, rows)).collect()
    assert sorted(r.doc_id for r in left) == [0, 5000]


def test_odd_rows(spark):
    long = "many different words " + " ".join(map(str, range(60_000)))
    rows = [(1, None), (None, "some text that is here"), (None, "some text that is here"), (2, ""), (3, ""), (4, " .,;"), (5, "one"), (6, "ONE!"), (7, long), (8, long + " more"), (9, "alone here"), (9, "alone here")]
    docs = frame(spark, rows)
    assert grouped(nd.near_duplicate_classes(docs).collect()) == [[5, 6], [7, 8]]
    left = nd.drop_near_duplicates(docs)
    assert left.columns == docs.columns and left.count() == len(rows) - 2
    empty = docs.limit(0)
    assert nd.near_duplicate_classes(empty).count() == 0 and nd.drop_near_duplicates(empty).count() == 0


def test_threshold_must_fit(spark):
    with pytest.raises(ValueError):
        nd.near_duplicate_classes(frame(spark, []), t=0)


def test_an_id_with_several_texts_joins_their_classes(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (2, b), (3, c), (4, a), (4, b), (5, "z z z")]
    assert grouped(nd.near_duplicate_classes(frame(spark, rows)).collect()) == [[1, 2, 4]]
