from collections import defaultdict

import numpy as np
import pytest

from lexigrid.llm import embed_dedup as ed

from brute import Union

SCHEMA = "vec_id long, embedding array<float>, unit string, cell int, rep int, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "u", 1, 2, 3) for i, v in rows], SCHEMA)


def vectors(n=600, d=16, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d))
    out = []
    for i in range(n):
        v = base[i]
        if i % 3 == 1:
            near = base[i - 1] / np.linalg.norm(base[i - 1])
            noise = rng.normal(size=d)
            noise -= noise @ near * near
            c = rng.choice([1.0, 0.999, 0.97, 0.955, 0.93])
            v = (c * near + np.sqrt(1 - c * c) * noise / np.linalg.norm(noise)) * rng.uniform(0.5, 2)
        out.append((i, v.astype(np.float32)))
    return out


def grouped(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.class_id].append(r.vec_id)
    assert all(min(g) == c for c, g in out.items())
    return sorted(sorted(g) for g in out.values() if len(g) > 1)


def test_recall_and_precision_against_brute_force(spark):
    rows = vectors()
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pairs = {(int(a), int(b)) for a, b in np.argwhere(np.triu(x @ x.T >= ed.THRESHOLD, 1))}
    got = ed.near_duplicate_vectors(frame(spark, rows)).collect()
    assert sorted(r.vec_id for r in got) == list(range(len(rows)))
    found, want = {r.vec_id: r.class_id for r in got}, Union()
    for a, b in pairs:
        want.join(a, b)
    root = {i: g[0] for g in want.groups() for i in g}
    assert len(pairs) > 100
    assert np.mean([a in found and found[a] == found.get(b) for a, b in pairs]) >= 0.95
    for g in grouped(got):  # no class joins what is apart
        assert len({root[i] for i in g}) == 1


def test_copies_form_one_group(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=8)
    rows = [(i, v * (i + 1)) for i in range(50)] + [(100 + i, v + rng.normal(size=8) * 1e-3) for i in range(200)] + [(900, -v)]
    got = ed.near_duplicate_vectors(frame(spark, rows)).collect()
    assert [len(g) for g in grouped(got)] == [250]


def test_odd_rows(spark):
    a, b = [1, 0, 0, 0], [0, 1, 0, 0]
    rows = [(1, a), (2, [2, 0, 0, 0]), (3, None), (None, a), (4, [0, 0, 0, 0]), (5, [float("nan"), 1, 0, 0]), (6, [1, None, 0, 0]), (7, a + a), (8, []), (9, b), (9, b), (10, [float("inf"), 0, 0, 0]), (11, [1e-30, 0, 0, 0])]
    got = ed.near_duplicate_vectors(frame(spark, rows)).collect()
    assert grouped(got) == [[1, 2, 11]] and sorted(r.vec_id for r in got) == [1, 2, 9, 11]
    assert ed.near_duplicate_vectors(frame(spark, [])).count() == 0
    assert ed.near_duplicate_vectors(frame(spark, [(1, [0, 0]), (2, None)])).count() == 0
    assert grouped(ed.near_duplicate_vectors(frame(spark, [(1, [3]), (2, [5]), (3, [-1])])).collect()) == [[1, 2]]


def test_visits_are_the_nearest_cells():
    rng = np.random.default_rng(1)
    index = ed.Index(rng.normal(size=(9, 4)), rng.normal(size=(7, 4)), 11)
    x = rng.normal(size=(20, 8))
    a, b = index.distances(x)
    for i, cells in enumerate(index.visited(x)):
        sums = (a[i][:, None] + b[i]).ravel()
        assert sorted(cells) == sorted(sums.argsort()[:11])
    assert index.visits == 11


@pytest.mark.parametrize("blocks", [(3, 5)])
def test_full_cells_are_cut(spark, monkeypatch, blocks):
    monkeypatch.setattr(ed, "MEMBERS", blocks[0])
    monkeypatch.setattr(ed, "QUERIES", blocks[1])
    rng = np.random.default_rng(4)
    v = rng.normal(size=8)
    rows = [(i, v + rng.normal(size=8) * 1e-3) for i in range(60)]
    assert [len(g) for g in grouped(ed.near_duplicate_vectors(frame(spark, rows)).collect())] == [60]
