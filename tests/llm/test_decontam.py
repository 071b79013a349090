import random

import numpy as np
import pyarrow as pa

from lexigrid.llm import decontam as dc
from lexigrid.llm.textkit import buffers, normalise

from brute import substring_distance


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "b", 1, 2) for i, t in rows], "doc_id long, text string, bad string, item_id int, distance int")


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, 5) for i, t in rows], "item_id long, text string, doc_id int")


def edited(text, n, rng):
    text = list(text)
    for _ in range(n):
        at, what = rng.randrange(len(text)), rng.random()
        if what < 0.34:
            text[at] = rng.choice("abcxyz")
        elif what < 0.67:
            del text[at]
        else:
            text.insert(at, rng.choice("abcxyz"))
    return "".join(text)


def test_equals_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 6)))
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 16)))) for i in range(12)]
    rows = []
    for i in range(40):
        text = " ".join(word() for _ in range(20))
        if i % 2:
            item = rng.choice(items)[1]
            text = text[:30] + " " + edited(item, rng.randint(0, len(item) // 8), rng) + " " + text[30:]
        rows.append((i, text.replace(" ", ",  ") if i % 5 == 0 else text))
    want = {}
    for i, text in rows:
        t = dc.normal_texts([text])[0]
        for j, item in items:
            m = dc.normal_texts([item])[0]
            d = substring_distance(m, t)
            if len(m) >= dc.MIN_BYTES and d <= dc.budget(len(m), dc.EDIT_RATE):
                want[i, j] = d
    assert len(want) > 8
    for size in (1 << 20, 60):
        got = dc.contaminated(docs_of(spark, rows), items_of(spark, items), items_bytes=size).collect()
        assert {(r.doc_id, r.item_id): r.distance for r in got} == want
    left = dc.drop_contaminated(docs_of(spark, rows), items_of(spark, items))
    assert sorted(r.doc_id for r in left.collect()) == sorted({i for i, _ in rows} - {i for i, _ in want})
    assert left.columns == ["doc_id", "text", "bad", "item_id", "distance"]


def test_myers_equals_the_table():
    rng = random.Random(1)
    for _ in range(60):
        a = bytes(rng.choices(b"abc", k=rng.randint(1, 70)))
        b = bytes(rng.choices(b"abc", k=rng.randint(0, 90)))
        assert dc.myers(a, b)[0] == substring_distance(a, b)


def test_normalising():
    out, off = normalise(*buffers(pa.array(["A  b-C", None, "", "...", "É\nx"])))
    assert [out[a:b].tobytes().decode() for a, b in zip(off[:-1], off[1:])] == ["a b c", "", "", "", "é x"]
    assert isinstance(out, np.ndarray)


def test_odd_rows(spark):
    item = "what is the boiling point of water at sea level"
    rows = [(1, None), (None, item), (2, ""), (3, "x " * 200_000 + item + " y" * 200_000), (4, item), (4, item), (5, "unrelated")]
    items = [(1, item), (1, item), (None, item), (2, None), (3, ""), (4, "too short")]
    got = dc.contaminated(docs_of(spark, rows), items_of(spark, items)).collect()
    assert sorted((r.doc_id, r.item_id, r.distance) for r in got) == [(3, 1, 0), (4, 1, 0)]
    assert dc.drop_contaminated(docs_of(spark, rows), items_of(spark, items)).count() == 3  # the text tells, not the id
    assert dc.contaminated(docs_of(spark, []), items_of(spark, items)).count() == 0
    assert dc.contaminated(docs_of(spark, rows), items_of(spark, [])).count() == 0
    assert dc.drop_contaminated(docs_of(spark, rows), items_of(spark, [])).count() == len(rows)
