"""The pipeline against plain versions of its stages."""

import numpy as np
import tiktoken

import corpus_pipeline as cp
from lexigrid.llm import bpe, decontam, near_dup, toxicity

from brute import WORD, dropped_lines, signature_groups, substring_distance


def test_stages_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rejected = {r.doc_id for r in toxicity.score(docs, toxicity.train(docs, labels)).collect() if r.rejected}
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in rejected}
    gone = dropped_lines(sorted(rows.items()))
    clean = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(i, ())) for i, t in rows.items()}
    clean = {i: t for i, t in clean.items() if i not in gone or WORD.search(t.encode())}
    frame = spark.createDataFrame(sorted(clean.items()), "doc_id long, text string")
    marks = [(r.doc_id, np.frombuffer(bytes(r.sig), "<u4")) for r in near_dup.signatures(frame).collect()]
    for group in signature_groups(marks, near_dup.MIN_MATCHES):
        for i in group[1:]:
            del clean[i]
    items = decontam.normal_texts([r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
    items = [i for i in items if len(i) >= decontam.MIN_BYTES]
    for i, text in list(clean.items()):
        t = decontam.normal_texts([text])[0]
        if any(substring_distance_fast(m, t) for m in items):
            del clean[i]
    ranks = bpe.load_ranks(bpe.VOCABULARY)
    whole = tiktoken.Encoding("whole", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in cp.run(spark, sf_dir).collect()}
    assert set(got) == set(clean)
    for i, r in got.items():
        assert r.tokens == whole.encode_ordinary(clean[i]) and r.round_trip


def substring_distance_fast(item, text):
    """Whether the item is within its budget, by the full table over windows that share a piece."""
    k = decontam.budget(len(item), decontam.EDIT_RATE)
    for at, piece in decontam.pieces(item, k):
        found = text.find(piece)
        while found >= 0:
            part = text[max(0, found - at - k) : found - at + len(item) + k]
            if substring_distance(item, part) <= k:
                return True
            found = text.find(piece, found + 1)
    return False


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "byte_bpe"]
    assert all(stage(spark, docs.limit(0), sf_dir).count() == 0 for _, stage in cp.STAGES)


def test_odd_rows(spark, tmp_path):
    """Null ids, null and empty texts, repeated rows, a long text with a test item, further columns, no rows."""
    item = "which of the seven bright rivers runs north through the old salt town"
    long = " ".join(f"w{i} {'abcdefghij'[i % 10]}x" for i in range(20_000))
    own = " ".join("abcdefgh"[i % 8] + "mnopqrs"[i % 7] + "uvw"[i % 3] for i in range(60))
    rows = [
        (None, "a text without an id of its own"), (None, None), (1, None), (2, ""), (3, own), (3, own), (4, own), (5, f"{long.replace('w', 'q')} {item} and on"),
        (6, f"short {item}"), (7, long), (None, item), (8, "!!!"),
    ]
    rows = [(i, t, "en", "s", len(t or ""), 1, "g") for i, t in rows]
    kind = "doc_id long, text string, lang string, source string, n_chars long, lines int, gone string"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (None, "x" * 50), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(3, 1, 0), (None, 0, 1), (99, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = [(r.doc_id, r.n_tokens) for r in cp.run(spark, str(tmp_path)).collect()]
    ids = [i for i, _ in got]
    # rows 3 repeat an id and are one document; 4 is a copy; 5, 6 and the unnamed one hold a test item
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 3, 7, 8] and ids.count(None) == 2
    assert dict(got)[1] is None and dict(got)[2] == 0
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
