"""MinHash near-duplicate groups by an inverted join on signature coordinates.

Each document gets ``K`` MinHash coordinates over its word shingles and is
posted under every (coordinate, value) pair.  Two documents are near copies if
their postings collide in at least ``t`` of the ``K`` coordinates.

* *Exact copies of a signature* become one class, so a group of thousands of
  identical documents costs one posting list entry.
* *Skip*: a posting list of one document can never collide.  A document with
  fewer than ``t`` lists of two or more is skipped altogether.
* *Prefix*: of a document's ``n`` lists with company, ordered from the rarest,
  only the first ``n - t + 1`` are joined.  Two documents that collide ``t``
  times or more always meet in one of those (any ``t`` of ``n`` lists reach into
  the first ``n - t + 1``, and both order the common ones alike).
* *Equal lists*: a list is known by its length and the XOR of its documents'
  hashes, so lists with the same documents are one list and are joined once.
  (Should different lists ever share both, they are merged together, at no
  loss: a link is made only after the signatures were compared.)
* *Merge*: each list is merged once.  Documents found linked are not compared
  again, so a list holding one group of ``m`` copies takes about ``m``
  comparisons and yields ``m - 1`` verified links, not ``m**2 / 2`` pairs; the
  components of the links are exactly those of the full match graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import doc_text, materialize, read
from .components import classes_of
from .textkit import buffers, group_starts, shingle_hashes, slices, word_hashes

COORDINATES = 96
MIN_MATCHES = 46
SHINGLE = 3


def _families(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_231)
    return rng.integers(1, 2**63, k, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, k, dtype=np.uint64)


def signatures(docs: DataFrame, k: int = COORDINATES, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, sig): ``k`` little-endian 32-bit coordinates, for documents with a word."""
    a, b = _families(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            hashes, row = shingle_hashes(*word_hashes(*buffers(part.column("text"))), shingle)
            start = group_starts(row)
            sig = np.empty((len(start), k), "<u4")
            for i in range(k if len(start) else 0):
                sig[:, i] = np.minimum.reduceat(((hashes * a[i] + b[i]) >> np.uint64(32)).astype(np.uint32), start)
            raw = pa.py_buffer(sig.tobytes())
            offsets = pa.py_buffer((np.arange(len(start) + 1) * (4 * k)).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(row[start])), pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, offsets, raw])],
                ["doc_id", "sig"],
            )

    return doc_text(docs).filter("doc_id is not null and text is not null").mapInArrow(run, "doc_id long, sig binary")


def _postings(classes: DataFrame, k: int) -> DataFrame:
    """(token, rep) for every coordinate of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lift = np.arange(k, dtype=np.int64) << 32
        for part in batches:
            if part.num_rows:
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), "<u4").reshape(-1, k)
                token = (sig.astype(np.int64) | lift).ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token), pa.array(np.repeat(part.column("rep").to_numpy(), k))], ["token", "rep"]
                )

    return classes.select("rep", "sig").mapInArrow(run, "token long, rep long")


def merge_list(rep: np.ndarray, sig: np.ndarray, t: int) -> Iterator[tuple[int, int, int]]:
    """Links (doc, earlier doc, matches) that join one posting list's match graph."""
    order = np.argsort(rep, kind="stable")
    waiting = order
    while len(waiting) > 1:
        front, waiting = [waiting[0]], waiting[1:]
        while front and len(waiting):
            at = front.pop()
            matches = (sig[waiting] == sig[at]).sum(1)
            hit = matches >= t
            for i, m in zip(waiting[hit], matches[hit]):
                yield int(rep[i]), int(rep[at]), int(m)
                front.append(i)
            waiting = waiting[~hit]


def _links(prefixed: DataFrame, k: int, t: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(rep: np.ndarray, raw: list[bytes]) -> Iterator[tuple[int, int, int]]:
            if len(rep) > 1:
                yield from merge_list(rep, np.frombuffer(b"".join(raw), "<u4").reshape(-1, k), t)

        def lists() -> Iterator[tuple[int, int, int]]:
            token, reps, raws = None, [], []
            for part in batches:
                if not part.num_rows:
                    continue
                tokens, rep, raw = part.column("token").to_numpy(), part.column("rep").to_numpy(), part.column("sig").to_pylist()
                starts = group_starts(tokens)
                for lo, hi in zip(starts, [*starts[1:], len(tokens)]):
                    if tokens[lo] != token:
                        if reps:
                            yield from merged(np.concatenate(reps), raws)
                        token, reps, raws = tokens[lo], [], []
                    reps.append(rep[lo:hi])
                    raws += raw[lo:hi]
            if reps:
                yield from merged(np.concatenate(reps), raws)

        out: list[tuple[int, int, int]] = []
        for link in lists():
            out.append(link)
            if len(out) >= 50_000:
                yield _link_batch(out)
                out = []
        yield _link_batch(out)

    return prefixed.repartition("token").sortWithinPartitions("token").mapInArrow(run, "u long, v long, matches int")


def _link_batch(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    u, v, m = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(m, pa.int32())], ["u", "v", "matches"])


def near_duplicate_classes(docs: DataFrame, k: int = COORDINATES, t: int = MIN_MATCHES, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, class_id, n_links): one row for each document with a word.

    ``class_id`` is the least doc_id of the document's class, its own if it has no near
    copy.  ``n_links`` counts the verified links of its signature to different ones, of
    those that hold the class together; copies of one signature share them.

    Rows with a null id or null text, and texts without a word, have no row.  Rows that
    repeat a doc_id are one document; it has the links of all its rows.  An empty table
    gives an empty result.
    """
    if not 1 <= t <= k:
        raise ValueError("the match threshold must lie between 1 and the number of coordinates")
    marks = materialize(signatures(docs, k, shingle).withColumn("mark", F.unhex(F.md5("sig"))), "signatures")
    reps = marks.groupBy("mark").agg(F.min("doc_id").alias("rep"))
    members = materialize(marks.select("doc_id", "mark").join(reps, "mark").select(F.col("doc_id").alias("id"), "rep", "mark"), "members")
    firsts = members.filter("id = rep").select(F.col("id").alias("rep"), F.col("mark").alias("of")).distinct()
    classes = (
        marks.join(firsts, (marks["doc_id"] == firsts["rep"]) & (marks["mark"] == firsts["of"]), "left_semi")
        .select(F.col("doc_id").alias("rep"), "sig").dropDuplicates()
    )
    classes = materialize(classes, "classes")
    by_token = Window.partitionBy("token")
    shared = (
        _postings(classes, k)
        .select("rep", F.count(F.lit(1)).over(by_token).cast("int").alias("df"), F.expr("bit_xor(xxhash64(rep))").over(by_token).alias("list"))
        .filter("df > 1")
    )
    prefix = (
        shared.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "list"))).alias("lists"))
        # a document of several signatures has up to k lists for each; keep what any one of them needs
        .filter(F.size("lists") >= t)
        .select("rep", F.array_distinct(F.expr(f"slice(lists, 1, size(lists) - {t} + 1)")).alias("lists"))
    )
    prefixed = classes.select("rep", "sig").join(prefix, "rep").select(F.explode("lists.list").alias("token"), "rep", "sig")
    links = _links(prefixed, k, t).filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    return classes_of(members.select("id", "rep"), materialize(links, "links")).withColumnRenamed("id", "doc_id")


def drop_near_duplicates(docs: DataFrame, **how: int) -> DataFrame:
    """``docs`` with one document, the least doc_id, of each class; all columns kept.

    Rows with a null id, and those without a word, stay.
    """
    extra = near_duplicate_classes(docs, **how).filter("doc_id <> class_id").select(F.col("doc_id").alias("gone"))
    return docs.join(extra, docs["doc_id"] == extra["gone"], "left_anti")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(read(spark, sf_dir, "documents"))
