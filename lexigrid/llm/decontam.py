"""Benchmark decontamination by pigeonhole edit matching.

A test item of ``m`` normalised bytes may occur in a document with up to
``k = floor(m * EDIT_RATE)`` edits.  Cut into ``k + 1`` pieces, an occurrence
with ``k`` edits leaves at least one piece untouched, so every occurrence lies
around an exact hit of a piece.  One Aho-Corasick pass over the text finds all
the hits.  The neighbourhood of a hit must hold the ``m - 3 - 4k`` common 4-grams
that any ``k`` edits leave, and is then verified with Myers' bit-parallel
distance, where the item must match whole and the text's ends are free.

Both sides are normalised alike: words, case-folded, joined by single spaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from .common import doc_text, read
from .textkit import buffers, normalise, slices

EDIT_RATE = 0.08
MIN_BYTES = 30
ITEMS_BYTES = 16 << 20


def normal_texts(texts: list[str]) -> list[bytes]:
    out, off = normalise(*buffers(pa.array(texts, pa.string())))
    raw = out.tobytes()
    return [raw[a:b] for a, b in zip(off[:-1], off[1:])]


def budget(m: int, rate: float) -> int:
    return int(m * rate + 1e-9)


def pieces(item: bytes, k: int) -> list[tuple[int, bytes]]:
    """``k + 1`` consecutive pieces, of lengths that differ by one at most, and their places."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def myers(item: bytes, text: bytes) -> tuple[int, int]:
    """Least edit distance of ``item`` to any substring of ``text``, and where the first such ends."""
    m = len(item)
    peq: dict[int, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, where = m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, where = score, j + 1
    return best, where


class Matcher:
    """The automaton of all pieces of some items, ready to search normalised bytes."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float):
        self.items = [(item_id, item, budget(len(item), rate)) for item_id, item in items]
        owners: dict[str, list[tuple[int, int]]] = {}
        for i, (_, item, k) in enumerate(self.items):
            for at, piece in pieces(item, k):
                owners.setdefault(piece.decode("latin-1"), []).append((i, at + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, owner in owners.items():
            self.automaton.add_word(piece, owner)
        if owners:
            self.automaton.make_automaton()

    def search(self, raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, item_id, distance) for each item within its budget somewhere in a row."""
        if not self.items or not len(raw):
            return
        whole = raw.tobytes()
        windows: dict[tuple[int, int], list[list[int]]] = {}
        hits = [(end, owners) for end, owners in self.automaton.iter(whole.decode("latin-1"))]
        if not hits:
            return
        rows = np.searchsorted(off, np.fromiter((e for e, _ in hits), np.int64, len(hits)), side="right") - 1
        for (end, owners), row in zip(hits, rows.tolist()):
            for i, until in owners:
                _, item, k = self.items[i]
                lo = end + 1 - until - k
                hi = end + 1 + len(item) - until + k
                seen = windows.setdefault((row, i), [])
                if seen and lo <= seen[-1][1]:
                    seen[-1][0], seen[-1][1] = min(seen[-1][0], lo), max(seen[-1][1], hi)
                else:
                    seen.append([lo, hi])
        for (row, i), spans in windows.items():
            item_id, item, k = self.items[i]
            least, grams = k + 1, {item[j : j + 4] for j in range(len(item) - 3)}
            for lo, hi in spans:
                part = whole[max(lo, int(off[row])) : min(hi, int(off[row + 1]))]
                if item in part:
                    least = 0
                    break
                common = sum(part[j : j + 4] in grams for j in range(len(part) - 3))
                if common >= len(item) - 3 - 4 * k:
                    least = min(least, myers(item, part)[0])
            if least <= k:
                yield row, item_id, least


def _item_groups(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[int, str]]]:
    """Items that fit in ``limit`` bytes together, group after group, until none is left."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter(
        "item_id is not null and text is not null"
    )
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = -(-total // limit)
    for g in range(groups):
        yield [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).distinct().collect()]


def contaminated(
    docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, min_bytes: int = MIN_BYTES, items_bytes: int = ITEMS_BYTES
) -> DataFrame:
    """(doc_id, item_id, distance): the least edit distance of each test item found in each document.

    Distances count bytes of the normalised texts.  Items under ``min_bytes``
    normalised bytes are too short to be evidence and match nothing; null ids
    and null texts, on either side, match nothing.  Rows that repeat an id
    give one result row, with the least distance.  Items are sent to the
    workers in groups of ``items_bytes`` at most; more items take more passes.
    """
    texts = doc_text(docs).filter("doc_id is not null and text is not null")
    spark = docs.sparkSession
    found = None
    for group in _item_groups(benchmark, items_bytes):
        items = [(i, t) for (i, _), t in zip(group, normal_texts([t for _, t in group])) if len(t) >= min_bytes]
        if not items:
            continue
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, rate)
            for part in slices(batches, "text"):
                rows = list(matcher.search(*normalise(*buffers(part.column("text")))))
                r, i, d = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(r, pa.int64())), pa.array(i, pa.int64()), pa.array(d, pa.int32())],
                    ["doc_id", "item_id", "distance"],
                )

        part = texts.mapInArrow(run, "doc_id long, item_id long, distance int")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "doc_id long, item_id long, distance int")
    return found.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, min_bytes: int = MIN_BYTES, items_bytes: int = ITEMS_BYTES) -> DataFrame:
    """``docs`` without the rows in which a test item was found; all columns kept, no shuffle.

    The verdict is taken on the text itself, so ids, null ones too, play no part in it; a
    null text stays.
    """
    for group in _item_groups(benchmark, items_bytes):
        items = [(i, t) for (i, _), t in zip(group, normal_texts([t for _, t in group])) if len(t) >= min_bytes]
        if not items:
            continue
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def clean(texts: Iterator[pa.Array], sent=sent) -> Iterator[pa.Array]:
            matcher = Matcher(sent.value, rate)
            for text in texts:
                keep = np.ones(len(text), bool)
                at = 0
                for part in slices(iter([pa.RecordBatch.from_arrays([text], ["text"])]), "text"):
                    for row, _, _ in matcher.search(*normalise(*buffers(part.column(0)))):
                        keep[at + row] = False
                    at += part.num_rows
                yield pa.array(keep)

        docs = docs.filter(F.arrow_udf(clean, "boolean", ArrowUDFType.SCALAR_ITER)(docs["text"].cast("string")))
    return docs


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
