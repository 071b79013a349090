"""Language identification by sparse multinomial logistic regression.

Features are character n-grams of ``ORDERS``, hashed into ``BUCKETS``; letters are
case-folded and every run of other characters is one space.  A feature's value is
``SCALE`` x its share of the document's n-grams x its inverse document frequency,
which is counted over all documents.  The model is trained with
follow-the-regularised-leader (per-coordinate rates, L1 and L2 penalties) on at
most ``TRAIN_DOCS`` labelled documents with distinct texts, spread over the languages, those first by a hash of the text;
one in ``HELD_OUT`` of them is kept from training and sets the temperature by
which the scores are divided.  Every document is then scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_text, read
from .textkit import buffers, slices

ORDERS = (1, 2, 3)
BUCKET_BITS = 17
BUCKETS = 1 << BUCKET_BITS
SCALE = 30.0
TRAIN_DOCS = 3_000
HELD_OUT = 5
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
UNKNOWN = "und"

_SPACE = 32


def _fold_table() -> np.ndarray:
    """Lower case of every letter of the basic plane; a space for all else."""
    table = np.full(1 << 16, _SPACE, np.int32)
    for c in range(1 << 16):
        char = chr(c)
        if char.isalpha():
            low = char.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_FOLD = _fold_table()


def code_points(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts and the row of each."""
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    row = np.searchsorted(off, lead, side="right") - 1
    first = raw[lead].astype(np.int32)
    wide = np.flatnonzero(first >= 0xC0)
    if len(wide):
        padded = np.r_[raw, np.zeros(3, np.uint8)]
        at, b = lead[wide], first[wide]
        b1, b2, b3 = ((padded[at + j] & 0x3F).astype(np.int32) for j in (1, 2, 3))
        two, three, four = (b & 0x1F) << 6 | b1, (b & 0x0F) << 12 | b1 << 6 | b2, (b & 0x07) << 18 | b1 << 12 | b2 << 6 | b3
        first[wide] = np.where(b < 0xE0, two, np.where(b < 0xF0, three, four))
    return first, row


def char_ngrams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every n-gram occurrence; a row without a letter has none."""
    point, row = code_points(raw, off)
    low = point < 1 << 16
    point = np.where(low, _FOLD[np.where(low, point, 0)], point)
    blank = point == _SPACE
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1] & (row[1:] == row[:-1])
    point, row = point[keep].astype(np.uint32), row[keep]
    flat, rows = [], []
    for n in ORDERS:
        size = len(point) - n + 1
        if size <= 0:
            continue
        h = np.full(size, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for j in range(n):
            h = (h ^ point[j : j + size]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        whole = row[:size] == row[n - 1 :]
        if n == 1:
            whole = point != _SPACE
        flat.append(((h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BUCKET_BITS))[whole].astype(np.int32))
        rows.append(row[:size][whole])
    if not flat:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(flat), np.concatenate(rows)


def counted(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, occurrences) of the distinct n-grams of each row."""
    flat, row = char_ngrams(raw, off)
    key = row.astype(np.int64) << BUCKET_BITS | flat
    key.sort()
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[at] >> BUCKET_BITS, key[at] & (BUCKETS - 1), np.diff(np.r_[at, len(key)])


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Documents with each bucket, and documents, over all rows; at most ``BUCKETS`` + 1 numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS + 1, np.int64), 0
        for part in slices(batches, "text"):
            _, bucket, _ = counted(*buffers(part.column("text")))
            df[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
            n += part.num_rows
        df[BUCKETS] = n
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some])], ["bucket", "n"])

    found = texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(BUCKETS + 1, np.int64)
    df[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return df[:BUCKETS], int(df[BUCKETS])


@dataclass
class Model:
    languages: list[str]
    #: BUCKETS x languages: weight x inverse document frequency x scale
    table: np.ndarray
    bias: np.ndarray
    temperature: float


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """(weights BUCKETS x k, bias) after ``epochs`` passes over (buckets, values) rows in the given order."""
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))
    penalty = np.full((BUCKETS + 1, 1), L1)
    penalty[BUCKETS] = 0  # the bias

    def weights(at: np.ndarray | slice) -> np.ndarray:
        return -np.sign(z[at]) * np.maximum(np.abs(z[at]) - penalty[at], 0) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(epochs):
        for (bucket, value), label in zip(rows, y):
            at, x = np.r_[bucket, BUCKETS], np.r_[value, 1.0]
            w = weights(at)
            error = softmax(x @ w)
            error[label] -= 1
            g = x[:, None] * error
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    w = weights(slice(None))
    return w[:BUCKETS], w[BUCKETS]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of ``logits``, between 0.05 and 20, under which the labels are likeliest."""
    if not len(y):
        return 1.0

    def loss(log_t: float) -> float:
        return float(-np.log(softmax(logits / np.exp(log_t))[np.arange(len(y)), y] + 1e-300).sum())

    lo, hi, gold = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - gold * (hi - lo), lo + gold * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def quotas(counts: dict[str, int], bound: int) -> dict[str, int]:
    """Texts to take of each language: all of a rare one, equal numbers of the others; the commonest ``bound`` languages only."""
    out, left = {}, bound
    some = sorted(sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:bound], key=lambda c: (c[1], c[0]))
    for i, (lang, n) in enumerate(some):
        out[lang] = min(n, left // (len(some) - i))
        left -= out[lang]
    return out


def _sample(docs: DataFrame, bound: int) -> pa.Table:
    """(mark, lang, bucket[], n[]) of at most ``bound`` training documents, featurised on the executors.

    A text counts once for a language however often it stands there; ``mark`` is its hash.
    """
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter(
        "lang is not null and text is not null"
    ).withColumn("mark", F.xxhash64("text"))
    spark = docs.sparkSession
    # only the marks are moved and ordered
    marks = rows.select("lang", "mark").distinct()
    by_lang = marks.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(bound).collect()
    counts = {r.lang: r.n for r in by_lang}
    # a mark is uniform, so this share of the marks' range holds about the quota
    shares = [(lang, q / counts[lang]) for lang, q in quotas(counts, bound).items()]
    wanted = spark.createDataFrame(shares, "lang string, share double")
    place = (F.col("mark") / F.lit(2.0**64)) + 0.5
    sample = marks.join(F.broadcast(wanted), "lang").filter(place <= F.col("share"))
    # chance may take a few too many of the common languages
    sample = sample.orderBy(F.desc("share"), F.xxhash64("lang", "mark"), "lang").limit(bound).select("lang", "mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            row, bucket, n = counted(*buffers(part.column("text")))
            cuts = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=part.num_rows))].astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (bucket, n)]
            yield pa.RecordBatch.from_arrays([part.column("mark"), part.column("lang"), *lists], ["mark", "lang", "bucket", "n"])

    kept = rows.join(F.broadcast(sample), ["lang", "mark"]).groupBy("lang", "mark").agg(F.min("text").alias("text"))
    return kept.mapInArrow(run, "mark long, lang string, bucket array<int>, n array<int>").toArrow()


def train(docs: DataFrame, bound: int = TRAIN_DOCS) -> Model | None:
    """The model of the languages in ``lang``; None without a labelled text that has a letter."""
    df, n_docs = document_frequencies(doc_text(docs).filter("text is not null"))
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    found = _sample(docs, bound)
    order = np.lexsort((found["lang"].to_pylist(), found["mark"].to_numpy())) if found.num_rows else []
    rows, labels = [], []
    buckets, counts, langs = (found[c].combine_chunks() if found.num_rows else [] for c in ("bucket", "n", "lang"))
    for i in order:
        bucket, n = (np.asarray(x[int(i)].values) for x in (buckets, counts))
        if len(bucket):
            rows.append((bucket, SCALE * n / n.sum() * idf[bucket]))
            labels.append(langs[int(i)].as_py())
    if not rows:
        return None
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    held = np.arange(len(y)) % HELD_OUT == HELD_OUT - 1
    w, bias = ftrl([r for r, h in zip(rows, held) if not h], y[~held], len(languages))
    logits = np.array([value @ w[bucket] + bias for (bucket, value), h in zip(rows, held) if h]).reshape(-1, len(languages))
    return Model(languages, (w * (SCALE * idf)[:, None]).astype(np.float32), bias, fit_temperature(logits, y[held]))


def probabilities(model: Model, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows x languages of calibrated probabilities, and which rows have a letter."""
    flat, row = char_ngrams(raw, off)
    n = len(off) - 1
    total = np.bincount(row, minlength=n)
    some = model.table.any(1)[flat]
    flat, row = flat[some], row[some]
    sums = [np.bincount(row, model.table[flat, k], minlength=n) for k in range(len(model.languages))]
    z = np.array(sums).T / np.maximum(total, 1)[:, None] + model.bias
    return softmax(z / model.temperature), total > 0


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, language, confidence) for every row, in one pass without a shuffle.

    A null text has a null language; a text without a letter, and every text if
    nothing could be trained, is ``und`` with a null confidence.  Ids may be null or
    repeat; each row is judged by its own text.  Equal scores give the language
    first by name.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for part in slices(batches, "text"):
            text = part.column("text")
            null = np.asarray(text.is_null())
            if model is None:
                names, best, lettered = np.array([UNKNOWN], object)[np.zeros(len(null), int)], np.zeros(len(null)), np.zeros(len(null), bool)
            else:
                p, lettered = probabilities(model, *buffers(text))
                names = np.where(lettered, np.array(model.languages, object)[p.argmax(1)], UNKNOWN)
                best = p.max(1)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.where(null, None, names), pa.string()), pa.array(best, mask=null | ~lettered)],
                ["doc_id", "language", "confidence"],
            )

    return doc_text(docs).mapInArrow(run, "doc_id long, language string, confidence double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return identify(docs, train(docs))
