"""Toxicity by a classifier chain of linear models.

The categories are label columns, in chain order.  The model of a category sees
the document's features and the probabilities of the categories before it.
While training, those come from models that have not seen the document
(``FOLDS``-fold out-of-fold predictions), so later models meet in training what
they meet in use.

Features are the presence of words and of word beginnings, chosen by chi-square
against the label, and four shares of the text's bytes.  The chain is fitted on at most ``TRAIN_DOCS``
labelled documents, those first by the hash of their id; every document is scored.
Repeated rows, and documents with the same text, train once (under the least id).

The tables label one toxicity category, ``toxic``, and the quality of a text, which
is the chain's first link; further label columns make further links.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_text, read
from .linear import chi_square, fit_logistic, sigmoid
from .textkit import Hasher, buffers, slices, word_spans

#: category -> (label column, the value that means yes), in chain order
CATEGORIES = {"low_quality": ("quality", 0), "toxic": ("toxic", 1)}
TRAIN_DOCS = 8_000
FOLDS = 5
MAX_WORDS = 200
BEGINNINGS = (5, 6, 7, 8)  # bytes
MIN_CHI = 25.0
MIN_PRESENT = 4
RIDGE = 0.1


def _shares(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Per row: shares of capitals, digits, ASCII signs; log of the length."""
    n = len(off) - 1
    size = np.diff(off)
    out = np.zeros((n, 4))
    sign = (raw < 128) & ~((raw >= 48) & (raw <= 57) | (raw >= 65) & (raw <= 90) | (raw >= 97) & (raw <= 122) | (raw == 32) | (raw == 10))
    for i, kind in enumerate(((raw >= 65) & (raw <= 90), (raw >= 48) & (raw <= 57), sign)):
        sums = np.r_[0, np.cumsum(kind, dtype=np.int64)]
        out[:, i] = (sums[off[1:]] - sums[off[:-1]]) / np.maximum(size, 1)
    out[:, 3] = np.log1p(size) / 10
    return out


def word_features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hash and row of every word, and of the beginnings of longer words."""
    start, end, row = word_spans(raw, off)
    hasher = Hasher(raw)
    flat, rows = [hasher(start, end).astype(np.uint32).view(np.int32)], [row]
    for i, n in enumerate(BEGINNINGS, 1):
        longer = end - start > n
        at = start[longer]
        flat.append(hasher(at, at + n).astype(np.uint32).view(np.int32) ^ np.int32(i))  # a beginning is not the word it spells
        rows.append(row[longer])
    return np.concatenate(flat), np.concatenate(rows)


@dataclass
class Link:
    """One category's model: its words, and weights for words, shares, earlier categories, intercept."""

    words: np.ndarray
    weights: np.ndarray
    #: probability from which the category is assigned
    threshold: float


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the greatest F1, half way (in log-odds) between the scores around it.

    Without a case of the category nothing can be told, and 1 assigns it to no document;
    with nothing but cases it is 0.5.
    """
    if not len(y) or y.max() == 0:
        return 1.0
    if y.min() == 1:
        return 0.5
    order = np.argsort(-p, kind="stable")
    p, hits = p[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[:-1] == p[1:]] = -1  # no cut between equal scores
    at = int(f1.argmax())
    z = np.log(p / (1 - p))
    return float(sigmoid((z[at] + z[at + 1]) / 2)) if at + 1 < len(p) else float(p[at])


def _design(words: np.ndarray, flat: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """0/1 matrix of the rows' words among ``words`` (sorted hashes)."""
    x = np.zeros((n, len(words)))
    if len(words) and len(flat):
        at = np.minimum(np.searchsorted(words, flat), len(words) - 1)
        hit = words[at] == flat
        x[row[hit], at[hit]] = 1
    return x


def choose_words(vocabulary: np.ndarray, code: np.ndarray, row: np.ndarray, used: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The words, sorted, that tell most about ``y`` among the rows ``used``."""
    present = np.bincount(code[used[row]], minlength=len(vocabulary))
    positive = np.bincount(code[(used & (y > 0))[row]], minlength=len(vocabulary))
    chi = chi_square(present, positive, int(used.sum()), int(y[used].sum()))
    chi[(present < MIN_PRESENT) | (chi < MIN_CHI)] = 0
    best = np.lexsort((vocabulary, -chi))[:MAX_WORDS]
    return np.sort(vocabulary[best[chi[best] > 0]])


def fit_chain(flat: np.ndarray, row: np.ndarray, shares: np.ndarray, labels: np.ndarray) -> list[Link]:
    """Fit the chain; ``flat`` and ``row`` list each row's distinct words, ``labels`` is rows x categories.

    A label of -1 is unknown; such a row doesn't train that category.  A fold's
    predictions come from words chosen and weights fitted without that fold.
    """
    n = len(shares)
    chain: list[Link] = []
    earlier = np.zeros((n, 0))
    fold = np.arange(n) % FOLDS
    # the driver's memory holds each occurrence as a 32-bit code
    coded = pa.array(flat).dictionary_encode()
    vocabulary, code = coded.dictionary.to_numpy(), coded.indices.to_numpy()

    def fit(used: np.ndarray, y: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words and weights from the rows ``used``, and the probabilities of the rows ``asked``."""
        words = choose_words(vocabulary, code, row, used, y)
        x = np.c_[_design(words, flat, row, n), shares, earlier]
        w = fit_logistic(x[used], y[used], RIDGE)
        return words, w, sigmoid(x[asked] @ w[:-1] + w[-1])

    for c in range(labels.shape[1]):
        known = labels[:, c] >= 0
        y = (labels[:, c] == 1).astype(float)
        ours = np.zeros(n)
        for f in range(FOLDS):
            ours[fold == f] = fit(known & (fold != f), y, fold == f)[2]
        words, weights, _ = fit(known, y, known)
        chain.append(Link(words, weights, best_threshold(ours[known], y[known])))
        earlier = np.c_[earlier, ours]
    return chain


def apply_chain(chain: list[Link], raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows x categories of probabilities."""
    n = len(off) - 1
    flat, row = word_features(raw, off)
    shares = _shares(raw, off)
    wanted = np.zeros(1 << 16, bool)
    for link in chain:
        wanted[link.words & 0xFFFF] = True
    some = wanted[flat & 0xFFFF]
    flat, row = flat[some], row[some]
    out = np.zeros((n, 0))
    for link in chain:
        x = np.c_[_design(link.words, flat, row, n), shares, out]
        out = np.c_[out, sigmoid(x @ link.weights[:-1] + link.weights[-1])]
    return out


def _training_rows(docs: DataFrame, labels: DataFrame, categories: dict[str, tuple[str, int]], bound: int) -> pa.Table:
    yes = [
        F.coalesce((F.col(column) == value).cast("int"), F.lit(-1)).alias(f"y{i}") for i, (column, value) in enumerate(categories.values())
    ]
    # one row for each id: a document labelled twice takes its greatest label, one with several texts the least hash
    marks = labels.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), *yes).groupBy("doc_id").agg(
        *[F.max(f"y{i}").alias(f"y{i}") for i in range(len(yes))]
    )
    texts = doc_text(docs).filter("doc_id is not null and text is not null").withColumn("same", F.xxhash64("text"))
    ids = texts.select("doc_id", "same").groupBy("doc_id").agg(F.min("same").alias("same"))
    # only numbers are joined and ordered; one id for each text; then the bound holds whatever repeats
    first = ids.join(marks, "doc_id").groupBy("same").agg(F.min(F.struct("doc_id", *[f"y{i}" for i in range(len(yes))])).alias("d")).select("same", "d.*")
    sample = first.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)

    names = [f"y{i}" for i in range(len(yes))]

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            raw, off = buffers(part.column("text"))
            flat, row = word_features(raw, off)
            order = np.lexsort((flat, row))
            flat, row = flat[order], row[order]
            new = np.ones(len(flat), bool)
            new[1:] = (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])
            flat, row = flat[new], row[new]
            cuts = np.r_[0, np.cumsum(np.bincount(row, minlength=part.num_rows))].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("same"),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat)),
                    pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * 4), pa.array(_shares(raw, off).ravel())),
                    *[part.column(y) for y in names],
                ],
                ["doc_id", "same", "words", "shares", *names],
            )

    schema = "doc_id long, same long, words array<int>, shares array<double>, " + ", ".join(f"{y} int" for y in names)
    found = texts.join(F.broadcast(sample), ["doc_id", "same"]).groupBy("doc_id", "same", *names).agg(F.min("text").alias("text"))
    # executors do the featurising; the driver gets ``bound`` rows at most
    return found.mapInArrow(words, schema).toArrow()


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, tuple[str, int]] = CATEGORIES, bound: int = TRAIN_DOCS) -> list[Link]:
    rows = _training_rows(docs, labels, categories, bound).combine_chunks()
    names = [f"y{i}" for i in range(len(categories))]
    ids, same = (rows[c].to_numpy() for c in ("doc_id", "same"))
    order = np.lexsort((ids, same))
    order = order[np.r_[True, same[order][1:] != same[order][:-1]]] if len(order) else order
    # a fixed order, so that folds don't depend on how the rows arrived
    rows = rows.take(pa.array(order))
    lists = rows["words"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    n = rows.num_rows
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(n, dtype=np.int32), lists.value_lengths().to_numpy(zero_copy_only=False)) if n else np.zeros(0, np.int32)
    shares = np.array(rows["shares"].to_pylist(), float).reshape(n, 4)
    labelled = np.column_stack([rows[y].to_numpy() for y in names]) if n else np.zeros((0, len(names)), int)
    return fit_chain(flat, row, shares, labelled)


def score(docs: DataFrame, chain: list[Link], categories: dict[str, tuple[str, int]] = CATEGORIES) -> DataFrame:
    """(doc_id, p_<category>..., rejected) for every row; the last category decides.

    It rejects from the threshold that did best on the out-of-fold predictions.

    A null text has null probabilities and is not rejected; a text without words
    is scored by its other features.  Rows that repeat an id are scored each.
    """
    names = [f"p_{c}" for c in categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            text = part.column("text")
            p = apply_chain(chain, *buffers(text))
            null = np.asarray(text.is_null())
            columns = [pa.array(p[:, i], mask=null) for i in range(len(names))]
            rejected = pa.array((p[:, -1] >= chain[-1].threshold) & ~null)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns, rejected], ["doc_id", *names, "rejected"])

    return doc_text(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{p} double" for p in names) + ", rejected boolean")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the chain rejects; all columns kept, no shuffle.

    The verdict is taken on the text itself, so ids play no part in it.
    """
    chain = train(docs, labels)

    def verdicts(text: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text], ["text"])
        keep = [
            (apply_chain(chain, *buffers(part.column(0)))[:, -1] < chain[-1].threshold) | np.asarray(part.column(0).is_null())
            for part in slices(iter([batch]), "text")
        ]
        return pa.array(np.concatenate(keep) if keep else np.zeros(0, bool))

    keep = F.arrow_udf(verdicts, "boolean")
    return docs.filter(keep(docs["text"]))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))
