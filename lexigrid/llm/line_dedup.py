"""Line dedup with a fixed-depth log-template tree.

A line's tokens are its words (see ``textkit``); a token with a digit is a
variable field, unless its line is one or two such tokens alone.  The tree sends a line to a leaf by its token count and its
first ``DEPTH`` tokens.  In a leaf, lines join the template they agree with in
at least ``SIMILARITY`` of the positions; positions that differ become variable.
A template found in ``MIN_DOCS`` documents or more is recurring, one of
``LONG_TOKENS`` tokens or more, which two documents don't share by chance, already
in ``LONG_DOCS``: its lines are dropped from every document but the one with the
least doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_text, materialize, read
from .textkit import Hasher, _pow, buffers, group_starts, mix64, slices, word_spans

DEPTH = 3
SIMILARITY = 0.8
MIN_DOCS = 3
LONG_TOKENS = 8
LONG_DOCS = 2
MIN_TOKENS = 1

_FIELD = np.uint64(0)
_LINE_BASE = 0xA24BAED4963EE407


class Lines:
    """The lines of a slice that have ``min_tokens`` words or more."""

    def __init__(self, texts: pa.Array, depth: int, min_tokens: int):
        raw, off = buffers(texts)
        start, end, row = word_spans(raw, off)
        token = Hasher(raw)(start, end)
        digits = np.zeros(len(raw) + 1, np.int32)
        np.cumsum((raw >= 48) & (raw <= 57), out=digits[1:])
        field = digits[end] > digits[start]
        breaks = np.flatnonzero(raw == 10)
        at = row + np.searchsorted(breaks, start)  # a row adds one line to its breaks
        first = group_starts(at)
        n = np.diff(np.r_[first, len(at)])
        place = np.arange(len(at)) - np.repeat(first, n)
        if len(first):  # a line of one or two fields alone is no template: 12 is not 57
            field &= ~np.repeat(np.logical_and.reduceat(field, first) & (n < 3), n)
        token = np.where(field, _FIELD, token)
        term = token * _pow(_LINE_BASE, int(n.max()) if len(n) else 1)[place] if len(at) else token
        salt = n.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
        if len(first):
            line = mix64(np.add.reduceat(term, first) + salt)
            leaf = mix64(np.add.reduceat(np.where(place < depth, term, np.uint64(0)), first) ^ salt)
        else:
            line = leaf = np.zeros(0, np.uint64)
        keep = np.flatnonzero(n >= min_tokens)
        self.row = row[first][keep] if len(first) else row
        opening = np.arange(len(off) - 1) + np.searchsorted(breaks, off[:-1])
        self.line_no = (at[first][keep] - opening[self.row]).astype(np.int32) if len(first) else np.zeros(0, np.int32)
        self.line, self.leaf = line[keep].view(np.int64), leaf[keep].view(np.int64)
        self.prints = (token >> np.uint64(48)).astype("<u2")
        self.first, self.n = first[keep], n[keep]

    def prints_of(self, at: np.ndarray) -> pa.Array:
        """Two bytes for each token of the lines ``at``."""
        n = self.n[at]
        ends = np.cumsum(n)
        data = self.prints[np.repeat(self.first[at] - ends + n, n) + np.arange(n.sum())]
        offsets = (2 * np.r_[0, ends]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _distinct_lines(docs: DataFrame, depth: int, min_tokens: int) -> DataFrame:
    """(leaf, line, print, n): lines of each slice once, with their number there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            lines = Lines(part.column("text"), depth, min_tokens)
            if len(lines.line):
                _, at, n = np.unique(lines.line, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lines.leaf[at]), pa.array(lines.line[at]), lines.prints_of(at), pa.array(n.astype(np.int64))],
                    ["leaf", "line", "print", "n"],
                )

    return docs.mapInArrow(run, "leaf long, line long, print binary, n long")


def grow_leaf(prints: list[bytes], similarity: float) -> list[int]:
    """Template number of each line of one leaf; lines must come in a fixed order."""
    lines = np.frombuffer(b"".join(prints), "<u2").reshape(len(prints), -1)
    width = lines.shape[1]
    token, known = lines.astype(np.int32), lines != 0
    templates = np.full(lines.shape, -1, np.int32)  # -1: a variable position
    count, given = 0, []
    for i in range(len(lines)):
        if count:
            # a variable field agrees with a variable position of the template
            agree = ((templates[:count] == token[i]) | ((templates[:count] < 0) & ~known[i])).sum(1)
            best = int(agree.argmax())
            if agree[best] >= similarity * width:
                templates[best][templates[best] != token[i]] = -1
                given.append(best)
                continue
        templates[count] = np.where(known[i], token[i], -1)
        given.append(count)
        count += 1
    return given


def _whole_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The same rows, which come sorted by leaf, in tables that cut no leaf."""
    held, last = [], None
    for part in batches:
        if not part.num_rows:
            continue
        leaf = part.column("leaf").to_numpy()
        cut = int(group_starts(leaf)[-1])
        if cut or (held and leaf[0] != last):
            yield pa.Table.from_batches([*held, part.slice(0, cut)])
            held = []
        held.append(part.slice(cut))
        last = leaf[-1]
    if held:
        yield pa.Table.from_batches(held)


def _recurring(table: pa.Table, similarity: float, min_docs: int) -> Iterator[pa.RecordBatch]:
    """(line, template, needed) of the recurring lines of whole leaves; Python runs only for leaves of several lines."""
    leaf, line, n = (table.column(c).to_numpy() for c in ("leaf", "line", "n"))
    width = pc.binary_length(table.column("print")).to_numpy() // 2  # two bytes a token
    needed = np.where(width >= LONG_TOKENS, min(LONG_DOCS, min_docs), min_docs).astype(np.int32)
    starts = group_starts(leaf)
    hopeful = np.add.reduceat(n, starts) >= needed[starts]
    if not hopeful.any():
        return
    rows = np.flatnonzero(np.repeat(hopeful, np.diff(np.r_[starts, len(leaf)])))
    rows = rows[np.lexsort((line[rows], leaf[rows]))]
    leaf, line, n = leaf[rows], line[rows], n[rows]
    once = np.flatnonzero(np.r_[True, (leaf[1:] != leaf[:-1]) | (line[1:] != line[:-1])])
    n = np.add.reduceat(n, once)
    rows, leaf, line = rows[once], leaf[once], line[once]
    template, found = line.copy(), n.copy()
    starts = group_starts(leaf)
    ends = np.r_[starts[1:], len(leaf)]
    several = ends - starts > 1
    prints = table.column("print").take(pa.array(rows[np.repeat(several, ends - starts)])).to_pylist()
    at = 0
    for lo, hi in zip(starts[several], ends[several]):
        given = np.array(grow_leaf(prints[at : at + hi - lo], similarity))
        _, least = np.unique(given, return_index=True)  # lines come in order
        template[lo:hi] = line[lo:hi][least][given]
        found[lo:hi] = np.bincount(given, n[lo:hi])[given]
        at += hi - lo
    enough = found >= needed[rows]
    yield pa.RecordBatch.from_arrays([pa.array(line[enough]), pa.array(template[enough]), pa.array(needed[rows][enough])], ["line", "template", "needed"])


def _templates(distinct: DataFrame, similarity: float, min_docs: int) -> DataFrame:
    """(line, template, needed) of the templates with enough lines to recur in the documents needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_leaves(batches):
            yield from _recurring(table, similarity, min_docs)

    return distinct.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(run, "line long, template long, needed int")


def _occurrences(docs: DataFrame, depth: int, min_tokens: int) -> DataFrame:
    """(doc_id, line_no, line) of every line long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            lines = Lines(part.column("text"), depth, min_tokens)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(lines.row)), pa.array(lines.line_no), pa.array(lines.line)], ["doc_id", "line_no", "line"]
            )

    return docs.mapInArrow(run, "doc_id long, line_no int, line long")


def recurring_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY, depth: int = DEPTH, min_tokens: int = MIN_TOKENS
) -> DataFrame:
    """(doc, lines): the numbers, from 0, of the lines to drop from each document that has any."""
    texts = doc_text(docs).filter("doc_id is not null and text is not null")
    templates = _templates(_distinct_lines(texts, depth, min_tokens), similarity, min_docs)
    found = _occurrences(texts, depth, min_tokens).join(templates, "line").select("template", "needed", "doc_id", "line_no")
    # written, as both sides of the join below read it: leaves are grown once, occurrences hashed once
    per_doc = materialize(found.groupBy("template", "needed", "doc_id").agg(F.collect_set("line_no").alias("lines")), "holders")
    holders = per_doc.groupBy("template").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("keeper"))
    dropped = per_doc.join(holders, "template").filter("docs >= needed").filter("doc_id <> keeper")
    return dropped.groupBy(F.col("doc_id").alias("doc")).agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lines"))


def dedup_lines(docs: DataFrame, **how: float) -> DataFrame:
    """Every row with its ``text`` cleaned, and ``n_lines`` and ``n_dropped``.

    Lines end at a line feed.  Null ids and null texts pass unchanged (n_lines is
    null for a null text), as do lines without a word.  Rows that
    repeat a doc_id count as one document, and the line numbers found in any of them
    go from all of them.  Other columns are not carried; see ``drop_recurring_lines``.
    """
    gone = recurring_lines(docs, **how)
    texts = doc_text(docs)
    joined = texts.join(gone, texts["doc_id"] == gone["doc"], "left")
    return joined.select(
        "doc_id",
        F.when(F.col("lines").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("lines"))).alias("text"),
        (F.length("text") - F.length(F.translate("text", "\n", "")) + 1).cast("long").alias("n_lines"),
        F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_dropped"),
    )


def _without(text, lines):
    kept = F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains(lines, i))
    return F.array_join(kept, "\n")


def drop_recurring_lines(docs: DataFrame, **how: float) -> DataFrame:
    """``docs`` with cleaned texts, all columns kept and ``n_chars``, where there is one, renewed.

    A document of which no word is left goes: all it said is kept elsewhere.
    Documents that lose no line stay as they are, empty ones too.
    """
    gone = recurring_lines(docs, **how)
    joined = docs.join(gone, docs["doc_id"] == gone["doc"], "left")
    lines = gone["lines"]
    text = F.when(lines.isNull(), docs["text"]).otherwise(_without(docs["text"], lines))
    kept = joined.filter(lines.isNull() | text.rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]"))
    columns = []
    for name in docs.columns:
        column = docs[f"`{name}`"]
        if name == "text":
            column = text
        elif name == "n_chars":
            column = F.when(lines.isNull(), column).otherwise(F.length(text)).cast(docs.schema[name].dataType)
        columns.append(column.alias(name))
    return kept.select(*columns)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents"))
