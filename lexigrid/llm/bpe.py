"""Byte-level BPE encoding in overlapping chunks, and decoding.

A text is cut into chunks of ``CHUNK`` characters that overlap by ``OVERLAP``.
Each chunk is split into pre-tokens by itself, so chunks are independent units
of work.  Stitching walks the chunks in order: the pre-token pattern never looks
behind, so wherever a boundary of the next chunk coincides with a sure boundary
of the text so far, the next chunk's pre-tokens are the text's own from there on.
Where an overlap holds no such point (one endless word), splitting goes on from
the last sure boundary until it meets the next chunk's.  The pieces are then
encoded; equal pieces are encoded once per worker.  Decoding joins the raw bytes
of the tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_text, read
from .textkit import slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK = 1 << 13
OVERLAP = 256
#: chunks of a long text that a task splits at once; the pattern is matched without the interpreter's lock
THREADS = 2
#: A pre-token that ends this far before its chunk's end can't depend on what follows the chunk:
#: the pattern looks at most three characters past a token.
MARGIN = 4
CACHE = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Pieces(dict):
    """piece -> its tokens as packed 32-bit integers; a bounded memory of what was encoded."""

    def __init__(self, core: tiktoken.Encoding):
        super().__init__()
        self.core = core

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = self.core.encode_ordinary(piece)
        packed = self[piece] = np.array(ids, "<i4").tobytes()
        return packed


class Codec:
    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN, threads: int = THREADS):
        ranks = load_ranks(path)
        self.pattern = regex.compile(pattern)
        self.pieces = Pieces(tiktoken.Encoding("piece", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}))
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pool = ThreadPoolExecutor(threads) if threads > 1 else None

    def _split(self, text: str) -> list[str]:
        return self.pattern.findall(text, concurrent=True)

    def pretokens(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
        """The pre-tokens of ``text``, the same as if it were split in one go."""
        if len(text) <= chunk + overlap:
            return self._split(text)
        bounds = [(at, min(at + chunk + overlap, len(text))) for at in range(0, len(text) - overlap, chunk)]
        parts = [text[a:b] for a, b in bounds]
        split = list((self.pool.map if self.pool else map)(self._split, parts))
        return self._stitch(text, bounds, split)

    def _stitch(self, text: str, bounds: list[tuple[int, int]], split: list[list[str]]) -> list[str]:
        out: list[str] = []
        at = 0  # the text is split for sure up to here
        for i, ((start, end), tokens) in enumerate(zip(bounds, split)):
            ends = start + np.cumsum([len(t) for t in tokens])
            begins = ends - np.fromiter(map(len, tokens), np.int64, len(tokens))
            j = int(np.searchsorted(begins, at))
            if j == len(begins) or begins[j] != at:
                # no common boundary yet: go on by hand until one turns up
                for token in self.pattern.finditer(text, at):
                    if at >= start:
                        j = int(np.searchsorted(begins, at))
                        if j < len(begins) and begins[j] == at:
                            break
                    if at >= end:
                        break
                    out.append(token.group())
                    at = token.end()
                j = int(np.searchsorted(begins, at))
                if j == len(begins) or begins[j] != at:
                    continue
            last = end == len(text)
            stop = len(tokens) if last else int(np.searchsorted(ends, end - MARGIN, side="right"))
            if i + 1 < len(bounds) and not last:
                # hand over at the first boundary that the next chunk shares
                nxt = bounds[i + 1][0] + np.cumsum([len(t) for t in split[i + 1]])
                shared = np.intersect1d(ends[j:stop], nxt, assume_unique=True)
                shared = shared[shared > bounds[i + 1][0]]
                if len(shared):
                    stop = int(np.searchsorted(ends, shared[0])) + 1
            if stop > j:
                out += tokens[j:stop]
                at = int(ends[stop - 1])
        while at < len(text):
            token = self.pattern.match(text, at)
            out.append(token.group())
            at = token.end()
        return out

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, self.pretokens(text))), "<i4")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(2)
def codec(path: str, threads: int = THREADS) -> Codec:
    """One codec for each worker process."""
    return Codec(path, threads=threads)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, threads: int = THREADS) -> DataFrame:
    """(doc_id, tokens, n_tokens, round_trip) for every row, in one pass without a shuffle.

    ``round_trip`` says that the tokens' bytes, joined, are the text's.  A null text
    has null tokens; an empty one has none.  Ids may be null or repeat.
    The vocabulary file must be at ``vocabulary`` on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary, threads)
        for part in slices(batches, "text"):
            ids, back = [], []
            for text in part.column("text").to_pylist():
                found = None if text is None else coder.encode(text)
                ids.append(found)
                back.append(None if text is None else coder.decode_bytes(found) == text.encode())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), _lists(ids), pa.array([None if x is None else len(x) for x in ids], pa.int64()), pa.array(back, pa.bool_())],
                ["doc_id", "tokens", "n_tokens", "round_trip"],
            )

    return doc_text(docs).mapInArrow(run, "doc_id long, tokens array<int>, n_tokens long, round_trip boolean")


def _lists(arrays: list[np.ndarray | None]) -> pa.Array:
    cuts = np.r_[0, np.cumsum([0 if x is None else len(x) for x in arrays])].astype(np.int32)
    flat = [x for x in arrays if x is not None]
    null = np.array([x is None for x in arrays], bool)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32), pa.int32()), mask=pa.array(null))


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, tokens); an id outside the vocabulary gives a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary)
        for part in batches:
            texts = []
            for ids in part.column("tokens").to_pylist():
                known = ids is not None and all(i in coder.tokens for i in ids)
                texts.append(b"".join(coder.tokens[i] for i in ids).decode("utf-8", "replace") if known else None)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("tokens").cast("array<int>").alias("tokens")).mapInArrow(
        run, "doc_id long, text string"
    )


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"))
