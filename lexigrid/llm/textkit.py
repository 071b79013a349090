"""Vectorised text primitives over Arrow string buffers.

Every function here works on the UTF-8 bytes of a whole slice of rows at once,
so the cost per word is a handful of numpy operations and no Python object is
made per word.  A *word* is a maximal run of ASCII letters, ASCII digits and
non-ASCII bytes; ASCII case is folded, all other ASCII bytes separate words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

_rng = np.random.default_rng(0x5EED)
_WORD = np.zeros(256, bool)
_WORD[128:] = True
for _lo, _hi in ((48, 57), (65, 90), (97, 122)):
    _WORD[_lo : _hi + 1] = True
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)[_FOLD]
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_powers: dict[str, np.ndarray] = {}


def _pow(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, np.uint64(base))
        out[0] = 1
        have = np.multiply.accumulate(out)
        if size <= 4 * SLICE_BYTES:
            _powers[key] = have
    return have[:n]


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the rows and the n+1 offsets into them; nulls are empty."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, off = buffers(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (exclusive) and row of every word, in reading order."""
    inside = _WORD[raw]
    if not inside.any():
        z = np.zeros(0, np.int64)
        return z, z, z
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(raw))]
    first[edge] |= inside[edge]
    last[edge - 1] |= inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


class Hasher:
    """64-bit hashes of stretches of the folded bytes; equal stretches hash alike anywhere."""

    def __init__(self, raw: np.ndarray):
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * _pow(_BASE, len(raw)), out=self.sums[1:])
        self.undo = _pow(_BASE_INV, len(raw))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not len(start):
            return np.zeros(0, np.uint64)
        return mix64((self.sums[end] - self.sums[start]) * self.undo[start])


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word."""
    start, end, row = word_spans(raw, off)
    return Hasher(raw)(start, end), row


def shingle_hashes(words: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``width`` words; a shorter row is one shingle."""
    n = len(words)
    if not n:
        return words, row
    acc = words.copy()
    factor = 1
    whole = np.ones(n, bool)
    for j in range(1, width):
        factor = factor * 0xD1342543DE82EF95 % 2**64
        same = np.zeros(n, bool)
        same[: n - j] = row[j:] == row[: n - j]
        part = np.zeros(n, np.uint64)
        part[: n - j] = words[j:] * np.uint64(factor)
        acc += np.where(same, part, np.uint64(0))
        whole = same
    opens = np.ones(n, bool)
    opens[1:] = row[1:] != row[:-1]
    keep = whole | opens
    return mix64(acc[keep]), row[keep]


def group_starts(row: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    if not len(row):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, row[1:] != row[:-1]])


def normalise(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of every row, case-folded (ASCII and Latin-1 letters), joined by single spaces.

    Returns bytes and offsets; a row neither begins nor ends with a space.
    """
    inside = _WORD[raw]
    start, end, row = word_spans(raw, off)
    folded = _FOLD[raw].astype(np.uint8)
    two = np.zeros(len(raw), bool)
    two[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    folded[two] += 0x20
    size = end - start
    inner = np.zeros(len(start), bool)
    if len(start):
        inner[1:] = row[1:] == row[:-1]
    width = size + inner
    out = np.full(int(width.sum()), 32, np.uint8)
    if len(start):
        shift = np.cumsum(width) - size - start
        out[np.flatnonzero(inside) + np.repeat(shift, size)] = folded[inside]
    per_row = np.bincount(row, width, minlength=len(off) - 1).astype(np.int64)
    return out, np.r_[0, np.cumsum(per_row)]
