"""Language-model scoring with a weighted backoff automaton.

The symbols are the words of a text (case-folded runs of letters, digits and
non-ASCII bytes) and its signs (every other byte that isn't white space), with
``ORDER - 1`` begin marks before them and an end mark after.  All n-grams of
orders 1 to ``ORDER`` of all documents are counted, none is cut off, so what the
model holds grows with the text.  Every n-gram is an arc of the automaton, from the
state of its context to the state of its last ``ORDER - 1`` symbols.  Its weight is
the log-probability under Dirichlet smoothing: ``(n + PRIOR * lower) / (context +
PRIOR)``, where ``lower`` is the probability one order below, and below the first
order a word's spelling, one of 257 bytes or ends at a time, so that no symbol is
impossible.  A state that lacks the next symbol is left by its failure arc, with
weight ``PRIOR / (context + PRIOR)``, to the state of its longest proper suffix.

Documents are scored in blocks.  A block counts its own n-grams and sends each
one's hash and number, packed by ranges of the hash, to the range's task.
That adds them up and answers only for n-grams that several blocks hold; the others'
numbers are the block's own.  So no worker and no broadcast holds the model of
the whole corpus, an n-gram however frequent is sent once for each block, and n-grams of
one block alone move once.  Within a block all texts are traversed together, left to
right, in segments: the ``ORDER - 1`` symbols before a segment give its state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_text, partitions_for, read
from .textkit import _WORD, Hasher, buffers, mix64

ORDER = 3
#: strength of the lower order, for orders 1, 2 and 3
PRIORS = (1.0, 20.0, 5.0)
BLOCK_BYTES = 12 << 20
SEGMENT = 1024

_BEGIN, _END = np.uint64(0x0B361A5D4E7F2C81), np.uint64(0x0E9D3B7A51C6F043)
_SPELL = np.log(257.0)
_SIGN = np.zeros(256, bool)
_SIGN[33:127] = True
_SIGN &= ~_WORD
_HASH_BYTES = 1 << 20
#: of 2**36 n-grams, which is about 300 GB of text, one in a million shares its hash with another
KEY_BITS = 56
_CODEC = "zstd"


def symbol_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (exclusive) and row of every word and sign, in reading order."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    word, sign = _WORD[raw], _SIGN[raw]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(raw))]
    first[edge] |= word[edge]
    last[edge - 1] |= word[edge - 1]
    start, end = np.flatnonzero(first | sign), np.flatnonzero(last | sign) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def _span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans, some bytes of text at a time."""
    out, at = np.zeros(len(start), np.uint64), 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + _HASH_BYTES, side="right")))
        a, b = int(start[at]), int(end[to - 1])
        out[at:to] = Hasher(raw[a:b])(start[at:to] - a, end[at:to] - a)
        at = to
    return out


def _key(order: int, *parts: np.ndarray) -> np.ndarray:
    acc = np.full(len(parts[0]), np.uint64(order) * np.uint64(0x9FB21C651E98DF25))
    for part in parts:
        acc = (acc ^ part) * np.uint64(0xD1342543DE82EF95)
        acc ^= acc >> np.uint64(29)
    return mix64(acc)


def _group(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each distinct key stands first in ``key``, the number of each, and each one's number in their order."""
    order = np.argsort(key)
    ordered = key[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]] if len(key) else np.zeros(0, bool)
    inverse = np.empty(len(key), np.int32)
    inverse[order] = np.cumsum(new, dtype=np.int32) - 1
    at = np.flatnonzero(new)
    return order[at], np.diff(np.r_[at, len(key)]), inverse


class Grams:
    """The distinct n-grams of some texts; their order doesn't depend on the order of the texts.

    Symbols, pairs and triples are numbered.  The begin mark and the pair of two are
    among them, counted once a text, so the count of a context is always how often it
    was left.
    """

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        start, end, row = symbol_spans(raw, off)
        rows, pad = len(off) - 1, ORDER - 1
        size = np.bincount(row, minlength=rows)
        #: where each text's first symbol is in the framed sequence, and its symbols with the end
        self.first = np.cumsum(size) - size + np.arange(rows) * (pad + 1) + pad
        self.length = size + 1
        flat = np.full(len(start) + rows * (pad + 1), _BEGIN)
        place = np.arange(len(start)) + row * (pad + 1) + pad
        flat[place] = _span_hashes(raw, start, end)
        flat[self.first + size] = _END
        spelled = np.zeros(len(flat), np.int64)
        spelled[place] = end - start
        n = len(flat)
        at, self.n1, self.symbol = _group(flat)
        self.word = flat[at]
        del flat, place, start, end, row
        #: log-probability of the symbol by its spelling; the end is the empty word
        self.spelling = -(spelled[at] + 1) * _SPELL
        self.n1[self.word == _BEGIN] = rows
        inner = np.ones(n, bool)
        inner[self.first - pad] = False
        i = np.flatnonzero(inner)
        at, self.n2, pair = _group(self.symbol[i - 1].astype(np.int64) << 32 | self.symbol[i])
        self.left, self.right = self.symbol[i[at] - 1], self.symbol[i[at]]
        #: number of the pair that ends at each place
        self.pair = np.full(n, -1, np.int32)
        self.pair[i] = pair
        inner[self.first - 1] = False
        i = np.flatnonzero(inner)
        at, self.n3, _ = _group(self.pair[i - 1].astype(np.int64) << 32 | self.symbol[i])
        i = i[at]
        self.context, self.last, self.target = self.pair[i - 1], self.symbol[i], self.pair[i]
        self.total = int(self.length.sum())

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes in order, numbers, place of each among order 0, symbols, pairs and triples)."""
        w = self.word
        key = np.concatenate([
            _key(0, np.zeros(1, np.uint64)), _key(1, w), _key(2, w[self.left], w[self.right]),
            _key(3, w[self.left][self.context], w[self.right][self.context], w[self.last]),
        ])
        order = np.argsort(key)
        return key[order] >> np.uint64(64 - KEY_BITS), np.concatenate([[self.total], self.n1, self.n2, self.n3])[order], order

    def adopt(self, n: np.ndarray) -> None:
        """Take the corpus's numbers, in the order of ``keys``' places."""
        cuts = np.cumsum([1, len(self.n1), len(self.n2)])
        self.total = int(n[0])
        self.n1, self.n2, self.n3 = n[1 : cuts[1]], n[cuts[1] : cuts[2]], n[cuts[2] :]


class Automaton:
    """States: 0 is the empty context, then one for each symbol, then one for each pair.

    The arcs of a state stand together, ordered by symbol.
    """

    def __init__(self, g: Grams, priors: tuple[float, ...] = PRIORS):
        m1, m2, m3 = priors
        u, p = len(g.word), len(g.left)
        p1 = (g.n1 + m1 * np.exp(g.spelling)) / (g.total + m1)
        p2 = (g.n2 + m2 * p1[g.right]) / (g.n1[g.left] + m2)
        p3 = (g.n3 + m3 * p2[g.target]) / (g.n2[g.context] + m3)
        self.weight = np.log(np.concatenate([p1, p2, p3]))
        self.symbol = np.concatenate([np.arange(u, dtype=np.int32), g.right, g.last])
        self.target = np.concatenate([1 + np.arange(u + p, dtype=np.int32), (1 + u + g.target).astype(np.int32)])
        arcs = np.concatenate([[u], np.bincount(g.left, minlength=u), np.bincount(g.context, minlength=p)])
        self.begin = np.r_[0, np.cumsum(arcs)]
        self.fail = np.concatenate([np.zeros(1 + u, np.int32), (1 + g.right).astype(np.int32)])
        self.back = np.log(np.concatenate([[m1 / (g.total + m1)], m2 / (g.n1 + m2), m3 / (g.n2 + m3)]))
        self.pairs = 1 + u
        begin = np.searchsorted(g.word, _BEGIN)
        self.mark = int(begin) if begin < u and g.word[begin] == _BEGIN else -1

    def _find(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Arc of each state on its symbol, -1 without one."""
        lo, end = self.begin[state], self.begin[state + 1]
        out = np.full(len(state), -1, np.int64)
        # most states have one arc
        some = lo < end
        hit = np.zeros(len(state), bool)
        hit[some] = self.symbol[lo[some]] == symbol[some]
        out[hit] = lo[hit]
        todo = np.flatnonzero(~hit & (end - lo > 1))
        lo, hi = lo[todo] + 1, end[todo]
        while len(todo):
            mid = (lo + hi) >> 1
            got, want = self.symbol[mid], symbol[todo]
            same = got == want
            out[todo[same]] = mid[same]
            lo, hi = np.where(got < want, mid + 1, lo), np.where(got > want, mid, hi)
            go = ~same & (lo < hi)
            todo, lo, hi = todo[go], lo[go], hi[go]
        return out

    def step(self, state: np.ndarray, symbol: np.ndarray, spelling: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(next state, log-probability) of each state on its symbol; an unknown symbol, -1, is spelled."""
        arc = self._find(state, symbol)
        miss = np.flatnonzero(arc < 0)
        if not len(miss):
            return self.target[arc], self.weight[arc]
        at, extra = state[miss].copy(), np.zeros(len(miss))
        alive = np.arange(len(miss))
        fallen = np.zeros(len(miss), bool)
        while len(alive):
            extra[alive] += self.back[at[alive]]
            out = at[alive] == 0
            fallen[alive[out]] = True
            alive = alive[~out]
            at[alive] = self.fail[at[alive]]
            arc[miss[alive]] = self._find(at[alive], symbol[miss[alive]])
            alive = alive[arc[miss[alive]] < 0]
        target, weight = self.target[arc], self.weight[arc]
        weight[miss] += extra
        lost = miss[fallen]
        target[lost] = 0
        weight[lost] = extra[fallen] + (spelling[lost] if len(lost) else 0)
        return target, weight

    def score(self, symbol: np.ndarray, first: np.ndarray, length: np.ndarray, spelling: np.ndarray | None = None, segment: int = SEGMENT) -> np.ndarray:
        """Log-probability of each text of a framed sequence of symbols, its end included."""
        parts = -(-length // segment)
        row = np.repeat(np.arange(len(length)), parts)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = first[row] + nth * segment
        size = np.minimum(segment, length[row] - nth * segment)
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        state = self.longest(symbol[begin - 2], symbol[begin - 1]) if len(begin) else np.zeros(0, np.int64)
        total = np.zeros(len(begin))
        active = np.searchsorted(-size, -np.arange(int(size.max()) if len(size) else 0), side="left")
        for t, m in enumerate(active):
            at = begin[:m] + t
            state[:m], weight = self.step(state[:m], symbol[at], None if spelling is None else spelling[at])
            total[:m] += weight
        back = np.empty_like(total)
        back[order] = total
        return np.bincount(row, back, minlength=len(length))

    def longest(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """State of the longest suffix of each pair of symbols."""
        state = np.where(right >= 0, 1 + right, 0).astype(np.int64)
        both = np.flatnonzero((left >= 0) & (right >= 0))
        arc = self._find(1 + left[both].astype(np.int64), right[both])
        state[both[arc >= 0]] = self.target[arc[arc >= 0]]
        return state


def score_texts(automaton: Automaton, known: np.ndarray, raw: np.ndarray, off: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Log-probability of any texts, counted or not, under the model of the symbols ``known``."""
    other = Grams(raw, off)
    at = np.minimum(np.searchsorted(known, other.word), len(known) - 1)
    code = np.where(known[at] == other.word, at, -1)
    return automaton.score(code[other.symbol], other.first, other.length, other.spelling[other.symbol], segment)


def _pack(values: np.ndarray) -> bytes:
    """Integers, byte plane by byte plane, compressed."""
    return pa.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T), _CODEC, asbytes=True)


def _unpack(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, n * 8, _CODEC), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _deltas(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=values.dtype.type(0))


def _ranges(key: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range of the hash begins in the ordered ``key``, and its end."""
    bounds = np.array([(i << KEY_BITS) // ranges for i in range(ranges)], np.uint64)
    return np.r_[np.searchsorted(key, bounds), len(key)]


def _counted(ranges: int):
    def run(table: pa.Table) -> pa.Table:
        """(part, block, n, keys, counts): a block's n-grams by ranges of their hash."""
        key, n, _ = Grams(*buffers(table.column("text").combine_chunks())).keys()
        cuts = _ranges(key, ranges)
        some = np.flatnonzero(np.diff(cuts))
        spans = [slice(cuts[i], cuts[i + 1]) for i in some]
        return pa.table(
            [
                pa.array(some.astype(np.int32)), pa.array(np.full(len(some), table.column("block")[0].as_py(), np.int32)),
                pa.array(np.diff(cuts)[some].astype(np.int32)),
                pa.array([_pack(_deltas(key[s])) for s in spans], pa.binary()), pa.array([_pack(n[s]) for s in spans], pa.binary()),
            ],
            ["part", "block", "n", "keys", "counts"],
        )

    return run


def _added(table: pa.Table) -> pa.Table:
    """(block, part, n, places, counts): for each block the corpus's numbers of the n-grams that others hold too."""
    sizes = table.column("n").to_numpy()
    keys = np.concatenate([np.cumsum(_unpack(k.as_py(), n)) for k, n in zip(table.column("keys"), sizes)])
    count = np.concatenate([_unpack(c.as_py(), n) for c, n in zip(table.column("counts"), sizes)]).astype(np.int64)
    order = np.argsort(keys)
    keys = keys[order]
    new = np.r_[True, keys[1:] != keys[:-1]]
    start = np.flatnonzero(new)
    total = np.add.reduceat(count[order], start)
    held = np.diff(np.r_[start, len(keys)])
    shared = np.repeat(held > 1, held)
    answer = np.zeros(len(keys), np.int64)
    answer[order[shared]] = np.repeat(total, held)[shared]
    ends = np.cumsum(sizes)
    blocks, places, counts = [], [], []
    for block, a, b in zip(table.column("block").to_pylist(), ends - sizes, ends):
        at = np.flatnonzero(answer[a:b])
        if len(at):
            blocks.append(block)
            places.append(at)
            counts.append(answer[a:b][at])
    part = table.column("part")[0].as_py()
    return pa.table(
        [
            pa.array(blocks, pa.int32()), pa.array([part] * len(blocks), pa.int32()), pa.array([len(p) for p in places], pa.int32()),
            pa.array([_pack(_deltas(p.astype(np.int64))) for p in places], pa.binary()), pa.array([_pack(c) for c in counts], pa.binary()),
        ],
        ["block", "part", "n", "places", "counts"],
    )


def _scored(ranges: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        kind = ["doc_id", "n_symbols", "log_prob", "perplexity"]
        if not docs.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())], kind)
        grams = Grams(*buffers(docs.column("text").combine_chunks()))
        key, n, place = grams.keys()
        cuts = _ranges(key, ranges)
        for part, size, places, counts in zip(*(answers.column(c).to_pylist() for c in ("part", "n", "places", "counts"))):
            n[cuts[part] + np.cumsum(_unpack(places, size)).astype(np.int64)] = _unpack(counts, size).astype(np.int64)
        back = np.empty_like(n)
        back[place] = n
        del key, n, place
        grams.adopt(back)
        out = Automaton(grams).score(grams.symbol, grams.first, grams.length)
        ids = docs.column("doc_id").combine_chunks().cast(pa.int64())
        return pa.table([ids, pa.array(grams.length), pa.array(out), pa.array(np.exp(-out / grams.length))], kind)

    return run


def score_documents(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_symbols, log_prob, perplexity) for every row, under the model of all rows.

    ``n_symbols`` counts the text's words, signs and end; the perplexity is per symbol.
    An empty text is scored by its end alone; a null text has nulls and isn't counted.
    Null and repeated ids are rows like any other, and repeated rows count as often as they
    stand there.  Equal texts score alike.  A text is never cut, however long, so a block
    may be as long as its longest text.  An empty table gives none.
    """
    rows = doc_text(docs)
    texts = rows.filter("text is not null")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = partitions_for(size, block_bytes)
    blocked = texts.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).select("block", "doc_id", "text")
    # one shuffle of the texts serves the counts and the scores; a task has two blocks or ranges on average, at any size
    tasks = -(-blocks // 2)
    blocked = blocked.repartition(tasks, "block")
    counted = blocked.groupBy("block").applyInArrow(_counted(blocks), "part int, block int, n int, keys binary, counts binary")
    added = counted.repartition(tasks, "part").groupBy("part").applyInArrow(_added, "block int, part int, n int, places binary, counts binary")
    scored = blocked.groupBy("block").cogroup(added.groupBy("block")).applyInArrow(
        _scored(blocks), "doc_id long, n_symbols long, log_prob double, perplexity double"
    )
    silent = rows.filter("text is null").select(
        "doc_id", F.lit(None).cast("long").alias("n_symbols"), F.lit(None).cast("double").alias("log_prob"), F.lit(None).cast("double").alias("perplexity")
    )
    return scored.unionByName(silent)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"))
