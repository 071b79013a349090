"""Slow, plain versions of the operators, to hold the real ones against."""

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa

from lexigrid.llm.line_dedup import DEPTH, LONG_DOCS, LONG_TOKENS, MIN_DOCS, MIN_TOKENS, SIMILARITY, Lines

WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words(text):
    return [w.lower() for w in WORD.findall(text.encode())]


class Union:
    def __init__(self):
        self.up = {}

    def root(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)

    def groups(self):
        out = defaultdict(list)
        for x in self.up:
            out[self.root(x)].append(x)
        return sorted(sorted(g) for g in out.values() if len(g) > 1)


def signature_groups(rows, t):
    """Groups of (doc_id, signature) rows that agree in t places or more."""
    found = Union()
    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if a != b and (x == y).sum() >= t:
                found.join(a, b)
    return found.groups()


def substring_distance(item, text):
    """Least edit distance of item to a substring of text, by the full table."""
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        for j, d in enumerate(text, 1):
            new[j] = min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1)
        row = new
    return int(row.min())


def dropped_lines(docs, min_docs=MIN_DOCS, similarity=SIMILARITY):
    """{doc_id: line numbers to drop} of (doc_id, text) rows."""
    leaves = defaultdict(dict)
    places = defaultdict(list)
    for doc_id, text in docs:
        for no, line in enumerate(text.split("\n")):
            tokens = [None if re.search(rb"[0-9]", w) else w for w in words(line)]
            if len(tokens) < 3 and not any(tokens):
                tokens = words(line)  # a number or two alone are no template
            if len(tokens) >= MIN_TOKENS:
                mark = int(Lines(pa.array([line]), DEPTH, MIN_TOKENS).line[0])  # only gives the order within a leaf
                leaves[len(tokens), tuple(tokens[:DEPTH])][mark] = tokens
                places[mark].append((doc_id, no))
    gone = defaultdict(set)
    for lines in leaves.values():
        templates = []
        for mark in sorted(lines):
            tokens = lines[mark]
            scores = [sum(a == b for a, b in zip(tokens, t["tokens"])) for t in templates]
            if scores and max(scores) >= similarity * len(tokens):
                best = templates[scores.index(max(scores))]
                best["tokens"] = [a if a == b else None for a, b in zip(tokens, best["tokens"])]
            else:
                best = {"tokens": list(tokens), "marks": []}
                templates.append(best)
            best["marks"].append(mark)
        for t in templates:
            found = [p for m in t["marks"] for p in places[m]]
            holders = {d for d, _ in found}
            if len(holders) >= (LONG_DOCS if len(t["tokens"]) >= LONG_TOKENS else min_docs):
                for d, no in found:
                    if d != min(holders):
                        gone[d].add(no)
    return gone
