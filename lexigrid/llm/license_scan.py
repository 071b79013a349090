"""Licence scan by sentence rules.

A text is cut into sentences (at a full stop, mark or semicolon before white space,
and at blank lines) and also into lines, since a notice may stand on a line of its
own inside running text, and a sentence may run over several lines.  Each one is
normalised to case-folded words joined by single spaces, and known ones are mapped
to a sentence identifier, a few with captured parts (a version, a clause's name).
The document's identifier sequence is then matched, left to right, against the
ordered rules: the first rule that fits at a position takes those identifiers and
names a licence.  Identifiers that no rule takes are reported as left over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_text, read
from .textkit import Hasher, buffers, normalise, slices, word_spans

_V = r"(?: (?:license )?version)?,? ?v?(\d)(?: 0)?"
_IS = r"(?:(?:this|the|all) (?:work|file|files|software|project|program|code|source code|library|package|module|repository|text|document|material) (?:is|are) )?(?:made )?"
_UNDER = r"(?:licensed|released|distributed|available|provided|published|offered) under (?:the terms of )?(?:the |a |an )?(?:terms of (?:the )?)?"
_TAIL = r"(?: (?:see|refer to|please see|as found in|a copy of|which can be found) .*)?"
_LATER = r"(?: or (?:at your option )?(?:any )?(?:later|newer)(?: versions?)?)"

SPDX = {
    name.lower(): name
    for name in (
        "Apache-2.0 MIT MIT-0 ISC BSD-2-Clause BSD-3-Clause BSD-4-Clause GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later GPL-2.0 GPL-3.0 "
        "LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later MPL-2.0 EPL-2.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 "
        "CC-BY-NC-4.0 Unlicense Zlib BSL-1.0 0BSD"
    ).split()
}

#: identifier, pattern of the whole normalised sentence; {0} in an identifier is the first capture
SENTENCES: list[tuple[str, str]] = [
    ("copyright", r"(?:portions )?copyright (?:c )?(?:\d{4}|[\w ]*\d{4}).*|copyright c .*|c copyright .*"),
    ("all-rights", r"all rights reserved"),
    ("spdx:{0}", r"spdx license identifier .*"),
    ("apache-{0}", rf"{_IS}{_UNDER}apache license{_V}(?: the license)?{_TAIL}|(?:the )?apache license{_V}"),
    ("apache-conditional", r"you may not use this file except in compliance with the license"),
    ("apache-copy", r"you may obtain a copy of the license at(?: https?)? www apache org licenses license 2 0(?: txt)?|you may obtain a copy of the license at"),
    ("apache-unless", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-see", r"see the license for the specific language governing permissions and limitations under the license"),
    ("mit-name", rf"(?:the )?(?:mit|expat) license(?: mit)?|{_IS}{_UNDER}(?:mit|expat) license{_TAIL}"),
    ("mit-grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice", r"the above copyright notice and this permission notice " r"shall be included in all copies or substantial portions of the software"),
    ("mit-warranty", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit-liability", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd-name-{0}", rf"(?:the )?bsd ([23]) clause license|(?:the )?([23]) clause bsd license|{_IS}{_UNDER}bsd ([23]) clause license{_TAIL}|{_IS}{_UNDER}([23]) clause bsd license{_TAIL}"),
    ("bsd-plain", rf"(?:the )?bsd license|{_IS}{_UNDER}bsd(?: style)? license{_TAIL}"),
    ("bsd-grant", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met(?: \d)?"),
    ("bsd-source", r"(?:\d )?redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", r"(?:\d )?redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-endorse", r"(?:\d )?neither the name of .* may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-advertising", r"(?:\d )?all advertising materials mentioning features or use of this software must display the following acknowledgement.*"),
    ("bsd-warranty", r"this software is provided by the .* as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("isc-grant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl-{0}", rf"{_IS}{_UNDER}(?:gnu (?:general public license|gpl)|gpl){_V}(?: only)?{_TAIL}"),
    ("gpl-{0}-later", rf"{_IS}{_UNDER}(?:gnu (?:general public license|gpl)|gpl){_V}{_LATER}{_TAIL}"),
    ("lgpl-{0}", rf"{_IS}{_UNDER}(?:gnu )?(?:(?:lesser|library) general public license|lgpl)(?: version)? ?v?(\d(?: 1)?)(?: 0)?(?: only)?{_TAIL}"),
    ("lgpl-{0}-later", rf"{_IS}{_UNDER}(?:gnu )?(?:(?:lesser|library) general public license|lgpl)(?: version)? ?v?(\d(?: 1)?)(?: 0)?{_LATER}{_TAIL}"),
    ("agpl-{0}", rf"{_IS}{_UNDER}(?:gnu )?(?:affero general public license|agpl){_V}(?: only)?{_TAIL}"),
    ("agpl-{0}-later", rf"{_IS}{_UNDER}(?:gnu )?(?:affero general public license|agpl){_V}{_LATER}{_TAIL}"),
    ("gnu-free-{0}", rf"this (?:program|library) is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation (?:either )?version (\d)(?: of the license)?"),
    ("gnu-free-{0}-later", rf"this (?:program|library) is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation (?:either )?version (\d) of the license{_LATER}"),
    ("gnu-or-later", r"or at your option any later version"),
    ("gnu-hope", r"this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gnu-hope-start", r"this program is distributed in the hope that it will be useful but without any warranty"),
    ("gnu-hope-end", r"without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gnu-details", r"see the gnu general public license for more details"),
    ("gnu-received", r"you should have received a copy of the gnu general public license along with this program.*"),
    ("mpl-{0}", rf"this source code form is subject to the terms of the mozilla public license v(?:ersion)? ?(\d) 0|{_IS}{_UNDER}(?:mozilla public license|mpl)(?: v(?:ersion)?)? ?(\d) 0{_TAIL}"),
    ("mpl-copy", r"if a copy of the mpl was not distributed with this file you can obtain one at .*"),
    ("epl-{0}", rf"{_IS}{_UNDER}eclipse public license{_V}{_TAIL}"),
    ("cc0", r"(?:licensed|released|dedicated|available) (?:under|to the public domain under) (?:the )?cc0(?: 1 0)?(?: universal)?|to the extent possible under law .* has waived all copyright.*"),
    ("cc-{0}", rf"{_IS}{_UNDER}cc (by(?: nc| sa| nd)* \d 0){_TAIL}"),
    ("cc-long-{0}", rf"{_IS}{_UNDER}creative commons (attribution(?: noncommercial| sharealike| noderivatives)* \d 0)(?: international)?(?: license)?{_TAIL}"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", r"(?:this (?:work|file|software|code) is )?(?:hereby )?(?:released |placed |dedicated )?in(?:to)? the public domain"),
    ("licence-reference", r"(?:see|refer to) (?:the )?(?:accompanying )?(?:file )?(?:license|licence|copying)(?: file)?(?: txt| md)?(?: for (?:details|more information|the full license text|license information))?"),
]

#: Words of which every known sentence holds at least one; all other sentences are passed over.
CUES = (
    "copyright license licence licensed released rights permission warranty warranties redistribution redistributions compliance liable "
    "endorse advertising redistribute public mpl cc0 waived domain later copying dedicated distributed available acknowledgement"
).split()

#: licence and the identifiers it takes, in order; "?" after one that may lack, "{0}" a captured part; first fit wins
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("Apache-{0}.0", ("apache-{0}", "apache-conditional", "apache-copy?", "apache-unless", "apache-see?")),
    ("Apache-{0}.0", ("apache-{0}",)),
    ("MIT", ("mit-name?", "copyright?", "all-rights?", "mit-grant", "mit-notice", "mit-warranty?", "mit-liability?")),
    ("MIT", ("mit-name",)),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse?", "bsd-warranty?")),
    ("BSD-3-Clause", ("bsd-name-{0}?", "copyright?", "all-rights?", "bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty?")),
    ("BSD-2-Clause", ("bsd-name-{0}?", "copyright?", "all-rights?", "bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty?")),
    ("BSD-{0}-Clause", ("bsd-name-{0}",)),
    ("BSD-2-Clause", ("bsd-plain", "copyright?", "all-rights?", "bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty?")),
    ("LicenseRef-BSD", ("bsd-plain",)),
    ("ISC", ("isc-grant", "bsd-warranty?")),
    ("GPL-{0}.0-or-later", ("gnu-free-{0}-later", "gnu-hope?", "gnu-hope-start?", "gnu-hope-end?", "gnu-details?", "gnu-received?")),
    ("GPL-{0}.0-or-later", ("gnu-free-{0}", "gnu-or-later", "gnu-hope?", "gnu-hope-start?", "gnu-hope-end?", "gnu-details?", "gnu-received?")),
    ("GPL-{0}.0-only", ("gnu-free-{0}", "gnu-hope?", "gnu-hope-start?", "gnu-hope-end?", "gnu-details?", "gnu-received?")),
    ("GPL-{0}.0-or-later", ("gpl-{0}-later",)),
    ("GPL-{0}.0-only", ("gpl-{0}",)),
    ("LGPL-{0}-or-later", ("lgpl-{0}-later",)),
    ("LGPL-{0}-only", ("lgpl-{0}",)),
    ("AGPL-{0}.0-or-later", ("agpl-{0}-later",)),
    ("AGPL-{0}.0-only", ("agpl-{0}",)),
    ("MPL-{0}.0", ("mpl-{0}", "mpl-copy?")),
    ("EPL-{0}.0", ("epl-{0}",)),
    ("CC0-1.0", ("cc0",)),
    ("CC-{0}", ("cc-{0}",)),
    ("CC-{0}", ("cc-long-{0}",)),
    ("Unlicense", ("unlicense",)),
    ("LicenseRef-public-domain", ("public-domain",)),
    ("{0}", ("spdx:{0}",)),
    ("LicenseRef-see-file", ("licence-reference",)),
]

_LONG_NAMES = {"attribution": "by", "noncommercial": "nc", "sharealike": "sa", "noderivatives": "nd"}
_PATTERNS = [(name, re.compile(pattern)) for name, pattern in SENTENCES]
_TAG = re.compile(rb"SPDX-License-Identifier:[ \t]*([^\r\n]*)", re.IGNORECASE)
_CUE_HASHES = np.zeros(0, np.uint64)


def identifier(sentence: str) -> tuple[str, str] | None:
    """(identifier, captured part) of a normalised sentence; None if it is not known."""
    for name, pattern in _PATTERNS:
        found = pattern.fullmatch(sentence)
        if found:
            return name, next((g for g in found.groups() if g), "")
    return None


def spdx_names(expression: str) -> list[str]:
    """The known licences of an SPDX expression, in order; a "+" is "or later", an exception stays with its licence."""
    names: list[str] = []
    words = re.findall(r"[A-Za-z0-9.+-]+", expression)
    at = 0
    while at < len(words):
        word = words[at].rstrip(".")
        plain = word.rstrip("+")
        name = SPDX.get(plain.lower())
        if name is None:
            # what follows the expression, such as the end of a comment, is not part of it
            if at and words[at].upper() not in ("OR", "AND"):
                break
            at += 1
            continue
        if word != plain:
            name = f"{name}-or-later" if f"{name.lower()}-or-later" in SPDX else f"{name}+"
        if at + 2 < len(words) and words[at + 1].upper() == "WITH":
            name, at = f"{name} WITH {words[at + 2].rstrip('.')}", at + 2
        names.append(name)
        at += 1
    return names


def _title(licence: str, part: str) -> str:
    if licence == "CC-{0}":
        words = [_LONG_NAMES.get(w, w) for w in part.split()]
        part = "-".join(words[:-2]).upper() + f"-{words[-2]}.{words[-1]}"
    elif licence.startswith("LGPL-{0}"):
        part = part.replace(" ", ".") if " " in part else f"{part}.0"
    return licence.replace("{0}", part)


def match_rules(sequence: list[tuple[str, str]]) -> tuple[list[str], list[str]]:
    """(licences in order of appearance, identifiers left over) of an identifier sequence."""
    licences, rest, at = [], [], 0
    while at < len(sequence):
        for licence, wanted in RULES:
            to, part = at, ""
            for name in wanted:
                if to < len(sequence) and sequence[to][0] == name.rstrip("?"):
                    part = part or sequence[to][1]
                    to += 1
                elif not name.endswith("?"):
                    break
            else:
                licences.append(_title(licence, part))
                at = to
                break
        else:
            rest.append(sequence[at][0])
            at += 1
    return licences, rest


def _cues() -> np.ndarray:
    raw = np.frombuffer(" ".join(CUES).encode(), np.uint8)
    start, end, _ = word_spans(raw, np.array([0, len(raw)]))
    return np.sort(Hasher(raw)(start, end))


def known_sentences(raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, list[tuple[str, str]]]]:
    """(row, identifier sequence) of the rows with a known sentence."""
    global _CUE_HASHES
    if not len(_CUE_HASHES):
        _CUE_HASHES = _cues()
    start, end, row = word_spans(raw, off)
    if not len(start):
        return
    word = Hasher(raw)(start, end)
    cue = _CUE_HASHES[np.minimum(np.searchsorted(_CUE_HASHES, word), len(_CUE_HASHES) - 1)] == word
    # a break belongs to the word after it
    after = np.r_[raw[1:], np.uint8(10)]
    white = (after == 32) | (after == 10) | (after == 13) | (after == 9)
    stop = ((raw == 46) | (raw == 33) | (raw == 63) | (raw == 59)) & white
    line = raw == 10
    blank = line & (after == 10) | line & (after == 13)
    new_row = np.r_[True, row[1:] != row[:-1]]
    found: dict[int, dict[tuple[int, int], list[tuple[str, str]]]] = {}
    for marks in (stop | blank, stop | line):
        sums = np.r_[0, np.cumsum(marks)]
        opens = new_row | np.r_[True, sums[start[1:]] > sums[end[:-1]]]
        unit = np.cumsum(opens) - 1
        first = np.flatnonzero(opens)
        last = np.r_[first[1:], len(start)] - 1
        for u in np.unique(unit[cue]).tolist():
            a, b = int(start[first[u]]), int(end[last[u]])
            text, _ = normalise(raw[a:b], np.array([0, b - a]))
            name = identifier(text.tobytes().decode("utf-8", "replace"))
            if name and name[0] == "spdx:{0}":
                tag = _TAG.match(raw[a : int(off[row[first[u]] + 1])].tobytes())
                names = [("spdx:{0}", n) for n in spdx_names(tag[1].decode("utf-8", "replace"))] if tag else []
                if names:
                    found.setdefault(int(row[first[u]]), {})[a, b] = names
            elif name:
                found.setdefault(int(row[first[u]]), {})[a, b] = [name]
    for r in sorted(found):
        spans, sequence, until = sorted(found[r].items(), key=lambda s: (s[0][0], -s[0][1])), [], -1
        for (a, b), names in spans:
            if a >= until:  # a line inside a known sentence says nothing more
                sequence += names
                until = b
        yield r, sequence


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, licences, left_over, status) for every row, in one pass without a shuffle.

    ``licences`` lists SPDX names once each, in order of appearance; ``left_over`` the
    known sentences that no rule took (such as a copyright line).  ``status`` is
    ``licensed``, ``unclear`` (only left-over sentences) or ``none``.  Null and empty
    texts have no sentence: empty lists and ``none``.  Ids may be null or repeat.  Texts
    are scanned whole, however long; of two sentences that begin alike the longer counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            licences: list[list[str]] = [[] for _ in range(part.num_rows)]
            rest: list[list[str]] = [[] for _ in range(part.num_rows)]
            for r, sequence in known_sentences(*buffers(part.column("text"))):
                names, left = match_rules(sequence)
                licences[r], rest[r] = list(dict.fromkeys(names)), left
            status = ["licensed" if a else "unclear" if b else "none" for a, b in zip(licences, rest)]
            kind = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(licences, kind), pa.array(rest, kind), pa.array(status)], ["doc_id", "licences", "left_over", "status"]
            )

    return doc_text(docs).mapInArrow(run, "doc_id long, licences array<string>, left_over array<string>, status string")


def licence_report(docs: DataFrame) -> DataFrame:
    """(licence, docs): documents by licence; those without one under null."""
    found = scan(docs)
    return found.select("doc_id", F.explode_outer("licences").alias("licence")).groupBy("licence").agg(F.count(F.lit(1)).alias("docs"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
