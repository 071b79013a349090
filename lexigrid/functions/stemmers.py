"""Stemmers, from their published descriptions, and their vectorised form."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_VOWELS = "aeiou"


def _shape(stem: str) -> str:
    """``c`` or ``v`` for each letter; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(stem):
        vowel = c in _VOWELS or c == "y" and i > 0 and out[-1] == "c"
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


_STEP_2 = [tuple(x.split(":")) for x in (
    "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize "
    "ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
).split()]
_STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _replace(word: str, rules: list[tuple[str, str]]) -> str:
    """The rule with the longest fitting ending decides, and applies if the stem has a measure."""
    for ending, new in sorted(rules, key=lambda r: -len(r[0])):
        if word.endswith(ending):
            stem = word[: -len(ending)]
            return stem + new if _measure(stem) > 0 else word
    return word


def porter_stem(word: str) -> str:
    """Porter's algorithm of 1980; words of one or two letters stay."""
    if len(word) < 3:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for ending in ("ed", "ing"):
            if word.endswith(ending):
                if _has_vowel(stem := word[: -len(ending)]):
                    word = stem
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif _double(word) and word[-1] not in "lsz":
                        word = word[:-1]
                    elif _measure(word) == 1 and _short_end(word):
                        word += "e"
                break
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, _STEP_2), _STEP_3)
    for ending in sorted(_STEP_4, key=len, reverse=True):
        if word.endswith(ending):
            stem = word[: -len(ending)]
            if _measure(stem) > 1 and (ending != "ion" or stem[-1:] in ("s", "t")):
                word = stem
            break
    if word.endswith("e"):
        stem = word[:-1]
        m = _measure(stem)
        if m > 1 or m == 1 and not _short_end(stem):
            word = stem
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def cistem_stem(word: str, case_insensitive: bool = False) -> str:
    """CISTEM (Weissweiler and Fraser, 2017) for German."""
    if not word:
        return word
    # a word that begins with a digit counts as capitalised
    capital = word[0] == word[0].upper()
    word = word.lower()
    for a, b in (("ü", "u"), ("ö", "o"), ("ä", "a"), ("ß", "ss")):
        word = word.replace(a, b)
    word = re.sub(r"^ge(.{4,})", r"\1", word)
    for a, b in (("sch", "$"), ("ei", "%"), ("ie", "&")):
        word = word.replace(a, b)
    word = re.sub(r"(.)\1", r"\1*", word)
    while len(word) > 3:
        if len(word) > 5 and (word.endswith(("em", "er")) or word.endswith("nd")):
            word = word[:-2]
        elif word.endswith("t") and (not capital or case_insensitive):
            word = word[:-1]
        elif word[-1] in "esn":
            word = word[:-1]
        else:
            break
    word = re.sub(r"(.)\*", r"\1\1", word)
    for a, b in (("sch", "$"), ("ei", "%"), ("ie", "&")):
        word = word.replace(b, a)
    return word


def vectorised(stem: Callable[[str], str]) -> Callable[[Column], Column]:
    """``stem`` for a column of string arrays: called once for each distinct word of a batch, and remembered."""

    def batch(arrays: pa.Array) -> pa.Array:
        known = _remembered(stem)
        coded = arrays.flatten().dictionary_encode()
        stems = pa.array([None if w is None else known(w) for w in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
        cuts = np.r_[0, np.cumsum(arrays.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(cuts), stems, mask=arrays.is_null())

    return F.arrow_udf(batch, "array<string>")


_memories: dict[Callable[[str], str], Callable[[str], str]] = {}


def _remembered(stem: Callable[[str], str]) -> Callable[[str], str]:
    if stem not in _memories:
        _memories[stem] = lru_cache(1 << 18)(stem)
    return _memories[stem]
