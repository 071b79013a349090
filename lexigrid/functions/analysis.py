"""Tokenisers and analysers.

An analyser turns a raw token into a term, or into ``''`` to drop it.  All but the
stemmer are Column expressions; a stemmer gets whole Arrow batches and is called
for their distinct words only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

from .stemmers import cistem_stem, porter_stem, vectorised

#: ASCII marks and curly quotes that the language analysers take out of a token
MARKS = r"[!-/:-@\[-`{-~\x{2018}\x{2019}\x{201C}\x{201D}]"


def word_tokens(text: Column) -> Column:
    """Runs of ASCII letters, digits and underscores; none for a null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(r"\w+"), F.lit(0)), F.array().cast("array<string>"))


def unicode_tokens(text: Column) -> Column:
    """Runs of letters and digits of any script, and underscores (an extension)."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), F.array().cast("array<string>"))


@dataclass(frozen=True)
class Analyzer:
    """``tokenize`` maps text to an array of tokens; ``terms`` maps tokens to terms, in place, ``''`` for a dropped one."""

    name: str
    tokenize: Callable[[Column], Column] = word_tokens
    #: Column to Column, without Python in it
    prepare: Callable[[Column], Column] = F.lower
    stops: tuple[str, ...] = ()
    #: string to string, called once for each distinct word of a batch
    stem: Callable[[str], str] | None = None
    #: the pattern of a token and of the gap between tokens, for highlighting
    pieces: str = r"\w+|\W+"

    def terms(self, tokens: Column) -> Column:
        def one(token: Column) -> Column:
            word = self.prepare(token)
            return F.when(word.isin(*self.stops), "").otherwise(word) if self.stops else word

        words = F.transform(tokens, one)
        return words if self.stem is None else vectorised(self.stem)(words)

    def analyze(self, token: Column) -> Column:
        """The term of a single token."""
        return self.terms(F.array(token))[0]


@lru_cache
def stop_words(language: str) -> tuple[str, ...]:
    return tuple(StopWordsRemover.loadDefaultStopWords(language))


def _bare(token: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(token), MARKS, ""))


def default(unicode: bool = False) -> Analyzer:
    return Analyzer("unicode", unicode_tokens, pieces=r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+") if unicode else Analyzer("default")


def _language(name: str, stem: Callable[[str], str], stops: tuple[str, ...] | None, unicode: bool) -> Analyzer:
    base = default(unicode)
    return Analyzer(name, base.tokenize, _bare, stop_words(name) if stops is None else tuple(stops), stem, base.pieces)


def english(stops: tuple[str, ...] | None = None, unicode: bool = False) -> Analyzer:
    return _language("english", porter_stem, stops, unicode)


def german(stops: tuple[str, ...] | None = None, unicode: bool = False) -> Analyzer:
    return _language("german", cistem_stem, stops, unicode)


def python_tokenizer(split: Callable[[str], list[str]]) -> Callable[[Column], Column]:
    """A tokeniser from a Python function, called on Arrow batches; none for a null."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([[] if t is None else [str(x) for x in split(t)] for t in texts.to_pylist()], pa.list_(pa.string()))

    return lambda text: F.arrow_udf(run, "array<string>")(text)


def custom(name: str, tokenize: Callable[[Column], Column] = word_tokens, prepare: Callable[[Column], Column] = F.lower, python: Callable[[str], str] | None = None, python_tokenize: Callable[[str], list[str]] | None = None) -> Analyzer:
    """An analyser of one's own: Column functions, and ``python`` ones where no expression will do.

    ``python`` maps a token to its term, ``python_tokenize`` a text to its tokens.
    """
    return Analyzer(name, python_tokenizer(python_tokenize) if python_tokenize else tokenize, prepare, stem=python)


LANGUAGES: dict[str, Callable[[], Analyzer]] = {"default": default, "english": english, "german": german, "unicode": lambda: default(True)}


def resolve(analyzer: Analyzer | str | None) -> Analyzer:
    if isinstance(analyzer, Analyzer):
        return analyzer
    if (analyzer or "default") not in LANGUAGES:
        raise ValueError(f"Unknown language: {analyzer}")
    return LANGUAGES[analyzer or "default"]()
