"""Marking matches in texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.analysis import Analyzer


def highlight(text: Column, terms: list[str], analyzer: Analyzer, before: str = "<b>", after: str = "</b>") -> Column:
    """``text`` with each token whose term is wanted between the marks; all else as it was."""
    if not terms:
        return text
    pieces = F.regexp_extract_all(text, F.lit(analyzer.pieces), F.lit(0))
    marked = F.zip_with(pieces, analyzer.terms(pieces), lambda p, t: F.when(t.isin(*terms), F.concat(F.lit(before), p, F.lit(after))).otherwise(p))
    return F.when(text.isNotNull(), F.array_join(marked, ""))
