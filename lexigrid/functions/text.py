"""Text scalars as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def edit_distance(a: Column | str, b: Column | str, at_most: int | None = None) -> Column:
    """Levenshtein distance by code points; with ``at_most``, -1 beyond it."""
    return F.levenshtein(a, b) if at_most is None else F.levenshtein(a, b, at_most)


def auto_fuzziness(word: Column) -> Column:
    """Errors allowed by the length of a word: none under 3, one under 6, else two."""
    return F.when(F.length(word) < 3, 0).when(F.length(word) < 6, 1).otherwise(2)


def common_prefix(a: Column, b: Column) -> Column:
    """The longest prefix that two strings share."""
    short = F.least(F.length(a), F.length(b))
    differs = F.filter(F.sequence(F.lit(1), short), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    length = F.when(F.size(differs) > 0, differs[0] - 1).otherwise(short)
    return F.when(short > 0, F.substr(a, F.lit(1), length)).when(short.isNotNull(), F.lit(""))


def parse_field(spec: str) -> tuple[str, float]:
    """``title^2.5`` is (title, 2.5); without a weight, 1."""
    found = re.search(r"\^([0-9]*\.?[0-9]+)$", spec)
    return (spec[: found.start()], float(found[1])) if found else (spec, 1.0)


def field_weights(fields: list[str] | None, known: list[str]) -> dict[str, float]:
    """Weight of each field to search: all 1 without ``fields``; the last entry of a repeated field wins."""
    if not fields:
        return dict.fromkeys(known, 1.0)
    out: dict[str, float] = {}
    for name, weight in map(parse_field, fields):
        if name not in known:
            raise ValueError(f"Unknown field '{name}'!")
        out[name] = weight
    return {name: weight for name, weight in out.items() if weight > 0}
