"""Words within an edit distance of others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import auto_fuzziness
from .ordering import dense_ids


def _query_words(words: DataFrame, queries: list[tuple]) -> DataFrame:
    return words.sparkSession.createDataFrame(queries, "query string, errors int, bucket int")


def _near(words: DataFrame, queries: list[tuple], column: str, distance=None) -> DataFrame:
    """(columns of words, query, bucket, distance) within the query's errors."""
    asked = F.broadcast(_query_words(words, queries))  # a user's few words
    word = F.col(column)
    if distance is not None:
        found = words.crossJoin(asked).withColumn("distance", distance(word, F.col("query")))
        return found.filter("errors is null or distance <= errors")
    if any(e is None for _, e, _ in queries):
        return words.crossJoin(asked).withColumn("distance", F.levenshtein(word, F.col("query")))
    close = (F.abs(F.length(word) - F.length("query")) <= F.col("errors"))
    widest = max([e for _, e, _ in queries], default=0)
    found = words.join(asked, close & (F.levenshtein(word, F.col("query"), widest) >= 0))
    return found.withColumn("distance", F.levenshtein(word, F.col("query"), widest)).filter("distance <= errors")


def fuzzy_matches(words: DataFrame, query: str | list[str], max_errors: int | None = 2, limit: int | None = None, column: str = "word", distance=None, collation: str | None = None) -> DataFrame:
    """(word, distance, rank): words within ``max_errors`` of the query, nearest first, then by word.

    Of several queries the least distance counts and ``limit`` is for all of them together.
    Without ``max_errors`` every word matches; without ``limit`` the whole ranking is placed by ranges.
    """
    if max_errors is not None and max_errors < 0 or limit is not None and limit <= 0:
        raise ValueError("max_errors must not be negative and limit must be positive")
    queries = [query] if isinstance(query, str) else list(dict.fromkeys(query))
    queries = [(q, max_errors, 0) for q in queries if q]
    if not queries:
        return words.select(F.col(column).alias("word"), F.lit(0).alias("distance"), F.lit(0).alias("rank")).limit(0)
    found = _near(words, queries, column, distance).groupBy(F.col(column).alias("word")).agg(F.min("distance").alias("distance"))
    by_word = F.collate("word", collation) if collation else F.col("word")
    if limit is None:
        return _placed(found, ["distance", by_word])
    found = found.orderBy("distance", by_word).limit(limit)
    return found.withColumn("rank", F.row_number().over(Window.orderBy("distance", by_word)))


def _placed(found: DataFrame, order: list) -> DataFrame:
    """A ranking of any length, with ``rank`` last."""
    placed = dense_ids(found, order, 1, "rank")
    return placed.select(*found.columns, F.col("rank").cast("int").alias("rank"))


def auto_expansions(words: DataFrame, tokens: list[str], max_expansions: int = 5, column: str = "word") -> DataFrame:
    """(word, distance, bucket): tokens are allowed errors by their length; each number of errors has its own ``max_expansions``."""
    queries = [(t, e, e) for t in dict.fromkeys(tokens) if (e := 0 if len(t) < 3 else 1 if len(t) < 6 else 2) >= 0]
    if not queries:
        return words.select(F.col(column).alias("word"), F.lit(0).alias("distance"), F.lit(0).alias("bucket")).limit(0)
    found = _near(words, queries, column).groupBy(F.col(column).alias("word"), "bucket").agg(F.min("distance").alias("distance"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("distance", "word"))
    return found.withColumn("place", place).filter(F.col("place") <= max_expansions).select("word", "distance", "bucket")


def deletions(word: Column, errors: int) -> Column:
    """The word and all that is left of it after up to ``errors`` deletions."""
    out = F.array(word)
    for _ in range(errors):
        shorter = F.flatten(
            F.transform(out, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1))))
        )
        out = F.array_distinct(F.concat(out, shorter))
    return out


def fuzzy_join(left: DataFrame, right: DataFrame, max_errors: int = 1, left_on: str = "word", right_on: str = "word") -> DataFrame:
    """(left_word, right_word, distance) for two whole tables of words.

    Words within k errors share a string after k deletions on each side at most, so this
    is an equi-join on deletions, verified after; no pair is missed and none is compared by nested loops.
    """
    a = left.select(F.col(left_on).alias("left_word")).distinct().withColumn("key", F.explode(deletions(F.col("left_word"), max_errors)))
    b = right.select(F.col(right_on).alias("right_word")).distinct().withColumn("key", F.explode(deletions(F.col("right_word"), max_errors)))
    pairs = a.join(b, "key").select("left_word", "right_word").distinct()
    return pairs.withColumn("distance", F.levenshtein("left_word", "right_word", max_errors)).filter("distance >= 0")


def prefix_matches(words: DataFrame, prefix: str, limit: int | None = 10, column: str = "word", collation: str | None = None) -> DataFrame:
    """(word, rank): words that begin with ``prefix``, in order (of ``collation``, if given); the filter reaches the scan."""
    if limit is not None and limit <= 0:
        raise ValueError("limit must be positive")
    found = words.filter(F.col(column).startswith(prefix)).select(F.col(column).alias("word")).distinct()
    order = [F.collate("word", collation), F.col("word")] if collation else [F.col("word")]
    if limit is None:
        return _placed(found, order)
    return found.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def nearest_word(words: DataFrame, queries: DataFrame, column: str = "word", query: str = "query", distance=None) -> DataFrame:
    """(query, word, distance): the nearest word of each query, the first by order among equals.

    ``distance`` (Columns to Column) may replace Levenshtein's.
    """
    measure = distance or F.levenshtein
    pairs = queries.select(F.col(query).alias("query")).distinct().crossJoin(words.select(F.col(column).alias("word")).distinct())
    best = pairs.groupBy("query").agg(F.min(F.struct(measure(F.col("word"), F.col("query")).alias("distance"), "word")).alias("best"))
    return best.select("query", "best.word", "best.distance")


__all__ = ["auto_expansions", "auto_fuzziness", "deletions", "fuzzy_join", "fuzzy_matches", "nearest_word", "prefix_matches"]
