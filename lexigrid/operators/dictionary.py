"""A multimap from words to values, looked up exactly, by prefix or by edit distance.

It is a table (key, value, fuzzy, seq): no tree is built, the contracts are
predicates on the table.  A key may be there without a value; such keys are not found.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fuzzy import fuzzy_matches, nearest_word, prefix_matches


@dataclass(frozen=True)
class Dictionary:
    """Immutable; ``insert`` gives a new one.  ``distance`` may replace Levenshtein's (Columns to Column)."""

    table: DataFrame
    distance: object = None

    @staticmethod
    def empty(spark: SparkSession, value: str = "long", distance=None) -> Dictionary:
        return Dictionary(spark.createDataFrame([], f"key string, value {value}, fuzzy boolean, seq long"), distance)

    @staticmethod
    def of(df: DataFrame, key: str = "word", value: str | None = None, order_by: str | None = None, fuzzy: bool = True, distance=None) -> Dictionary:
        """The words, and values if there are any, of a table."""
        values = F.col(value) if value else F.lit(1)
        seq = F.col(order_by).cast("long") if order_by else F.lit(0).cast("long")
        return Dictionary(df.select(F.col(key).alias("key"), values.alias("value"), F.lit(fuzzy).alias("fuzzy"), seq.alias("seq")), distance)

    def insert(self, key: str, *values: object, fuzzy: bool = True) -> Dictionary:
        if not key:
            raise ValueError("Missing key!")
        if not values:
            return self
        spark = self.table.sparkSession
        last = self.table.agg(F.max("seq")).first()[0]
        first = -1 if last is None else last
        rows = [(key, v, fuzzy, first + 1 + i) for i, v in enumerate(values)]
        return replace(self, table=self.table.unionByName(spark.createDataFrame(rows, self.table.schema)))

    def insert_no_fuzzy(self, key: str, *values: object) -> Dictionary:
        return self.insert(key, *values, fuzzy=False)

    def _grouped(self, rows: DataFrame) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("seq", "value")))
        return rows.filter("value is not null").groupBy(F.col("key").alias("word")).agg(F.transform(ordered, lambda x: x["value"]).alias("values"))

    def lookup(self, key: str) -> list | None:
        """The key's values in the order of their insertion; None without any, [] for the empty key."""
        if not key:
            return []
        row = self._grouped(self.table.filter(F.col("key") == key)).first()
        return list(row["values"]) if row else None

    def has(self, key: str) -> bool:
        return self.lookup(key) not in (None, [])

    def _words(self, fuzzy: bool, keep: Column | None) -> DataFrame:
        rows = self.table.filter("fuzzy") if fuzzy else self.table
        grouped = self._grouped(rows)
        return grouped if keep is None else grouped.filter(keep)

    def prefix(self, prefix: str, limit: int | None = None, keep: Column | None = None, collation: str | None = None) -> DataFrame:
        """(word, rank, values); ``keep`` is a predicate on the column ``values``."""
        rows = self._grouped(self.table.filter(F.col("key").startswith(prefix)))
        rows = rows if keep is None else rows.filter(keep)
        return prefix_matches(rows, prefix, limit, collation=collation).join(rows, "word").select("word", "rank", "values")

    def fuzzy(self, query: str | list[str], max_errors: int | None = 2, limit: int | None = None, keep: Column | None = None, collation: str | None = None) -> DataFrame:
        """(word, distance, rank, values); several queries share one limit and the least distance counts."""
        rows = self._words(True, keep)
        return fuzzy_matches(rows, query, max_errors, limit, distance=self.distance, collation=collation).join(rows, "word").select("word", "distance", "rank", "values")

    def find(self, query: str, max_errors: int | None = None, limit: int | None = None) -> DataFrame:
        """As ``fuzzy``, but without a bound on the distance unless one is given."""
        return self.fuzzy(query, max_errors, limit)

    def nearest(self, query: str) -> str | None:
        spark = self.table.sparkSession
        row = nearest_word(self._words(True, None), spark.createDataFrame([(query,)], "query string"), distance=self.distance).first()
        return row.word if row else None
