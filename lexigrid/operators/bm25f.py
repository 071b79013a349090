"""BM25F over postings, for one query or for a table of queries.

Fields of weight 0 take no part.  A term's length norm sums only the fields it
occurs in, N is the greatest document count of a field, and the term
frequency saturates without a (k1 + 1) factor.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.analysis import Analyzer
from ..sources.tables import materialize
from .ordering import dense_ids

K1, B = 1.2, 0.75
#: of a table of queries: scores that a worker holds at once, queries and their terms that it holds at once, sums that it makes at once
BLOCK_SCORES, GROUP_QUERIES, GROUP_TERMS, CELLS = 500_000, 2_000, 500_000, 2_000_000


def analysed(leaves: DataFrame, analyzer: Analyzer) -> DataFrame:
    """(internal_id, field, tokens, terms) of (internal_id, field, value); terms lie beside their tokens."""
    tokens = leaves.select("internal_id", "field", analyzer.tokenize(F.col("value")).alias("tokens"))
    return tokens.withColumn("terms", analyzer.terms(F.col("tokens")))


def _kept(terms: str = "terms") -> Column:
    return F.filter(terms, lambda t: t != "")


def term_hits(texts: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(internal_id, field, dl, wanted): each text's length and its terms, or those of ``only``, chosen before any row is made or moved."""
    wanted = _kept() if only is None else F.filter("terms", lambda t: t.isin(*only))
    return texts.select("internal_id", "field", F.size(_kept()).alias("dl"), wanted.alias("wanted"))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def _counted(terms: Column) -> Column:
    """A text's distinct terms with their numbers: the runs of its sorted terms.  No batch of texts is held, and no Python runs."""

    def runs(ordered: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        return _once(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(ordered, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(ordered)) - i).alias("tf"))))

    return F.when(F.size(terms) > 0, _once(F.sort_array(terms), runs))


def unfold(hits: DataFrame) -> DataFrame:
    """(term, internal_id, field, tf, dl) of term hits; a text's terms are counted in its own row, so nothing is moved."""
    rows = hits.select("internal_id", "field", "dl", F.inline(_counted(F.col("wanted"))))
    return rows.select("term", "internal_id", "field", "tf", "dl")


def postings(texts: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(term, internal_id, field, tf, dl) of analysed texts."""
    return unfold(term_hits(texts, only))


def kept_texts(texts: DataFrame, words: bool = False) -> DataFrame:
    """(internal_id, field, dl, counted[, words]): all that an index keeps of a text, in its one row, from one look at it."""
    kept = texts.select("internal_id", "field", _kept().alias("wanted"), *[_words().alias("words")] * words)
    return kept.select("internal_id", "field", F.size("wanted").alias("dl"), _counted(F.col("wanted")).alias("counted"), *["words"] * words)


def field_lengths(texts: DataFrame) -> DataFrame:
    """(internal_id, field, dl); a text without a term has length 0 and counts."""
    return texts.select("internal_id", "field", F.size(_kept()).alias("dl"))


def field_stats(lengths: DataFrame) -> DataFrame:
    """(field, doc_count, total_dl)."""
    return lengths.groupBy("field").agg(F.count(F.lit(1)).alias("doc_count"), F.sum("dl").cast("long").alias("total_dl"))


def _words() -> Column:
    pairs = F.filter(F.arrays_zip("tokens", "terms"), lambda p: p["terms"] != "")
    return F.array_distinct(F.transform(pairs, lambda p: F.lower(p["tokens"])))


def vocabulary(texts: DataFrame) -> DataFrame:
    """(word): distinct lower-cased raw tokens whose term was kept."""
    return texts.select(F.explode(_words()).alias("word")).distinct()


def document_frequency(docs: DataFrame, key: str, fields: list[str], analyzer: Analyzer) -> DataFrame:
    """(term, df) over all fields, from the documents themselves, in whose rows each term is told once.

    So a row for each term leaves a task, and none for a term and a document, unless ids are given
    twice: then documents of one id are one.  A document without an id counts for nothing, as in SQL.
    """
    twice = docs.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").first()
    found = F.concat(*[analyzer.terms(analyzer.tokenize(F.col(f))) for f in fields])
    told = docs.select(F.col(key).alias("internal_id"), found.alias("terms")).select("internal_id", F.explode(F.array_distinct(_kept())).alias("term"))
    return told.groupBy("term").agg((F.count_distinct("internal_id") if twice else F.count("internal_id")).alias("df"))


def collection_size(stats: DataFrame, weights: dict[str, float]) -> tuple[int, float]:
    """(N, average length) over the weighted fields, from one row for each field."""
    rows = [r for r in stats.collect() if weights.get(r.field, 0) > 0]
    n = max((r.doc_count for r in rows), default=0)
    return n, sum(weights[r.field] * r.total_dl for r in rows) / n if n else 0.0


def document_terms(post: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(term, internal_id, tf, dl) weighted and summed over fields."""
    if not weights:
        return post.select("term", "internal_id", F.lit(0.0).alias("tf"), F.lit(0.0).alias("dl")).limit(0)
    weight = F.create_map(*[F.lit(x) for f, w in weights.items() for x in (f, float(w))])[F.col("field")]
    return post.filter(F.col("field").isin(*weights)).groupBy("term", "internal_id").agg(F.sum(weight * F.col("tf")).alias("tf"), F.sum(weight * F.col("dl")).alias("dl"))


def term_scores(post: DataFrame, weights: dict[str, float], n: int, average: float, k1: float = K1, b: float = B) -> DataFrame:
    """(term, internal_id, score) of every document that holds a term."""
    per_doc = document_terms(post, weights)
    return _scored(per_doc, _frequencies(per_doc), n, average, k1, b)


def _frequencies(per_doc: DataFrame) -> DataFrame:
    return per_doc.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _scored(per_doc: DataFrame, found: DataFrame, n: int, average: float, k1: float, b: float) -> DataFrame:
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = k1 * (1 - b + b * F.col("dl") / F.lit(float(average or 1)))
    return per_doc.join(found, "term").select("term", "internal_id", (F.col("tf") / (F.col("tf") + norm) * idf).alias("score"))


def summed(scores: DataFrame, *keys: str) -> DataFrame:
    """(keys..., score) over the terms, added in the order of the terms.

    So equal documents have equal scores to the last bit, however the rows arrived, and tie.
    """
    parts = F.array_sort(F.collect_list(F.struct("term", "score")))
    return scores.groupBy(*keys).agg(F.aggregate(parts, F.lit(0.0), lambda total, p: total + p["score"]).alias("score"))


def rank_one(scores: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """(rank, internal_id, score) of the page, best first, then by id."""
    total = summed(scores, "internal_id")
    best = [F.desc("score"), F.col("internal_id")]
    if limit is None:  # a whole ranking has no bound, so it is placed by ranges
        placed = dense_ids(total, best, 1, "rank").filter(F.col("rank") > offset)
        return placed.select(F.col("rank").cast("int").alias("rank"), "internal_id", "score")
    page = total.orderBy(*best)
    page = page.offset(offset).limit(limit) if offset else page.limit(limit)
    return page.select((F.row_number().over(Window.orderBy(*best)) + offset).alias("rank"), "internal_id", "score")


def search_many(post: DataFrame, queries: DataFrame, weights: dict[str, float], n: int, average: float, limit: int | None = None, offset: int = 0, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, rank, internal_id, score) of postings for a table (query_id, term) of any size.

    What the scores are made of is written once: the terms of the queries in each document, and the documents of each term.
    """
    asked = post.join(queries.select("term").distinct(), "term", "left_semi")
    per_doc = materialize(document_terms(asked, weights), "per_doc")
    found = materialize(_frequencies(per_doc), "frequencies")
    return rank_many(_scored(per_doc, found, n, average, k1, b), queries, limit, offset, per_doc.count())


def rank_many(scores: DataFrame, queries: DataFrame, limit: int | None = None, offset: int = 0, n_scores: int | None = None) -> DataFrame:
    """(query_id, rank, internal_id, score) for a table (query_id, term) of any size; ``scores`` has a document's term once.

    Blocks of documents meet groups of queries, and only the best of each block leave it: what is
    moved grows with the scores, not with the scores times the queries that ask for their term.
    """
    if n_scores is None:
        scores = materialize(scores, "scores")
        n_scores = scores.count()
    asked = materialize(queries.groupBy("query_id").agg(F.collect_set("term").alias("terms")), "queries")
    n_queries, n_terms = asked.agg(F.count(F.lit(1)), F.sum(F.size("terms"))).first()
    groups = max(1, -(-n_queries // GROUP_QUERIES), -(-(n_terms or 0) // GROUP_TERMS))
    keep = None if limit is None else offset + limit
    blocks = max(1, -(-n_scores // (BLOCK_SCORES // 8 if keep is None else BLOCK_SCORES)))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))) if n > 1 else F.lit(0)

    left = scores.select(F.pmod(F.hash("internal_id"), F.lit(blocks)).alias("_block"), every(groups).alias("_group"), "internal_id", "term", "score")
    right = asked.select(F.pmod(F.hash("query_id"), F.lit(groups)).alias("_group"), every(blocks).alias("_block"), "query_id", "terms")
    kind = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("internal_id", scores.schema["internal_id"].dataType), T.StructField("score", T.DoubleType())])
    best = left.groupBy("_group", "_block").cogroup(right.groupBy("_group", "_block")).applyInArrow(lambda a, b: _best(a, b, keep), kind)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "internal_id")))
    if keep is not None:
        ranked = ranked.filter(F.col("rank") <= keep)
    return ranked.filter(F.col("rank") > offset).select("query_id", "rank", "internal_id", "score")


def _numbers(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The place of each value among the distinct ones in their order, nulls first, and those."""
    coded = values.dictionary_encode(null_encoding="encode")
    order = pc.sort_indices(coded.dictionary, null_placement="at_start")
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return place[coded.indices.to_numpy(zero_copy_only=False)], coded.dictionary.take(order)


def _first(query: np.ndarray, score: np.ndarray, doc: np.ndarray, keep: int | None) -> np.ndarray:
    """The places of the ``keep`` best rows of each query; of equal scores the least documents."""
    if keep is None:
        return np.arange(len(query))
    order = np.lexsort((doc, -score, query))
    ordered = query[order]
    return order[np.arange(len(order)) - np.searchsorted(ordered, ordered) < keep]


def _best(scores: pa.Table, queries: pa.Table, keep: int | None) -> pa.Table:
    """(query_id, internal_id, score): the ``keep`` best documents of a block for each query of a group.

    A score is added to the sums of all queries that ask for its term, terms in their order as in ``summed``.
    """
    terms = queries["terms"].combine_chunks()
    wanted, vocabulary = _numbers(terms.flatten())
    asking = np.repeat(np.arange(len(terms)), terms.value_lengths().to_numpy(zero_copy_only=False))[np.argsort(wanted, kind="stable")]
    starts = np.searchsorted(np.sort(wanted), np.arange(len(vocabulary) + 1))
    term = pc.index_in(scores["term"].combine_chunks(), value_set=vocabulary)
    scores, term = scores.filter(term.is_valid()), term.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
    doc, ids = _numbers(scores["internal_id"].combine_chunks())
    step = max(1, CELLS // max(1, len(terms)))
    order = np.lexsort((doc, term, doc // step))
    doc, term, score = doc[order], term[order], scores["score"].to_numpy()[order]
    edges = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(doc // step, prepend=-1))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for base in range(0, len(ids), step):
        total = np.full((min(step, len(ids) - base), len(terms)), -0.0)  # no sum of scores is -0.0
        a, z = np.searchsorted(doc[edges] // step, (base // step, base // step + 1))
        for at, end in zip(edges[a:z], np.append(edges, len(doc))[a + 1 : z + 1]):
            t = term[at]
            total[doc[at:end, None] - base, asking[starts[t] : starts[t + 1]]] += score[at:end, None]
        seen = (total != 0) | ~np.signbit(total)
        if keep is not None and keep < len(total):
            total[~seen] = -np.inf
            seen &= total >= np.partition(total, len(total) - keep, axis=0)[len(total) - keep]
        row, query = np.nonzero(seen)
        points = total[row, query]
        some = _first(query, points, row, keep)
        found.append((query[some], row[some] + base, points[some]))
    query, row, points = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    some = _first(query, points, row, keep)
    return pa.table({"query_id": queries["query_id"].combine_chunks().take(pa.array(query[some])), "internal_id": ids.take(pa.array(row[some])), "score": points[some]})


def query_terms(queries: DataFrame, analyzer: Analyzer, query_id: str = "query_id", text: str = "text") -> DataFrame:
    """(query_id, term), each term once for a query."""
    tokens = queries.select(F.col(query_id).alias("query_id"), analyzer.tokenize(F.col(text)).alias("tokens"))
    return tokens.select("query_id", F.explode(F.array_distinct(analyzer.terms(F.col("tokens")))).alias("term")).filter("term <> ''")
