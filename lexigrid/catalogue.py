"""Registered queries of the search engine and the SQL they are held against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import analysis, text
from .operators import bm25f
from .operators.dictionary import Dictionary
from .operators.evaluate import mean_ndcg
from .operators.flatten import flatten
from .operators.fuzzy import auto_expansions, fuzzy_join, fuzzy_matches, nearest_word, prefix_matches
from .operators.highlight import highlight
from .operators.index import SearchIndex, contiguous_versions
from .plans.options import IndexOptions
from .sources.tables import materialize, shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

FIELDS = ["text", "source", "lang"]
ASKED = "The thing that was with src1"
TERMS = sorted({"the", "thing", "that", "was", "with", "src1"})
WORDS = ["the", "thing", "und", "cion", "heat"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def leaves(spark: SparkSession, sf_dir: str, table: str = "documents", key: str = "doc_id", fields: list[str] = FIELDS) -> DataFrame:
    rows = read(spark, sf_dir, table).select(F.col(key).alias("internal_id"), *fields)
    return flatten(rows, ["internal_id"])


def texts(spark: SparkSession, sf_dir: str, analyzer: analysis.Analyzer | None = None, **what) -> DataFrame:
    return bm25f.analysed(leaves(spark, sf_dir, **what), analyzer or analysis.default())


def searched(spark: SparkSession, sf_dir: str, weights: dict[str, float], terms: list[str] = TERMS, k1: float = bm25f.K1, b: float = bm25f.B, analyzer=None, **what) -> DataFrame:
    """Scores without an index: the texts are read for the terms asked for, and for the lengths."""
    hits = materialize(bm25f.term_hits(texts(spark, sf_dir, analyzer, **what), terms), "hits")  # the texts are read once
    n, average = bm25f.collection_size(bm25f.field_stats(hits), weights)
    return bm25f.term_scores(bm25f.unfold(hits), weights, n, average, k1, b)


def ranked(scores: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    return bm25f.rank_one(scores, limit, offset).select("rank", F.col("internal_id").alias("doc_id"), F.round("score", 6).alias("score"))


def total(scores: DataFrame) -> DataFrame:
    """Every match, unranked: no global sort of a whole result."""
    return scores.groupBy(F.col("internal_id").alias("doc_id")).agg(F.round(F.sum("score"), 6).alias("score"))


# SQL for the same


def _leaves_sql(table: str = "documents", key: str = "doc_id", fields: list[str] = FIELDS) -> str:
    parts = " UNION ALL ".join(f"SELECT {key} AS doc_id, '{f}' AS field, {f} AS value FROM {table} WHERE {f} IS NOT NULL" for f in fields)
    return f"leaves AS ({parts})"


def _tokens_sql(**what) -> str:
    return (
        f"{_leaves_sql(**what)}, toks AS (SELECT doc_id, field, list_transform(regexp_extract_all(value, '\\w+'), lambda t: lower(t)) AS terms FROM leaves), "
        "lens AS (SELECT doc_id, field, CAST(len(terms) AS INTEGER) AS dl FROM toks), "
        "post AS (SELECT doc_id, field, term, count(*) AS tf FROM (SELECT doc_id, field, unnest(terms) AS term FROM toks) GROUP BY ALL)"
    )


def _list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _scores_sql(weights: dict[str, float], terms: str, k1: float = bm25f.K1, b: float = bm25f.B, **what) -> str:
    """CTEs that end with ``scores(term, doc_id, score)``; ``terms`` is a list or a subquery."""
    pairs = ", ".join(f"('{f}', CAST({w} AS DOUBLE))" for f, w in weights.items())
    return (
        f"WITH {_tokens_sql(**what)}, w(field, weight) AS (VALUES {pairs}), "
        "st AS (SELECT field, count(*) AS n, sum(dl) AS total FROM lens GROUP BY field), "
        "size AS (SELECT CAST(max(n) AS DOUBLE) AS n, sum(weight * total) / max(n) AS average FROM st JOIN w USING (field)), "
        f"td AS (SELECT term, doc_id, sum(weight * tf) AS tf, sum(weight * dl) AS dl FROM post JOIN lens USING (doc_id, field) JOIN w USING (field) WHERE term IN ({terms}) GROUP BY term, doc_id), "
        "df AS (SELECT term, count(*) AS df FROM td GROUP BY term), "
        f"scores AS (SELECT term, doc_id, tf / (tf + CAST({k1} AS DOUBLE) * (1 - CAST({b} AS DOUBLE) + CAST({b} AS DOUBLE) * dl / average)) * ln((n + 1) / (df + 0.5)) AS score "
        "FROM td JOIN df USING (term) CROSS JOIN size)"
    )


_TOTAL = " SELECT doc_id, round(sum(score), 6) AS score FROM scores GROUP BY doc_id"
#: added in the order of the terms, so that equal documents tie
_ADDED = "list_reduce(list(score ORDER BY term), lambda a, b: a + b) AS score"
_SUMMED = f", summed AS (SELECT doc_id, {_ADDED} FROM scores GROUP BY doc_id), ranked AS (SELECT CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM summed)"
_TERMS = _list(TERMS)
EVEN = {f: 1.0 for f in FIELDS}
HEAVY = {"text": 2.5, "source": 1.0}
_VOCABULARY = f"WITH {_tokens_sql()}, vocabulary AS (SELECT DISTINCT term AS word FROM post)"


@query("tokenize", "SELECT doc_id, regexp_extract_all(text, '\\w+') AS tokens FROM documents")
def tokenize(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", analysis.word_tokens(F.col("text")).alias("tokens"))


@query("tokenize_lower", "SELECT doc_id, list_transform(regexp_extract_all(text, '\\w+'), lambda t: lower(t)) AS terms FROM documents")
def tokenize_lower(spark, sf_dir):
    a = analysis.default()
    return read(spark, sf_dir, "documents").select("doc_id", a.terms(a.tokenize(F.col("text"))).alias("terms"))


@query("token_counts", "SELECT lower(token) AS term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\\w+')) AS token FROM documents) GROUP BY ALL")
def token_counts(spark, sf_dir):
    found = read(spark, sf_dir, "documents").select(F.explode(analysis.word_tokens(F.col("text"))).alias("token"))
    return found.groupBy(F.lower("token").alias("term")).agg(F.count(F.lit(1)).alias("n"))


@query("flatten_fields", f"WITH {_leaves_sql()} SELECT * FROM leaves")
def flatten_fields(spark, sf_dir):
    return leaves(spark, sf_dir).withColumnRenamed("internal_id", "doc_id")


@query("variant_flatten", "SELECT event_id, 'event_type' AS field, event_type AS value FROM events")
def variant_flatten(spark, sf_dir):
    """``props`` is JSON of any shape; its numbers are no text, so only the other leaves come out."""
    return flatten(read(spark, sf_dir, "events").select("event_id", "event_type", "props"), ["event_id"], ["props"])


@query(
    "json_leaves",
    "SELECT c_custkey, unnest(['profile.name', 'profile.tags.0', 'profile.tags.1.segment']) AS field, unnest([c_name, 'tag', c_mktsegment]) AS value FROM customer",
)
def json_leaves(spark, sf_dir):
    """JSON texts with nested objects, arrays, numbers and nulls; their string leaves by dotted path."""
    tags = F.array(F.lit('"tag"'), F.concat(F.lit('{"segment":'), F.to_json(F.array("c_mktsegment")).substr(F.lit(2), F.length("c_mktsegment") + 2), F.lit(',"none":null,"n":1.5}')))
    name = F.to_json(F.array("c_name")).substr(F.lit(2), F.length("c_name") + 2)
    text = F.concat(F.lit('{"name":'), name, F.lit(',"balance":'), F.col("c_acctbal"), F.lit(',"empty":{},"tags":['), F.array_join(tags, ","), F.lit("]}"))
    return flatten(read(spark, sf_dir, "customer").select("c_custkey", text.alias("profile")), ["c_custkey"], ["profile"])


@query("term_frequency", f"WITH {_tokens_sql()} SELECT term, doc_id, field, CAST(tf AS INTEGER) AS tf, dl FROM post JOIN lens USING (doc_id, field)")
def term_frequency(spark, sf_dir):
    return bm25f.postings(texts(spark, sf_dir)).withColumnRenamed("internal_id", "doc_id")


@query("document_frequency", f"WITH {_tokens_sql()} SELECT term, count(DISTINCT doc_id) AS df FROM post GROUP BY term")
def document_frequency(spark, sf_dir):
    return bm25f.document_frequency(read(spark, sf_dir, "documents"), "doc_id", FIELDS, analysis.default())


@query("field_lengths", f"WITH {_tokens_sql()} SELECT * FROM lens")
def field_lengths(spark, sf_dir):
    return bm25f.field_lengths(texts(spark, sf_dir)).withColumnRenamed("internal_id", "doc_id")


@query("field_stats", f"WITH {_tokens_sql()} SELECT field, count(*) AS doc_count, CAST(sum(dl) AS BIGINT) AS total_dl FROM lens GROUP BY field")
def field_stats(spark, sf_dir):
    return bm25f.field_stats(bm25f.field_lengths(texts(spark, sf_dir)))


@query("vocabulary", f"{_VOCABULARY} SELECT word FROM vocabulary")
def vocabulary(spark, sf_dir):
    return bm25f.vocabulary(texts(spark, sf_dir))


@query("bm25f_single_field", _scores_sql({"text": 1}, _TERMS) + _TOTAL)
def bm25f_single_field(spark, sf_dir):
    return total(searched(spark, sf_dir, {"text": 1.0}))


@query("bm25f_multi_field", _scores_sql(EVEN, _TERMS) + _TOTAL)
def bm25f_multi_field(spark, sf_dir):
    return total(searched(spark, sf_dir, EVEN))


@query("bm25f_weighted", _scores_sql(HEAVY, _TERMS) + _TOTAL)
def bm25f_weighted(spark, sf_dir):
    return total(searched(spark, sf_dir, text.field_weights(["text^2.5", "source", "lang^0"], FIELDS)))


@query("bm25f_custom_k1_b", _scores_sql(EVEN, _TERMS, 2.0, 0.4) + _TOTAL)
def bm25f_custom_k1_b(spark, sf_dir):
    return total(searched(spark, sf_dir, EVEN, k1=2.0, b=0.4))


@query("bm25f_top_k", _scores_sql(EVEN, _TERMS) + _SUMMED + " SELECT rank, doc_id, round(score, 6) AS score FROM ranked WHERE rank <= 10")
def bm25f_top_k(spark, sf_dir):
    return ranked(searched(spark, sf_dir, EVEN), 10)


@query("bm25f_offset", _scores_sql(EVEN, _TERMS) + _SUMMED + " SELECT rank, doc_id, round(score, 6) AS score FROM ranked WHERE rank > 20 AND rank <= 30")
def bm25f_offset(spark, sf_dir):
    return ranked(searched(spark, sf_dir, EVEN), 10, 20)


@query("bm25f_id_filter", _scores_sql(EVEN, _TERMS) + ", kept AS (SELECT * FROM scores WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))" + _TOTAL.replace("FROM scores", "FROM kept"))
def bm25f_id_filter(spark, sf_dir):
    """The filter works on the scored documents; the statistics are those of all."""
    good = read(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("internal_id"))
    return total(searched(spark, sf_dir, EVEN).join(good, "internal_id", "left_semi"))


@query("bm25f_with_docs", _scores_sql(EVEN, _TERMS) + _SUMMED + " SELECT rank, doc_id, round(score, 6) AS score, text FROM ranked JOIN documents USING (doc_id) WHERE rank <= 5")
def bm25f_with_docs(spark, sf_dir):
    page = ranked(searched(spark, sf_dir, EVEN), 5)
    return page.join(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("rank", "doc_id", "score", "text")


@query(
    "bm25f_batch",
    _scores_sql({"text": 1}, "SELECT term FROM q") .replace("WITH ", "WITH q AS (SELECT DISTINCT item_id, lower(token) AS term FROM (SELECT item_id, unnest(regexp_extract_all(text, '\\w+')) AS token FROM benchmark)), ", 1)
    + f", summed AS (SELECT item_id, doc_id, {_ADDED} FROM scores JOIN q USING (term) GROUP BY item_id, doc_id), "
    "ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM summed) "
    "SELECT item_id, rank, doc_id, round(score, 6) AS score FROM ranked WHERE rank <= 10",
)
def bm25f_batch(spark, sf_dir):
    """Every test item is a query; equal documents tie exactly, and then the least id comes first."""
    found = texts(spark, sf_dir, fields=["text"])
    terms = bm25f.query_terms(read(spark, sf_dir, "benchmark"), analysis.default(), "item_id")
    n, average = bm25f.collection_size(bm25f.field_stats(bm25f.field_lengths(found)), {"text": 1.0})
    best = bm25f.search_many(bm25f.postings(found), terms, {"text": 1.0}, n, average, 10)
    return best.select(F.col("query_id").alias("item_id"), "rank", F.col("internal_id").alias("doc_id"), F.round("score", 6).alias("score"))


_PART = {"table": "part", "key": "p_partkey", "fields": ["p_name", "p_type"]}
_PART_TERMS = ["red", "steel", "blue", "copper", "small"]


@query("part_name_search", _scores_sql({"p_name": 2, "p_type": 1}, _list(_PART_TERMS), **_PART) + _TOTAL)
def part_name_search(spark, sf_dir):
    return total(searched(spark, sf_dir, {"p_name": 2.0, "p_type": 1.0}, _PART_TERMS, **_PART))


@query(
    "conversation_search",
    _scores_sql({"text": 1, "role": 1}, _list(["user", "the", "thing"]), table="(SELECT conv_id * 1000000 + turn AS turn_id, role, text FROM conversations)", key="turn_id", fields=["text", "role"]) + _TOTAL,
)
def conversation_search(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("internal_id"), "text", "role")
    found = bm25f.analysed(flatten(rows, ["internal_id"]), analysis.default())
    weights = {"text": 1.0, "role": 1.0}
    n, average = bm25f.collection_size(bm25f.field_stats(bm25f.field_lengths(found)), weights)
    return total(bm25f.term_scores(bm25f.postings(found, ["user", "the", "thing"]), weights, n, average))


@query("prefix_autocomplete", f"{_VOCABULARY} SELECT word, CAST(row_number() OVER (ORDER BY word) AS INTEGER) AS rank FROM vocabulary WHERE starts_with(word, 'th') ORDER BY word LIMIT 10")
def prefix_autocomplete(spark, sf_dir):
    return prefix_matches(bm25f.vocabulary(texts(spark, sf_dir)), "th", 10)


def _fuzzy_sql(words: list[str], errors: int, limit: int) -> str:
    return (
        f"{_VOCABULARY}, near AS (SELECT word, min(levenshtein(word, q)) AS distance FROM vocabulary CROSS JOIN (SELECT unnest([{_list(words)}]) AS q) "
        f"WHERE abs(length(word) - length(q)) <= {errors} GROUP BY word HAVING min(levenshtein(word, q)) <= {errors} ORDER BY distance, word LIMIT {limit}) "
    )


@query("fuzzy_autocomplete", _fuzzy_sql(["thing"], 1, 10) + "SELECT word, CAST(distance AS INTEGER) AS distance, CAST(row_number() OVER (ORDER BY distance, word) AS INTEGER) AS rank FROM near")
def fuzzy_autocomplete(spark, sf_dir):
    return fuzzy_matches(bm25f.vocabulary(texts(spark, sf_dir)), "thing", 1, 10)


@query("batch_fuzzy", _fuzzy_sql(WORDS, 2, 40) + "SELECT word, CAST(distance AS INTEGER) AS distance, CAST(row_number() OVER (ORDER BY distance, word) AS INTEGER) AS rank FROM near")
def batch_fuzzy(spark, sf_dir):
    return fuzzy_matches(bm25f.vocabulary(texts(spark, sf_dir)), WORDS, 2, 40)


_AUTO = (
    ", asked AS (SELECT unnest([{0}]) AS q), buckets AS (SELECT q, CASE WHEN length(q) < 3 THEN 0 WHEN length(q) < 6 THEN 1 ELSE 2 END AS bucket FROM asked), "
    "near AS (SELECT word, bucket, min(levenshtein(word, q)) AS distance FROM vocabulary CROSS JOIN buckets WHERE levenshtein(word, q) <= bucket GROUP BY ALL), "
    "best AS (SELECT word, bucket, distance FROM near QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY distance, word) <= 5)"
)


@query("fuzzy_auto_bucket", _VOCABULARY + _AUTO.format(_list(["a", "thing", "theheat"])) + " SELECT word, CAST(bucket AS INTEGER) AS bucket, CAST(distance AS INTEGER) AS distance FROM best")
def fuzzy_auto_bucket(spark, sf_dir):
    return auto_expansions(bm25f.vocabulary(texts(spark, sf_dir)), ["a", "thing", "theheat"], 5).select("word", "bucket", "distance")


def _expanded(spark: SparkSession, sf_dir: str, auto: bool) -> DataFrame:
    words = bm25f.vocabulary(texts(spark, sf_dir))
    more = auto_expansions(words, ["thing", "heat"], 5) if auto else fuzzy_matches(words, ["thing", "heat"], 1, 5)
    terms = sorted({"thing", "heat", *(r.word for r in more.select("word").collect())})  # ten words at most
    return total(searched(spark, sf_dir, EVEN, terms))


def _expanded_sql(near: str) -> str:
    return _scores_sql(EVEN, "SELECT word FROM best UNION ALL SELECT unnest(['thing', 'heat'])").replace(
        ", w(field", f", vocabulary AS (SELECT DISTINCT term AS word FROM post){near}, w(field", 1
    ) + _TOTAL


@query("bm25f_fuzzy_auto", _expanded_sql(_AUTO.format(_list(["thing", "heat"]))))
def bm25f_fuzzy_auto(spark, sf_dir):
    return _expanded(spark, sf_dir, auto=True)


@query(
    "bm25f_fuzzy_fixed",
    _expanded_sql(
        ", best AS (SELECT word, min(levenshtein(word, q)) AS distance FROM vocabulary CROSS JOIN (SELECT unnest(['thing', 'heat']) AS q) "
        "WHERE levenshtein(word, q) <= 1 GROUP BY word ORDER BY distance, word LIMIT 5)"
    ),
)
def bm25f_fuzzy_fixed(spark, sf_dir):
    return _expanded(spark, sf_dir, auto=False)


_PART_WORDS = "SELECT DISTINCT lower(token) AS word FROM (SELECT unnest(regexp_extract_all(p_name || ' ' || p_type, '\\w+')) AS token FROM part)"


def _part_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25f.vocabulary(texts(spark, sf_dir, **_PART))


@query("nearest_word", f"WITH v AS ({_PART_WORDS}), q AS (SELECT DISTINCT event_type AS query FROM events) SELECT query, arg_min(word, (levenshtein(word, query), word)) AS word, CAST(min(levenshtein(word, query)) AS INTEGER) AS distance FROM q CROSS JOIN v GROUP BY query")
def nearest(spark, sf_dir):
    return nearest_word(_part_words(spark, sf_dir), read(spark, sf_dir, "events"), query="event_type")


@query("fuzzy_join", f"WITH v AS ({_PART_WORDS}) SELECT a.word AS left_word, b.word AS right_word, CAST(levenshtein(a.word, b.word) AS INTEGER) AS distance FROM v a CROSS JOIN v b WHERE levenshtein(a.word, b.word) <= 2")
def fuzzy_table_join(spark, sf_dir):
    words = _part_words(spark, sf_dir)
    return fuzzy_join(words, words, 2)


@query("highlight_matches", f"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '\\w+|\\W+'), lambda t: CASE WHEN lower(t) IN ({_TERMS}) THEN '<b>' || t || '</b>' ELSE t END), '') AS text FROM documents")
def highlight_matches(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", highlight(F.col("text"), TERMS, analysis.default()).alias("text"))


_STOPS = ("the", "a", "an", "and", "of", "in", "is", "it", "to", "that", "was", "with", "on", "for", "are", "be", "or", "from", "this", "than", "as", "at", "ha", "he")


@query("stop_word_filter", f"SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '\\w+'), lambda t: lower(t)), lambda t: t NOT IN ({_list(list(_STOPS))})) AS terms FROM documents")
def stop_word_filter(spark, sf_dir):
    a = analysis.Analyzer("stops", stops=_STOPS)
    kept = F.filter(a.terms(a.tokenize(F.col("text"))), lambda t: t != "")
    return read(spark, sf_dir, "documents").select("doc_id", kept.alias("terms"))


def _pairs(spark: SparkSession, sf_dir: str, **columns: Column) -> DataFrame:
    names = read(spark, sf_dir, "nation").select(F.lower("n_name").alias("a"))
    return names.crossJoin(names.select(F.col("a").alias("b"))).select("a", "b", *[c.alias(n) for n, c in columns.items()])


_PAIRS_SQL = "SELECT lower(x.n_name) AS a, lower(y.n_name) AS b, {} FROM nation x CROSS JOIN nation y"


@query("levenshtein_pairs", _PAIRS_SQL.format("CAST(levenshtein(lower(x.n_name), lower(y.n_name)) AS INTEGER) AS distance"))
def levenshtein_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir, distance=text.edit_distance("a", "b"))


@query("common_prefix", _PAIRS_SQL.format("lower(x.n_name)[1:coalesce(list_min(list_filter(range(1, length(x.n_name) + 2), lambda i: lower(x.n_name)[1:i] <> lower(y.n_name)[1:i] OR i > length(x.n_name))), 1) - 1] AS prefix"))
def common_prefixes(spark, sf_dir):
    return _pairs(spark, sf_dir, prefix=text.common_prefix(F.col("a"), F.col("b")))


@query("auto_fuzziness", "SELECT DISTINCT n_name AS word, CASE WHEN length(n_name) < 3 THEN 0 WHEN length(n_name) < 6 THEN 1 ELSE 2 END AS errors FROM nation")
def auto_errors(spark, sf_dir):
    return read(spark, sf_dir, "nation").select(F.col("n_name").alias("word"), text.auto_fuzziness(F.col("n_name")).alias("errors")).distinct()


@query("multimap_lookup", "SELECT p_brand AS word, list(p_partkey ORDER BY p_partkey) AS values FROM part GROUP BY p_brand")
def multimap_lookup(spark, sf_dir):
    return Dictionary.of(read(spark, sf_dir, "part"), "p_brand", "p_partkey", "p_partkey")._words(True, None)


@query("dictionary_lookup", "SELECT p_brand AS word, list(p_partkey ORDER BY p_partkey) AS values FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) GROUP BY p_brand")
def dictionary_lookup(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    brand = part.agg(F.min("p_brand")).first()[0]
    values = Dictionary.of(part, "p_brand", "p_partkey", "p_partkey").lookup(brand)
    return spark.createDataFrame([(brand, values)], "word string, values array<long>")


_BRANDS = "SELECT p_brand AS word, list(p_partkey ORDER BY p_partkey) AS values, count(*) AS n FROM part GROUP BY p_brand"


@query("dictionary_prefix", f"SELECT word, CAST(row_number() OVER (ORDER BY word) AS INTEGER) AS rank, values FROM ({_BRANDS}) WHERE starts_with(word, 'Brand#') AND n % 2 = 0 ORDER BY word LIMIT 7")
def dictionary_prefix(spark, sf_dir):
    """Keys that begin alike, kept by a predicate on their values."""
    return Dictionary.of(read(spark, sf_dir, "part"), "p_brand", "p_partkey", "p_partkey").prefix("Brand#", 7, F.size("values") % 2 == 0)


@query("dictionary_fuzzy", f"SELECT word, levenshtein(word, 'Brand#1') AS distance, CAST(row_number() OVER (ORDER BY levenshtein(word, 'Brand#1'), word) AS INTEGER) AS rank, values FROM ({_BRANDS}) WHERE levenshtein(word, 'Brand#1') <= 1".replace("levenshtein(word, 'Brand#1') AS", "CAST(levenshtein(word, 'Brand#1') AS INTEGER) AS"))
def dictionary_fuzzy(spark, sf_dir):
    return Dictionary.of(read(spark, sf_dir, "part"), "p_brand", "p_partkey", "p_partkey").fuzzy("Brand#1", 1)


@query("dictionary_find", "SELECT n_name AS word, CAST(levenshtein(n_name, 'IRELAND') AS INTEGER) AS distance, CAST(row_number() OVER (ORDER BY levenshtein(n_name, 'IRELAND'), n_name) AS INTEGER) AS rank, [n_nationkey] AS values FROM nation")
def dictionary_find(spark, sf_dir):
    """Without a bound on the distance every word is ranked."""
    return Dictionary.of(read(spark, sf_dir, "nation"), "n_name", "n_nationkey").find("IRELAND")


@query("duplicate_ids", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def duplicate_ids(spark, sf_dir):
    """The ids a new batch would share with an index."""
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left_semi").select("doc_id")


@query("contiguous_versions", "SELECT version FROM (SELECT version, row_number() OVER (ORDER BY version) AS place FROM (SELECT DISTINCT CAST(p_size AS BIGINT) AS version FROM part WHERE p_size > 0)) WHERE version = place")
def contiguous(spark, sf_dir):
    return contiguous_versions(read(spark, sf_dir, "part").select(F.col("p_size").alias("version")))


def _indexed(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """English documents first, the rest as a patch."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "doc_id", *FIELDS)
    options = IndexOptions(order_by=("doc_id",))
    first = SearchIndex(spark, options).insert(docs.filter("lang = 'en'"))
    return first.apply_patch(first.create_patch(docs.filter("lang is distinct from 'en'")))


@query("patch_merge_stats", ORACLE_SQL["field_stats"])
def patch_merge_stats(spark, sf_dir):
    return _indexed(spark, sf_dir).table("field_stats")


@query("patch_equals_rebuild", _scores_sql(EVEN, _TERMS) + " SELECT CAST(doc_id AS VARCHAR) AS id, round(sum(score), 6) AS score FROM scores GROUP BY doc_id")
def patch_equals_rebuild(spark, sf_dir):
    """A search of base and patch has the scores of an index built in one go."""
    return _indexed(spark, sf_dir).search(ASKED, include_docs=False).select("id", F.round("score", 6).alias("score"))


@query(
    "ndcg_at_10",
    _scores_sql({"text": 1}, _list(WORDS))
    + ", ranked AS (SELECT term, doc_id, row_number() OVER (PARTITION BY term ORDER BY score DESC, doc_id) AS rank FROM scores), "
    f"judged AS (SELECT term, doc_id, quality FROM labels CROSS JOIN (SELECT unnest([{_list(WORDS)}]) AS term)), "
    "dcg AS (SELECT term, sum(quality / log2(rank + 1)) AS dcg FROM ranked JOIN judged USING (term, doc_id) WHERE rank <= 10 GROUP BY term), "
    "ideal AS (SELECT term, quality, row_number() OVER (PARTITION BY term ORDER BY quality DESC) AS rank FROM judged), "
    "idcg AS (SELECT term, sum(quality / log2(rank + 1)) AS idcg FROM ideal WHERE rank <= 10 GROUP BY term) "
    "SELECT count(*) AS queries, round(avg(CASE WHEN idcg > 0 THEN coalesce(dcg, 0) / idcg ELSE 0 END), 6) AS ndcg FROM idcg LEFT JOIN dcg USING (term)",
)
def ndcg_at_10(spark, sf_dir):
    """Each word is a query; a label's quality is its document's relevance for all of them."""
    scores = searched(spark, sf_dir, {"text": 1.0}, WORDS)
    asked = spark.createDataFrame([(w, w) for w in WORDS], "query_id string, term string")
    best = bm25f.rank_many(scores, asked, 10).select("query_id", F.col("internal_id").alias("doc_id"), "rank")
    judged = asked.select("query_id").crossJoin(read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("relevance")))
    return mean_ndcg(best, judged).select("queries", F.round("ndcg", 6).alias("ndcg"))


def _stems(spark: SparkSession, sf_dir: str, analyzer: analysis.Analyzer) -> DataFrame:
    return bm25f.vocabulary(texts(spark, sf_dir)).select("word", analyzer.analyze(F.col("word")).alias("stem"))


@query("porter_stem")
def porter_stem(spark, sf_dir):
    return _stems(spark, sf_dir, analysis.english())


@query("cistem_stem")
def cistem_stem(spark, sf_dir):
    return _stems(spark, sf_dir, analysis.german())


def _language_search(spark: SparkSession, sf_dir: str, analyzer: analysis.Analyzer, asked: str) -> DataFrame:
    one = spark.createDataFrame([(0, asked)], "query_id long, text string")
    terms = [r.term for r in bm25f.query_terms(one, analyzer).collect()]
    return total(searched(spark, sf_dir, {"text": 1.0, "source": 1.0}, terms, analyzer=analyzer, fields=["text", "source"]))


@query("english_search")
def english_search(spark, sf_dir):
    return _language_search(spark, sf_dir, analysis.english(), "The things that were heating, stupidly")


@query("german_search")
def german_search(spark, sf_dir):
    return _language_search(spark, sf_dir, analysis.german(), "Die Einheiten und das Beste")


# the index itself, over the parts

_PART_EVEN = {"p_name": 1, "p_type": 1}
_PART_ASKED = "red STEEL, small"
_PART_IN = _list(["red", "steel", "small"])
_AS_ID = "CAST(doc_id AS VARCHAR) AS id"
_PART_TOTAL = f" SELECT {_AS_ID}, round(sum(score), 6) AS score FROM scores GROUP BY doc_id"


def _part_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), "p_partkey", "p_name", "p_type", "p_size")


def _part_index(spark: SparkSession, sf_dir: str, **options) -> SearchIndex:
    return SearchIndex(spark, IndexOptions(order_by=("p_partkey",), **options)).insert(_part_docs(spark, sf_dir))


def _scored(page: DataFrame) -> DataFrame:
    return page.withColumn("score", F.round("score", 6))


@query("index_page", _scores_sql(_PART_EVEN, _PART_IN, **_PART) + _SUMMED + f" SELECT rank, {_AS_ID}, round(score, 6) AS score FROM ranked WHERE rank > 10 AND rank <= 30")
def index_page(spark, sf_dir):
    return _scored(_part_index(spark, sf_dir).search(_PART_ASKED, limit=20, offset=10, include_docs=False))


@query("index_fields", _scores_sql({"p_type": 2.5}, _PART_IN, **_PART) + _PART_TOTAL)
def index_fields(spark, sf_dir):
    return _scored(_part_index(spark, sf_dir).search(_PART_ASKED, fields=["p_type^2.5", "p_name^0"], include_docs=False)).drop("rank")


@query(
    "index_documents",
    _scores_sql(_PART_EVEN, _PART_IN, **_PART) + _SUMMED
    + f" SELECT rank, {_AS_ID}, p_name AS name, p_size AS size, array_to_string(list_transform(regexp_extract_all(p_type, '\\w+|\\W+'), lambda t: CASE WHEN lower(t) IN ({_PART_IN}) THEN '<i>' || t || '</i>' ELSE t END), '') AS marked "
    "FROM ranked JOIN part ON doc_id = p_partkey WHERE rank <= 15",
)
def index_documents(spark, sf_dir):
    """Kept documents of the page, with their matches marked."""
    page = _part_index(spark, sf_dir, keep_documents=True).search(_PART_ASKED, limit=15, highlighted_fields=["p_type"], highlight_before="<i>", highlight_after="</i>")
    return page.select("rank", "id", F.get_json_object("doc", "$.p_name").alias("name"), F.get_json_object("doc", "$.p_size").cast("int").alias("size"), F.col("highlighted_p_type").alias("marked"))


@query("index_id_filter", _scores_sql(_PART_EVEN, _PART_IN, **_PART) + _PART_TOTAL.replace("FROM scores", "FROM scores WHERE CAST(doc_id AS VARCHAR) LIKE '%7'"))
def index_id_filter(spark, sf_dir):
    """The filter goes by the id and after the scores, so the statistics are those of all documents."""
    return _scored(_part_index(spark, sf_dir).search(_PART_ASKED, id_filter=lambda i: i.endswith("7"), include_docs=False)).drop("rank")


@query("index_stored", _scores_sql(_PART_EVEN, _PART_IN, **_PART) + _PART_TOTAL)
def index_stored(spark, sf_dir):
    """Saved, loaded and searched."""
    path = f"{shared_dir(spark)}/lexigrid-stored-{uuid.uuid4().hex}"
    _part_index(spark, sf_dir).save(path)
    return _scored(SearchIndex.load(spark, path).search(_PART_ASKED, include_docs=False)).drop("rank")


@query("index_synced", _scores_sql(_PART_EVEN, _PART_IN, **_PART) + _PART_TOTAL)
def index_synced(spark, sf_dir):
    """A remote index of the small parts, then two patches with the others, fetched in order."""
    at = f"{shared_dir(spark)}/lexigrid-synced-{uuid.uuid4().hex}"
    docs = _part_docs(spark, sf_dir)
    now = SearchIndex(spark, IndexOptions(order_by=("p_partkey",))).insert(docs.filter("p_size <= 20"))
    now.save(f"{at}/index")
    for version, some in ((1, "p_size > 20 and p_size <= 35"), (2, "p_size > 35 or p_size is null")):
        patch = now.create_patch(docs.filter(some))
        patch.write(spark, f"{at}/patch-{version}")
        now = now.apply_patch(patch)
    options = IndexOptions(order_by=("p_partkey",), index_url=f"{at}/index", patch_url=f"{at}/patch-{{version}}")
    first, _ = SearchIndex(spark, options).sync()
    second, result = first.sync()
    if (second.version, result.number_of_applied_patches) != (2, 2):
        raise ValueError(f"the patches didn't arrive: {result}")
    return _scored(second.search(_PART_ASKED, include_docs=False)).drop("rank")


@query("index_removed", _scores_sql(_PART_EVEN, _PART_IN, **{**_PART, "table": "(SELECT * FROM part WHERE p_size <= 25)"}) + _PART_TOTAL)
def index_removed(spark, sf_dir):
    """Without some documents the index scores as if it had never held them."""
    gone = _part_docs(spark, sf_dir).filter("p_size > 25").select("id")
    return _scored(_part_index(spark, sf_dir).remove(gone).search(_PART_ASKED, include_docs=False)).drop("rank")


_PART_NEAR = (
    ", vocabulary AS (SELECT DISTINCT term AS word FROM post), best AS (SELECT word, levenshtein(word, 'rid') AS distance FROM vocabulary "
    "WHERE levenshtein(word, 'rid') <= 2 ORDER BY distance, word LIMIT 3)"
)


@query("index_expanded", _scores_sql(_PART_EVEN, "SELECT word FROM best UNION ALL SELECT 'rid'", **_PART).replace(", w(field", f"{_PART_NEAR}, w(field", 1) + _PART_TOTAL)
def index_expanded(spark, sf_dir):
    """A misspelt word is widened to the nearest words of the index."""
    built = _part_index(spark, sf_dir, enable_autocomplete=True)
    return _scored(built.search("rid", fuzziness=2, max_expansions=3, include_docs=False)).drop("rank")


@query("index_autocomplete", f"SELECT word, CAST(row_number() OVER (ORDER BY word) AS INTEGER) AS rank FROM ({_PART_WORDS}) WHERE starts_with(word, 's') ORDER BY word LIMIT 4")
def index_autocomplete(spark, sf_dir):
    return _part_index(spark, sf_dir, enable_autocomplete=True).autocomplete("S", limit=4)


_BATCH = [(1, "red steel"), (2, "small"), (3, "nothing of that sort")]


@query(
    "index_batch",
    _scores_sql({"p_name": 2, "p_type": 1}, "SELECT term FROM q", **_PART).replace(
        "WITH ", "WITH q AS (SELECT query_id, unnest(string_split(words, ' ')) AS term FROM (VALUES " + ", ".join(f"({i}, '{w}')" for i, w in _BATCH) + ") v(query_id, words)), ", 1
    )
    + f", summed AS (SELECT query_id, doc_id, {_ADDED} FROM scores JOIN q USING (term) GROUP BY query_id, doc_id) "
    f"SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, {_AS_ID}, round(score, 6) AS score FROM summed "
    "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 8",
)
def index_batch(spark, sf_dir):
    asked = spark.createDataFrame(_BATCH, "query_id int, text string")
    return _scored(_part_index(spark, sf_dir).search_batch(asked, fields=["p_name^2", "p_type"], limit=8))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of a weighted search over all fields."""
    return bm25f_top_k(spark, sf_dir)
