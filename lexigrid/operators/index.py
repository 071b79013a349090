"""The search index: Parquet-shaped tables, built, patched, searched, stored and synced."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.analysis import resolve
from ..functions.text import field_weights
from ..plans.options import AutocompleteOptions, IndexOptions, SearchOptions, SyncResult
from ..sources.storage import FolderDriver, storage_driver
from ..sources.tables import materialize
from . import bm25f
from .flatten import flatten
from .fuzzy import auto_expansions, fuzzy_matches, prefix_matches
from .highlight import highlight
from .ordering import dense_ids

SCHEMAS = {
    "postings": "term string, internal_id long, field string, tf int, dl int",
    "field_lengths": "internal_id long, field string, dl int",
    "field_stats": "field string, doc_count long, total_dl long",
    "doc_ids": "internal_id long, id string",
    "vocabulary": "word string",
}
MAX_VERSION_UPDATES = 1000


@dataclass(frozen=True)
class Patch:
    index_id: str
    version: int
    doc_count: int
    tables: dict[str, DataFrame]
    kind: str = "add"

    def description(self) -> dict:
        return {"index_id": self.index_id, "version": self.version, "doc_count": self.doc_count, "kind": self.kind}

    def write(self, spark: SparkSession, path: str) -> None:
        FolderDriver(path).persist(spark, self.description(), self.tables)

    @staticmethod
    def read(spark: SparkSession, path: str) -> Patch | None:
        found = FolderDriver(path).get(spark)
        return None if found is None else Patch(**found[0], tables=found[1])

    def to_json(self) -> str:
        """The whole patch in one text, to be served over HTTP; for small ones."""
        return json.dumps(self.description() | tables_to_json(self.tables))

    @staticmethod
    def from_json(spark: SparkSession, text: str) -> Patch:
        about, tables = json_to_tables(spark, text)
        return Patch(about["index_id"], about["version"], about["doc_count"], tables, about["kind"])


def _document_id(docs: DataFrame, id_field: str) -> Column:
    """The id, of a dotted path too; an error at run time where it is not a non-empty string."""
    column = F.col(f"`{id_field}`") if id_field in docs.columns else F.col(id_field) if id_field.split(".")[0] in docs.columns else F.lit(None)
    kind = docs.select(column.alias("c")).schema["c"].dataType
    message = f"The document's required '{id_field}' field is missing or not a string."
    if not isinstance(kind, T.StringType):
        raise ValueError(f"{message} Got: {kind.simpleString()}")
    return F.when(column != "", column).otherwise(F.raise_error(F.lit(message)))


@dataclass(frozen=True)
class SearchIndex:
    """An immutable index; every change gives a new one."""

    spark: SparkSession
    options: IndexOptions = IndexOptions()
    tables: dict[str, DataFrame] = field(default_factory=dict)
    index_id: str = field(default_factory=lambda: uuid.uuid4().hex[:12])
    version: int = 0
    doc_count: int = 0
    #: ids of removed documents are not given again
    next_id: int = 0

    def table(self, name: str) -> DataFrame:
        return self.tables[name] if name in self.tables else self.spark.createDataFrame([], SCHEMAS[name])

    @property
    def analyzer(self):
        return resolve(self.options.language)

    # building

    def create_patch(self, docs: DataFrame) -> Patch:
        """What adding ``docs`` changes, computed once and written to the shared folder; the index stays as it is."""
        o = self.options
        # the document is one struct, so that no column of it can meet a name of ours
        boxed = docs.select(_document_id(docs, o.id_field).alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("body"))
        order = [F.col("body").getField(c) if c in docs.columns else F.col(f"body.{c}") for c in o.order_by] if o.order_by else None
        ided = dense_ids(boxed, order, self.next_id)
        ids = ided.select("internal_id", "id")
        twice = ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")
        again = twice.unionByName(ids.select("id").join(self.table("doc_ids").select("id"), "id", "left_semi")).first() if self.doc_count else twice.first()
        if again:
            raise ValueError(f"Duplicate document ID: {again.id}")
        leaves = flatten(ided, ["internal_id"], list(o.json_columns), "body").filter(F.col("field") != o.id_field)
        if o.indexed_fields:
            leaves = leaves.filter(F.col("field").isin(*o.indexed_fields))
        # texts are analysed, counted and written once; postings and lengths are read from there
        texts = materialize(bm25f.kept_texts(bm25f.analysed(leaves, self.analyzer), o.enable_autocomplete), "texts")
        post = texts.select("internal_id", "field", "dl", F.inline("counted")).select("term", "internal_id", "field", "tf", "dl")
        lengths = texts.select("internal_id", "field", "dl")
        tables = {"postings": post, "field_lengths": lengths, "field_stats": bm25f.field_stats(lengths), "doc_ids": ids}
        if o.enable_autocomplete:
            tables["vocabulary"] = materialize(texts.select(F.explode("words").alias("word")).distinct(), "vocabulary")
        if o.keep_documents:
            tables["docs"] = ided.select("internal_id", F.to_json("body").alias("doc"))
        return Patch(self.index_id, self.version + 1, ids.count(), tables)

    def apply_patch(self, patch: Patch, update_version: bool = True) -> SearchIndex:
        if patch.index_id != self.index_id:
            raise ValueError(f"The patch is for index {patch.index_id}, not {self.index_id}")
        if patch.version != self.version + 1:
            raise ValueError(f"The patch has version {patch.version}, not {self.version + 1}")
        if patch.kind != "add":
            raise ValueError(f"Unknown kind of change: {patch.kind}")
        tables = dict(self.tables)
        for name, new in patch.tables.items():
            tables[name] = tables[name].unionByName(new) if name in tables else new
        if "field_stats" in tables and "field_stats" in self.tables:
            tables["field_stats"] = tables["field_stats"].groupBy("field").agg(F.sum("doc_count").alias("doc_count"), F.sum("total_dl").alias("total_dl"))
        if "vocabulary" in self.tables and "vocabulary" in patch.tables:
            tables["vocabulary"] = tables["vocabulary"].distinct()
        return replace(self, tables=tables, doc_count=self.doc_count + patch.doc_count, next_id=self.next_id + patch.doc_count, version=self.version + update_version)

    def insert(self, docs: DataFrame) -> SearchIndex:
        """With the documents added; the version stays."""
        return self.apply_patch(self.create_patch(docs), update_version=False)

    def remove(self, ids: DataFrame | list[str]) -> SearchIndex:
        """Without these documents (an extension); the version stays, and so do the words that autocomplete offers."""
        if isinstance(ids, list):
            ids = self.spark.createDataFrame([(i,) for i in ids], "id string")
        gone = self.table("doc_ids").join(ids.select("id"), "id", "left_semi").select("internal_id")
        tables = {n: t.join(gone, "internal_id", "left_anti") for n, t in self.tables.items() if "internal_id" in t.columns}
        tables["field_stats"] = bm25f.field_stats(tables["field_lengths"])
        if "vocabulary" in self.tables:
            tables["vocabulary"] = self.tables["vocabulary"]
        return replace(self, tables=tables, doc_count=tables["doc_ids"].count() if "doc_ids" in tables else 0)

    # searching

    def get_document(self, doc_id: str) -> dict | None:
        if "docs" not in self.tables:
            return None
        found = self.table("doc_ids").filter(F.col("id") == doc_id).join(self.tables["docs"], "internal_id").orderBy("internal_id").select("doc").first()
        return json.loads(found.doc) if found else None

    def query_terms(self, query: str, how: SearchOptions = SearchOptions()) -> list[str]:
        one = self.spark.createDataFrame([(0, query)], "query_id long, text string")
        exact = [r.term for r in bm25f.query_terms(one, self.analyzer).collect()]
        if not exact or not self.options.enable_autocomplete:
            return sorted(exact)
        words = self.table("vocabulary")
        if how.fuzziness == "AUTO":
            more = auto_expansions(words, exact, how.max_expansions).select("word")
        elif how.fuzziness:
            more = fuzzy_matches(words, exact, how.fuzziness, how.max_expansions).select("word")
        else:
            return sorted(exact)
        if how.analyze_expansions:
            more = more.select(self.analyzer.analyze(F.col("word")).alias("word"))
        return sorted({*exact, *(r.word for r in more.collect())} - {""})

    def _weights(self, fields: list[str] | None) -> tuple[dict[str, float], int, float]:
        stats = self.table("field_stats")
        weights = field_weights(fields, [r.field for r in stats.select("field").collect()])
        return weights, *bm25f.collection_size(stats, weights)

    def search(self, query: str, how: SearchOptions | None = None, **options) -> DataFrame:
        """(rank, id, score[, doc]) in the order of the ranks; ``doc`` is the document as JSON."""
        how = replace(how or SearchOptions(), **options)
        # the query's own getter goes first, then kept documents, then an address, then the index's getter
        getter = how.get_document
        if getter is None and not self.options.keep_documents:
            getter = url_getter(self.options.fetch_document_url) if self.options.fetch_document_url else self.options.get_document
        if how.include_docs and not self.options.keep_documents and getter is None:
            raise ValueError("get_document is required: the index was built without keep_documents")
        terms = self.query_terms(query, how)
        weights, n, average = self._weights(how.fields)
        post = self.table("postings").filter(F.col("term").isin(*terms)) if terms else self.table("postings").limit(0)
        hits = materialize(post, "hits")  # the postings are read once, for the frequencies and for the scores
        scores = bm25f.term_scores(hits, weights, n, average, how.k1, how.b)
        ids = self.table("doc_ids")
        if how.id_filter is not None:
            scores = scores.join(ids.filter(how.id_filter(F.col("id"))).select("internal_id"), "internal_id", "left_semi")
        # documents are fetched for the page alone
        page = bm25f.rank_one(scores, how.limit, how.offset).join(ids, "internal_id")
        if how.include_docs and getter is None:
            page = page.join(self.table("docs"), "internal_id", "left").select("rank", "id", "score", "doc")
        else:
            page = page.select("rank", "id", "score")
        # joins don't keep the order; a page is small, a whole ranking is sorted by ranges
        page = page.orderBy("rank") if how.limit is None else page.repartition(1).sortWithinPartitions("rank")
        if not how.include_docs:
            return page
        return self._highlighted(page if getter is None else fetch_documents(page, getter, how.ignore_errors), terms, how)

    def _highlighted(self, page: DataFrame, terms: list[str], how: SearchOptions) -> DataFrame:
        if not how.highlighted_fields:
            return page
        for name in how.highlighted_fields:
            text = F.get_json_object("doc", f"$['{name}']")
            page = page.withColumn(f"highlighted_{name}", highlight(text, terms, self.analyzer, how.highlight_before, how.highlight_after))
        return page

    def search_batch(self, queries: DataFrame, query_id: str = "query_id", text: str = "text", fields: list[str] | None = None, limit: int | None = 10, offset: int = 0, k1: float = bm25f.K1, b: float = bm25f.B) -> DataFrame:
        """(query_id, rank, id, score) of a whole table of queries, in one job."""
        terms = bm25f.query_terms(queries, self.analyzer, query_id, text)
        weights, n, average = self._weights(fields)
        ranked = bm25f.search_many(self.table("postings"), terms, weights, n, average, limit, offset, k1, b)
        return ranked.join(self.table("doc_ids"), "internal_id").select("query_id", "rank", "id", "score")

    def autocomplete(self, word: str, how: AutocompleteOptions | None = None, **options) -> DataFrame:
        """(word, rank[, distance])."""
        how = replace(how or AutocompleteOptions(), **options)
        if not self.options.enable_autocomplete:
            raise ValueError("Autocomplete is not enabled!")
        word = word.lower()
        if how.method == "prefix":
            return prefix_matches(self.table("vocabulary"), word, how.limit)
        errors = (0 if len(word) < 3 else 1 if len(word) < 6 else 2) if how.fuzziness == "AUTO" else int(how.fuzziness)
        return fuzzy_matches(self.table("vocabulary"), word, errors, how.limit)

    # keeping

    def description(self) -> dict:
        return {"index_id": self.index_id, "version": self.version, "doc_count": self.doc_count, "next_id": self.next_id, "spec_version": 1, "options": self.options.stored()}

    @staticmethod
    def _from(spark: SparkSession, stored: tuple[dict, dict[str, DataFrame]], options: IndexOptions | None, stored_first: bool) -> SearchIndex:
        about, tables = stored
        kept = {k: tuple(v) if isinstance(v, list) else v for k, v in about["options"].items()}
        if options is None:
            merged = IndexOptions(**kept)
        elif stored_first:
            # what was left open when it was stored stays as the caller has it
            merged = replace(options, **{k: v for k, v in kept.items() if v is not None})
        else:
            given = {k: v for k, v in vars(options).items() if v != getattr(IndexOptions(), k)}
            merged = replace(IndexOptions(**kept), **given)
        return SearchIndex(spark, merged, tables, about["index_id"], about["version"], about["doc_count"], about.get("next_id", about["doc_count"]))

    def save(self, path: str) -> None:
        FolderDriver(path).persist(self.spark, self.description(), self.tables)

    @staticmethod
    def load(spark: SparkSession, path: str, options: IndexOptions | None = None) -> SearchIndex:
        """The index at ``path``; the caller's options go before the stored ones."""
        stored = FolderDriver(path).get(spark)
        if stored is None:
            raise FileNotFoundError(path)
        return SearchIndex._from(spark, stored, options, stored_first=False)

    def to_json(self) -> str:
        """The whole index in one text; for small ones."""
        return json.dumps(self.description() | tables_to_json(self.tables))

    @staticmethod
    def from_json(spark: SparkSession, text: str, options: IndexOptions | None = None) -> SearchIndex:
        return SearchIndex._from(spark, json_to_tables(spark, text), options, stored_first=False)

    def clone(self) -> SearchIndex:
        """Another handle on the same tables, which never change."""
        return replace(self, tables=dict(self.tables))

    def persist(self) -> bool:
        driver = storage_driver(self.options.storage)
        if driver is None:
            return False
        driver.persist(self.spark, self.description(), self.tables)
        return True

    def sync(self, max_version_updates: int = MAX_VERSION_UPDATES, persist: bool = True, offline: bool = False, dry_run: bool = False) -> tuple[SearchIndex, SyncResult]:
        """Load from the storage if empty, then patches, or else the whole remote index; then store.

        A missing patch ends the updates and counts as "not loaded from remote" even after others were applied.
        """
        now, o = self, self.options
        loaded = remote = written = False
        applied = size = 0
        driver = storage_driver(o.storage)
        if now.doc_count == 0 and driver is not None and (stored := driver.get(self.spark)):
            now, loaded = SearchIndex._from(self.spark, stored, now.options, stored_first=True), True
        if not offline:
            if now.doc_count > 0 and o.patch_url:
                first, remote = now.version, True
                while applied < max_version_updates:
                    path = o.patch_url.replace("{version}", str(first + applied + 1))
                    found, load = remote_patch(self.spark, path, dry_run)
                    if not found:
                        remote = False
                        break
                    size += found
                    if not dry_run:
                        now = now.apply_patch(load())
                    applied += 1
            if now.doc_count == 0 and o.index_url:
                found, load = remote_index(self.spark, o.index_url, dry_run)
                size += found
                remote = found > 0
                if found and not dry_run:
                    now = SearchIndex._from(self.spark, load(), now.options, stored_first=True)
        if persist and not dry_run:
            written = now.persist()
        return now, SyncResult(loaded, written, remote, applied, size)


def tables_to_json(tables: dict[str, DataFrame]) -> dict:
    rows = {n: [r.asDict(recursive=True) for r in t.collect()] for n, t in tables.items()}
    return {"tables": rows, "schemas": {n: t.schema.jsonValue() for n, t in tables.items()}}


def json_to_tables(spark: SparkSession, text: str) -> tuple[dict, dict[str, DataFrame]]:
    about = json.loads(text)
    return about, {n: spark.createDataFrame(rows, T.StructType.fromJson(about["schemas"][n])) for n, rows in about["tables"].items()}


def _remote(spark: SparkSession, url: str, dry_run: bool, from_json: Callable, from_folder: Callable) -> tuple[int, Callable]:
    """(bytes, loader) of a folder on any file system or of a JSON text over HTTP; 0 bytes if there is none."""
    if url.startswith(("http://", "https://")):
        size, text = fetch(url, dry_run)
        return size, lambda: from_json(text)
    return FolderDriver(url).byte_size(spark), from_folder


def remote_patch(spark: SparkSession, url: str, dry_run: bool = False) -> tuple[int, Callable[[], Patch]]:
    return _remote(spark, url, dry_run, lambda text: Patch.from_json(spark, text), lambda: Patch.read(spark, url))


def remote_index(spark: SparkSession, url: str, dry_run: bool = False) -> tuple[int, Callable[[], tuple]]:
    return _remote(spark, url, dry_run, lambda text: json_to_tables(spark, text), lambda: FolderDriver(url).get(spark))


def fetch(url: str, dry_run: bool = False, timeout: float = 60.0) -> tuple[int, str]:
    """(bytes, text) at an HTTP address; (0, "") if there is nothing (404), any other failure is an error.

    A dry run asks for the head alone, which must tell the length.
    """
    request = urllib.request.Request(url, method="HEAD" if dry_run else "GET")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as found:  # noqa: S310
            length = found.headers.get("Content-Length")
            if dry_run:
                if length is None:
                    raise ValueError(f"{url} doesn't tell its length")
                return int(length), ""
            body = found.read()
            return int(length or len(body)), body.decode()
    except urllib.error.HTTPError as error:
        if error.code == 404:
            return 0, ""
        raise


def url_getter(template: str) -> Callable[[str], dict | None]:
    """A fetcher of one document from the address with its id in it."""

    def get(doc_id: str) -> dict | None:
        with urllib.request.urlopen(template.replace("{id}", urllib.request.quote(doc_id, safe="")), timeout=60) as found:  # noqa: S310
            return json.load(found)

    return get


def fetch_documents(page: DataFrame, get: Callable[[str], dict | None], ignore_errors: bool = False) -> DataFrame:
    """``page`` with ``doc`` from a Python callback, called on the executors for these rows only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = []
            for doc_id in batch.column("id").to_pylist():
                try:
                    doc = get(doc_id)
                except Exception:
                    if not ignore_errors:
                        raise
                    doc = None
                docs.append(None if doc is None else json.dumps(doc, ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(docs, pa.string())], [*batch.schema.names, "doc"])

    return page.mapInArrow(run, T.StructType([*page.schema.fields, T.StructField("doc", T.StringType())]))


def contiguous_versions(versions: DataFrame, after: int = 0) -> DataFrame:
    """(version) of the unbroken run of patch versions that follows ``after``."""
    later = versions.select(F.col("version").cast("long").alias("version")).filter(F.col("version") > after).distinct()
    # a gap is a version whose predecessor is missing; all from the least gap on are cut off
    before = later.select((F.col("version") + 1).alias("version"))
    gaps = later.filter(F.col("version") != after + 1).join(before, "version", "left_anti").agg(F.min("version").alias("gap"), F.lit(after + 1).alias("start"))
    started = later.filter(F.col("version") == after + 1).limit(1).select(F.lit(True).alias("started"))
    return later.crossJoin(gaps).crossJoin(started).filter("gap is null or version < gap").select("version")
