"""Embedding near-dedup with an inverted multi-index.

Unit vectors are cut into two halves, each with a codebook of its own (k-means on
at most ``TRAIN_VECTORS`` vectors, those first by the hash of their id).  The
product of the codebooks is a grid of cells; a vector is posted in the cell of its
two nearest codes.  The codes grow with the square root of the vectors, to one for
``PER_CODE`` of the sample.  Every vector is a query: it visits cells in the order of the
summed distances to their codes, and each one met is verified by its cosine.

How many cells are visited follows from the target recall: pairs exactly at the
threshold (the hardest that count) are drawn at random around the training vectors, and
the number is the least for which ``TARGET_RECALL`` of them meet in one of the two
directions.

The traversal is done for a batch of queries at once.  With the codes of each half
sorted by distance, the cell of the i-th and j-th code (from 1) has ``i * j`` cells
at least as near, so the ``T`` nearest lie where ``i * j <= T``; the least ``T`` sums
there are just the cells that a queue-driven traversal pops first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read
from .components import classes_of

THRESHOLD = 0.95
TARGET_RECALL = 0.98
TRAIN_VECTORS = 20_000
PER_CELL = 32
PER_CODE = 8
#: members and queries that are compared at a time; a fuller cell is cut into several such blocks
MEMBERS, QUERIES = 2048, 4096

_EPSILON = 1e-6


@dataclass
class Index:
    first: np.ndarray
    second: np.ndarray
    visits: int

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return _square_distances(x[:, :half], self.first), _square_distances(x[:, half:], self.second)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1).astype(np.int64) * len(self.second) + b.argmin(1)

    def visited(self, x: np.ndarray) -> np.ndarray:
        """Rows x ``visits`` of the nearest cells."""
        a, b = self.distances(x)
        order_a, order_b = a.argsort(1, kind="stable"), b.argsort(1, kind="stable")
        t = min(self.visits, a.shape[1] * b.shape[1])
        i, j = np.nonzero(np.outer(np.arange(1, a.shape[1] + 1), np.arange(1, b.shape[1] + 1)) <= t)
        sums = np.take_along_axis(a, order_a, 1)[:, i] + np.take_along_axis(b, order_b, 1)[:, j]
        best = np.argpartition(sums, t - 1, axis=1)[:, :t] if t < len(i) else np.broadcast_to(np.arange(len(i)), (len(x), len(i)))
        return np.take_along_axis(order_a, i[best], 1).astype(np.int64) * b.shape[1] + np.take_along_axis(order_b, j[best], 1)


def _square_distances(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * (x @ codes.T) + (codes * codes).sum(1)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    codes = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        of = _square_distances(x, codes).argmin(1)
        order = of.argsort(kind="stable")
        present, starts = np.unique(of[order], return_index=True)
        codes[present] = np.add.reduceat(x[order], starts, axis=0) / np.bincount(of)[present][:, None]
    return codes


def _ranks(index: Index, query: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Cells that each query visits before, or with, the cell of its ``found`` vector."""
    a, b = index.distances(query)
    cell = index.cells(found)
    rows = np.arange(len(query))
    limit = a[rows, cell // len(index.second)] + b[rows, cell % len(index.second)]
    b.sort(1)
    return np.array([np.searchsorted(b[i], limit[i] - a[i] + 1e-9, side="right").sum() for i in rows])


def build_index(sample: np.ndarray, n: int, threshold: float, target: float) -> Index:
    """Codebooks for ``n`` vectors and the number of cells to visit."""
    rng = np.random.default_rng(9)
    k = int(np.clip(np.ceil(np.sqrt(n / PER_CELL)), 1, max(1, len(sample) // PER_CODE)))
    half = sample.shape[1] // 2
    index = Index(k_means(sample[:, :half], k, rng), k_means(sample[:, half:], k, rng), 1)
    query = sample[rng.choice(len(sample), min(2000, len(sample)), replace=False)]
    noise = rng.normal(size=query.shape)
    noise -= (noise * query).sum(1, keepdims=True) * query
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
    near = (threshold * query + np.sqrt(1 - threshold**2) * noise).astype(np.float32)
    met = np.minimum(_ranks(index, query, near), _ranks(index, near, query))
    index.visits = max(1, int(np.quantile(met, target, method="higher")))
    return index


def unit_vectors(vectors: DataFrame, dimension: int) -> DataFrame:
    """(vec_id, unit): little-endian 32-bit floats of length one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if not part.num_rows:
                continue
            column = part.column("embedding")
            flat = column.flatten().cast(pa.float64()).fill_null(np.nan)
            x = flat.to_numpy(zero_copy_only=False).reshape(part.num_rows, dimension)
            with np.errstate(all="ignore"):
                x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
            good = np.isfinite(x).all(1)
            unit = (x[good].astype("<f4") + np.float32(0)).tobytes()  # -0 becomes 0
            n = int(good.sum())
            offsets = pa.py_buffer((np.arange(n + 1) * 4 * dimension).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id").filter(pa.array(good)), pa.BinaryArray.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(unit)])],
                ["vec_id", "unit"],
            )

    return vectors.filter(F.size("embedding") == dimension).mapInArrow(run, "vec_id long, unit binary")


def _matrix(column: pa.Array | pa.ChunkedArray, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, dimension)


def local_links(query: np.ndarray, x: np.ndarray, member: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(id, least id of its component) under the verified pairs between queries and members."""
    p, m = np.nonzero(x @ y.T >= threshold - _EPSILON)
    u, v = query[p], member[m]
    u, v = u[u != v], v[u != v]
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """(vec_id, class_id, n_links): one row for each vector that has a direction.

    Classes are the components under "cosine of at least ``threshold``"; ``class_id`` is the
    least vec_id, its own if there is no near copy.  ``n_links`` counts the verified links of
    the vector to different ones, of those that hold the class together; copies share them.
    Only the direction of a vector counts.  Null ids, null vectors, vectors with a null or
    infinite number or of length zero, and vectors not of the commonest dimension (the
    greatest, if several are) have no row.  Rows that repeat an id are one vector with the
    links of all.  An empty table gives an empty result.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(
        "vec_id is not null and embedding is not null"
    )
    sizes = rows.filter(F.size("embedding") > 0).groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    common = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    spark = vectors.sparkSession
    schema = "vec_id long, class_id long, n_links long"
    if common is None:
        return spark.createDataFrame([], schema)
    dimension = common.d
    marks = materialize(unit_vectors(rows, dimension).withColumn("mark", F.unhex(F.md5("unit"))), "vectors")
    reps = marks.groupBy("mark").agg(F.min("vec_id").alias("rep"))
    named = materialize(marks.select("vec_id", "mark").join(reps, "mark").select(F.col("vec_id").alias("id"), "rep"), "members")
    classes = materialize(marks.groupBy("unit").agg(F.min("vec_id").alias("rep")), "units")
    n = classes.count()
    if n == 0:
        return spark.createDataFrame([], schema)
    sample = classes.select("unit", "rep").orderBy(F.xxhash64("rep"), "unit").limit(TRAIN_VECTORS).select("unit").toArrow()
    sent = spark.sparkContext.broadcast(build_index(_matrix(sample["unit"], dimension), n, threshold, target))

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sent.value.cells(_matrix(part.column("unit"), dimension))), part.column("rep"), part.column("unit")], ["cell", "rep", "unit"]
                )

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for at in range(0, part.num_rows, 512):
                some = part.slice(at, 512)
                cells = sent.value.visited(_matrix(some.column("unit"), dimension))
                of = pa.array(np.repeat(np.arange(some.num_rows), cells.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells.ravel()), some.column("rep").take(of), some.column("unit").take(of)], ["cell", "rep", "unit"]
                )

    kind = "cell long, rep long, unit binary"
    members, queries = classes.select("rep", "unit").mapInArrow(posted, kind), classes.select("rep", "unit").mapInArrow(asked, kind)
    # how many blocks of members and of queries each cell has
    member_blocks = members.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("mb"))
    query_blocks = queries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("qb"))
    blocks = materialize(member_blocks.join(query_blocks, "cell"), "cells")

    def keyed(side: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("rep"), F.col(own)).cast("int").alias(own[0])
        return side.join(blocks, "cell").select("cell", mine, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other[0]), "rep", "unit")

    def verify(asking: pa.Table, posted: pa.Table) -> pa.Table:
        u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if asking.num_rows and posted.num_rows:
            u, v = local_links(
                asking["rep"].to_numpy(), _matrix(asking["unit"], dimension), posted["rep"].to_numpy(), _matrix(posted["unit"], dimension), threshold
            )
        return pa.table([pa.array(u), pa.array(v)], ["u", "v"])

    key = ["cell", "m", "q"]
    links = keyed(queries, "qb", "mb").groupBy(*key).cogroup(keyed(members, "mb", "qb").groupBy(*key)).applyInArrow(verify, "u long, v long")
    links = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    return classes_of(named, materialize(links, "links")).withColumnRenamed("id", "vec_id")


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(read(spark, sf_dir, "embeddings"))
