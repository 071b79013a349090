"""Chat formatting as a prefix tree.

Conversations that share their initial turns share the nodes of those turns.  A
node belongs to the conversation with the least id that passes it, so what a
conversation owns is always the tail of its path: its *segment*.  A tree is emitted
depth first, every token once, segment after segment: at a branching the child
with the least owner comes first.

A turn is rendered as the marker of its role, the BPE tokens of its text and
``END``; a role without a marker of its own has ``OTHER``, its name's tokens and
``NAMED``.  Position ids count from the start of the conversation, so they go on
from where the shared turns ended.  A segment's tokens attend to each other
causally and to the ancestors' intervals, one for each segment that its path
crossed.

Texts are only moved to their own conversation and segment.  Segments are ordered by
ranges of (tree, place): each task numbers its own and adds up its tokens, and a tree
that runs over several ranges gets what stood before by a sum for each range.  So a
tree of any size, such as all conversations under one system prompt, needs no task of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import VOCABULARY, _lists, codec
from .common import materialize, read
from .textkit import group_starts

ROLES = {"system": 50_257, "user": 50_258, "assistant": 50_259, "tool": 50_260}
OTHER, NAMED, END = 50_261, 50_262, 50_263

BATCH_TOKENS = 1 << 18

_PATH = "conv_id long, depth int, node binary, tokens array<int>"
_SEGMENT = (
    "conv_id long, tree_id long, within long, first_depth int, first_position long, n_tokens long, "
    "place array<struct<up:int,owner:long>>, ancestors array<struct<owner:long,n:long>>"
)


def render(role: str, text: str, vocabulary: str = VOCABULARY) -> np.ndarray:
    """Tokens of one turn."""
    coder = codec(vocabulary)
    opening = [ROLES[role]] if role in ROLES else [OTHER, *coder.encode(role).tolist(), NAMED]
    return np.concatenate([np.array(opening, np.int32), coder.encode(text), np.array([END], np.int32)])


def _paths(conversations: DataFrame, vocabulary: str) -> DataFrame:
    """One row for each turn of each conversation; ``node`` stands for all turns up to it."""
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("said"),
    ).filter("conv_id is not null and said.turn is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, depths, nodes, tokens, held = [], [], [], [], 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(depths, pa.int32()), pa.array(nodes, pa.binary()), _lists(tokens)], ["conv_id", "depth", "node", "tokens"]
            )

        for batch in batches:
            for conv_id, said in zip(batch.column("conv_id").to_pylist(), batch.column("said").to_pylist()):
                node = b""
                for depth, s in enumerate(said):
                    role, text = s["role"].encode(), s["text"].encode()
                    node = hashlib.blake2b(b"%s%d %s%s" % (node, len(role), role, text), digest_size=16).digest()
                    ids.append(conv_id)
                    depths.append(depth)
                    nodes.append(node)
                    tokens.append(render(s["role"], s["text"], vocabulary))
                    held += len(tokens[-1])
                    if held >= BATCH_TOKENS:
                        yield full()
                        ids, depths, nodes, tokens, held = [], [], [], [], 0
        yield full()

    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_set("said")).alias("said")).mapInArrow(run, _PATH)


def cut_path(conv_id: int, owners: list[int], sizes: list[int]) -> dict:
    """The segment of a conversation whose turns have these owners and sizes.

    One that owns none of its turns, a copy or beginning of another, has no tokens
    of its own and ends ``within`` the segment of its last turn's owner.
    """
    own = owners[-1] == conv_id
    first = owners.index(conv_id) if own else len(owners)
    place, ancestors = [], []
    for depth, owner in enumerate(owners[: first + 1]):
        if depth and owner != owners[depth - 1]:
            # of two branches off one segment the deeper comes first
            place.append({"up": -depth, "owner": owner})
        if depth < first:
            if not ancestors or ancestors[-1]["owner"] != owner:
                ancestors.append({"owner": owner, "n": 0})
            ancestors[-1]["n"] += sizes[depth]
    return {
        "conv_id": conv_id, "tree_id": owners[0], "within": None if own else owners[-1], "first_depth": first,
        "first_position": sum(sizes[:first]), "n_tokens": sum(sizes[first:]), "place": place, "ancestors": ancestors,
    }


def _segments(paths: DataFrame) -> DataFrame:
    owned = paths.select("conv_id", "depth", "node", F.size("tokens").alias("n"))
    owners = owned.groupBy("node").agg(F.min("conv_id").alias("owner"))
    schema = pa.schema(
        [
            ("conv_id", pa.int64()), ("tree_id", pa.int64()), ("within", pa.int64()), ("first_depth", pa.int32()), ("first_position", pa.int64()), ("n_tokens", pa.int64()),
            ("place", pa.list_(pa.struct([("up", pa.int32()), ("owner", pa.int64())]))),
            ("ancestors", pa.list_(pa.struct([("owner", pa.int64()), ("n", pa.int64())]))),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = []
            for conv_id, path in zip(batch.column("conv_id").to_pylist(), batch.column("path").to_pylist()):
                cut.append(cut_path(conv_id, [p["owner"] for p in path], [p["n"] for p in path]))
            yield pa.RecordBatch.from_pylist(cut, schema)

    by_conv = owned.join(owners, "node").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "owner", "n"))).alias("path"))
    return by_conv.mapInArrow(run, _SEGMENT)


def _placed(owned: DataFrame) -> DataFrame:
    """(conv_id, segment, start) of the segments, numbered in the order of (tree, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree_now, rank, at = None, 0, 0
        for part in batches:
            if not part.num_rows:
                continue
            tree, n = part.column("tree_id").to_numpy(), part.column("n_tokens").to_numpy()
            first = group_starts(tree)
            size = np.diff(np.r_[first, len(tree)])
            before = np.cumsum(n) - n
            ranks = np.arange(len(tree)) - np.repeat(first, size) + 1
            starts = before - np.repeat(before[first], size)
            if tree[0] == tree_now:
                ranks[: size[0]] += rank
                starts[: size[0]] += at
            tree_now, rank, at = tree[-1], int(ranks[-1]), int(starts[-1] + n[-1])
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("conv_id", "tree_id", "n_tokens", "range")), pa.array(ranks), pa.array(starts)],
                ["conv_id", "tree_id", "n_tokens", "range", "nth", "from"],
            )

    ranged = owned.select("conv_id", "tree_id", "n_tokens", "place").repartitionByRange("tree_id", "place").sortWithinPartitions("tree_id", "place")
    ranged = ranged.select("conv_id", "tree_id", "n_tokens", F.spark_partition_id().alias("range"))
    local = materialize(ranged.mapInArrow(run, "conv_id long, tree_id long, n_tokens long, range int, nth long, from long"), "places")
    sums = local.groupBy("tree_id", "range").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_tokens").alias("tokens"))
    # a tree is in several ranges only where it crosses a border between two, so this has less rows than there are ranges
    earlier = Window.partitionBy("tree_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("tree_id", "range", F.sum("rows").over(earlier).alias("more"), F.sum("tokens").over(earlier).alias("shift")).filter("more is not null")
    return local.join(F.broadcast(offsets), ["tree_id", "range"], "left").select(
        "conv_id", (F.col("nth") + F.coalesce("more", F.lit(0))).cast("int").alias("segment"), (F.col("from") + F.coalesce("shift", F.lit(0))).alias("start")
    )


def chat_trees(conversations: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(tree_id, segment, conv_id, start, end, tokens, position_ids, attends), a row for each conversation.

    ``tree_id`` is the least conv_id of the tree, ``segment`` the rank (from 1) and
    ``start`` and ``end`` the token offsets in its depth-first order; ``attends`` holds the
    ancestors' intervals ``(first, until)`` in the same offsets, root first.  A conversation
    that is a beginning or a copy of another has no tokens of its own: its ``segment`` is the
    one it ends in, ``start`` and ``end`` are where, and ``attends`` covers it whole.

    Rows without a conv_id or turn are no turns.  A null role or text is an empty one.
    Repeated rows are one turn; different rows with one turn number follow each
    other by role and text.  Texts are rendered whole, however long.  An empty table gives none.
    """
    paths = materialize(_paths(conversations, vocabulary), "paths")
    cut = materialize(_segments(paths), "segments")
    placed = materialize(_placed(cut.filter("within is null")), "placed")
    own = cut.filter("within is null").join(placed, "conv_id")
    into = placed.join(cut.select("conv_id", F.col("first_position").alias("base")), "conv_id").select(
        F.col("conv_id").alias("within"), "segment", F.col("start").alias("begin"), "base"
    )
    rest = cut.filter("within is not null").join(into, "within").withColumn("start", F.col("begin") + F.col("first_position") - F.col("base"))
    kept = ["conv_id", "tree_id", "segment", "start", "first_depth", "first_position", "n_tokens"]
    segments = own.select(*kept).unionByName(rest.select(*kept))
    starts = placed.select(F.col("conv_id").alias("owner"), F.col("start").alias("first"))
    crossed = cut.select("conv_id", F.posexplode("ancestors").alias("nth", "a")).select("conv_id", "nth", "a.owner", "a.n")
    attends = crossed.join(starts, "owner").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("nth", "first", (F.col("first") + F.col("n")).alias("until")))).alias("spans")
    )
    turns = (
        paths.join(cut.filter("within is null").select("conv_id", "first_depth"), "conv_id").filter("depth >= first_depth")
        .groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "tokens"))).alias("turns"))
    )
    spans = F.array().cast("array<struct<first:long,until:long>>")
    last = F.col("first_position") + F.col("n_tokens") - 1
    return (
        segments.join(turns, "conv_id", "left").join(attends, "conv_id", "left")
        .select(
            "tree_id", "segment", "conv_id", "start", (F.col("start") + F.col("n_tokens")).alias("end"),
            F.coalesce(F.flatten("turns.tokens"), F.array().cast("array<int>")).alias("tokens"),
            F.when(F.col("n_tokens") > 0, F.sequence("first_position", F.greatest(last, "first_position"))).otherwise(F.array().cast("array<long>")).alias("position_ids"),
            F.coalesce(F.transform("spans", lambda s: F.struct(s["first"].alias("first"), s["until"].alias("until"))), spans).alias("attends"),
        )
    )


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_trees(read(spark, sf_dir, "conversations"))
