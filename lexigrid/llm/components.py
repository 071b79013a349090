"""Connected components of an edge table by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on rows (u, v) with u > v: every node links to its least neighbour."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return (
            both.filter("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _print(edges: DataFrame) -> tuple:
    """Fingerprint of an edge set, in one pass."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(u, v)``; root is the component's least node.

    Self-loops and repeated edges are allowed.  The number of rounds is
    logarithmic in the size of the largest component; each round is written to
    the shared folder, so lineage stays short.
    """
    now = materialize(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    mark = _print(now)
    while mark[0]:
        now = materialize(_star(_star(now, large=True), large=False), "edges")
        new = _print(now)
        if new == mark:
            break
        mark = new
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def classes_of(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, class_id, n_links) for every id of ``members(id, rep)``.

    Members of one ``rep`` are copies; ``links(u, v)`` join reps.  ``class_id`` is the class's
    least rep, ``n_links`` how many links the id's (least) rep has.  An id with several reps joins their classes.
    No group is collected: copies are never nodes of the graph.
    """
    each = members.groupBy("id").agg(F.min("rep").alias("low"), F.max("rep").alias("high"))
    several = each.filter("low <> high").select("id", "low")
    bridges = members.join(several, "id").filter("rep <> low").select(F.col("rep").alias("u"), F.col("low").alias("v"))
    roots = connected_components(links.select("u", "v").unionByName(bridges))
    ends = links.select(F.col("u").alias("end")).unionByName(links.select(F.col("v").alias("end"))).groupBy("end").agg(F.count(F.lit(1)).alias("n"))
    # both tables are by rep, so each copy is joined once, to one row
    by_rep = roots.join(ends, roots["node"] == ends["end"], "left").select("node", "root", "n")
    return each.join(by_rep, each["low"] == by_rep["node"], "left").select(
        "id", F.coalesce("root", "low").alias("class_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links")
    )
