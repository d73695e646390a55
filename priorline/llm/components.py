"""Connected components of a graph of any size, as joins and aggregations.

Alternating large-star and small-star steps: each node's neighbours are linked to the smallest of
them, until every edge points to the smallest node of its component. A step is one aggregation (the
minimum for each node, combined before the shuffle) and one join; the neighbours of a node are never
gathered. The minima are written before they are joined, so both sides of the join are shuffled for it
alone and adaptive execution splits it at a hub. Edges are written to the shared folder after each round,
so lineage stays short and a lost executor costs one round at most; a round's tables go with the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorline.sources.durable import discard, durable


def star_step(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star (over both directions, larger neighbours move) or small-star step, written."""
    forward = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    backward = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    both = forward.union(backward)
    if not large:
        both = both.where("v < u")
    lowest = durable(
        both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    )
    joined = both.join(lowest, F.col("u") == F.col("w"))
    moved = joined.where("v > u") if large else joined.where("v > m")
    linked = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
    if not large:
        linked = linked.union(lowest.where("w <> m").select(F.col("w").alias("a"), F.col("m").alias("b")))
    written = durable(linked.distinct())
    discard(lowest)
    return written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on an edge; the component is its smallest node.

    edges: (a, b) of any type with an order. Nulls and loops go; repeated edges count once. Nodes
    without an edge have no row, so an empty table gives an empty one.
    """
    current = durable(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .distinct()
    )
    fingerprint = state_of(current)
    while fingerprint[0]:
        half = star_step(current, large=True)
        discard(current)
        current = star_step(half, large=False)
        discard(half)
        after = state_of(current)
        if after == fingerprint:
            break
        fingerprint = after
    nodes = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(nodes.select(F.col("component"), F.col("component"))).distinct()


def state_of(edges: DataFrame) -> tuple:
    """Number of edges and two order-free sums of their hashes: equal only for equal edge sets."""
    return tuple(
        edges.agg(
            F.count("*"),
            F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).cast("string"),
            F.coalesce(F.sum(F.hash("b", "a").cast("long")), F.lit(0)),
        ).first()
    )
