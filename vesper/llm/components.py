"""Connected components of a distributed edge list, and shared steps of the pair operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import saved


#: Edges that one task may take; 16 bytes each, and a few hundred in its maps.
LOCAL = 200_000


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, local: int = LOCAL) -> DataFrame:
    """(node, component): the smallest node reachable over the undirected edges, for each node that has one.

    Alternating large-star and small-star rounds; every round is two aggregations and joins by node,
    with the result written to the shared folder. Stars shrink the diameter geometrically, so the
    number of rounds grows with the logarithm of the longest chain. Once no more than ``local`` edges
    are there, one executor task closes them at once. Nothing is gathered on the driver but counts.
    Self-loops and repeated or null-ended edges are allowed and add nothing.
    """
    now = saved(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b").distinct(), "edges")
    before = _mark(now)
    for _ in range(max_rounds):
        if before["n"] <= local:
            return saved(now.coalesce(1).mapInArrow(_close, "node bigint, component bigint"), "components")
        # the minima are written: a join of two plain exchanges can be split where one node has most of the edges
        both = now.union(now.select("b", "a"))
        least = saved(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.where("b > a").join(least, "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).where("a <> b").distinct()
        large = saved(large, "large")
        least = saved(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b")))
        now = saved(small.distinct(), "edges")
        after = _mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    stars = now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    return saved(stars.union(stars.select(F.col("component").alias("node"), "component").distinct()), "components")


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union by the smaller root, over all edges of one task."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for x, y in zip(batch["a"].to_pylist(), batch["b"].to_pylist()):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "component"])


def joined(found: DataFrame | None, edges: DataFrame) -> DataFrame:
    """Components after more edges: only the edges between components found before are looked at, so each call's work is that of what is new."""
    if found is None:
        return components(edges)
    old = found.select("node", "component")
    ends = lambda side: old.select(F.col("node").alias(side), F.col("component").alias("c" + side))
    apart = edges.join(ends("a"), "a", "left").join(ends("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    more = components(apart)
    moved = old.join(more.select(F.col("node").alias("component"), F.col("component").alias("into")), "component", "left")
    known = moved.select("node", F.coalesce("into", "component").alias("component"))
    return saved(known.union(more.join(old, "node", "left_anti").select("node", "component")), "components")


def _mark(edges: DataFrame):
    """Number and order-free checksum of the edges."""
    return edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
