"""Connected components of an edge table by alternating stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.session import reliable_checkpoint

#: Edges that one task reads at least, if there are so many.
TASK_EDGES = 50_000


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Every node hands the least node it knows to its larger (or its smaller) neighbours."""
    both = edges.union(edges.select("v", "u")) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = both.join(least, "u")
    if large:
        found = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        found = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
    return found.where("u != v").distinct()


def _packed(edges: DataFrame, rows: int) -> DataFrame:
    """The written `edges`, of so many `rows`, in no more partitions than they need."""
    parts = -(-max(rows, 1) // TASK_EDGES)
    return edges.coalesce(parts)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of the edges (a, b); the component is its least node.

    The rounds grow with the logarithm of the longest path; each is cut off by a checkpoint. Few edges are
    read in few tasks, whatever number of partitions they were written in: the driver keeps track of every task.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    pairs = reliable_checkpoint(pairs.where("u != v").distinct())
    pairs = _packed(pairs, pairs.count())
    mark = None
    while True:
        pairs = reliable_checkpoint(_stars(_stars(pairs, True), False))
        now = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        pairs = _packed(pairs, now[0])
        if now == mark:
            break
        mark = now
    stars = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(pairs.select("v", "v").distinct())
