"""Connected components of a graph of edges, by alternating large-star and small-star rounds.

Each round is two joins; stars are aggregated to their least neighbour before they are shuffled, and
the edges of a round are written to shared storage, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, materialize

#: The number of rounds is logarithmic in the longest path; this is a guard against a fault.
MAX_ROUNDS = 60


def _star(pairs: DataFrame, keep: str) -> DataFrame:
    """For each ``u`` of ``pairs(u, v)``: its least neighbour or itself, given to the neighbours kept."""
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return pairs.join(least, "u").filter(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of ``edges(a, b)``; a component is named by its least node."""
    ordered = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialize(ordered, "edges")
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    sign = None
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, "v > u").distinct()
        # an edge of small-star leads from a node to a lower one; the node itself gets the least too
        down = large.filter("u > v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        after = materialize(small.select("e.u", "e.v").filter("u <> v").distinct(), "edges")
        row = after.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        discard(now)
        now = after
        if (row["n"], row["h"]) == sign:
            break
        sign = (row["n"], row["h"])
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)
