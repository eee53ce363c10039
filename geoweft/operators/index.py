"""Indexing operators: bounds, Morton order, implicit box trees and their metadata.

The tree over N leaves is the complete binary tree of the next power of two, with the missing leaves
cut off at the right; nodes are numbered level by level without the cut ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import cols
from ..functions.morton import BITS, morton_code
from ..schema import axes

Names = Sequence[str]
#: Leading bits of a Morton code that tell the cells in which rows are numbered.
CELL_BITS = 12


def scene_bounds(points: DataFrame, names: Names | None = None) -> DataFrame:
    """(b, min_*, max_*): one partial and one final aggregate."""
    names = names or axes(points)
    return points.groupBy("b").agg(*(F.min(a).alias(f"min_{a}") for a in names), *(F.max(a).alias(f"max_{a}") for a in names))


def morton_encode(points: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """``points`` with their ``code`` within the sample's bounds."""
    names = axes(points)
    bounds = scene_bounds(points) if bounds is None else bounds
    code = morton_code(cols(names), cols(names, "min_"), cols(names, "max_"))
    return points.join(bounds, "b").withColumn("code", code).drop(*(f"{m}_{a}" for m in ("min", "max") for a in names))


def morton_order(points: DataFrame, key: str = "pid", bounds: DataFrame | None = None) -> DataFrame:
    """(b, leaf_pos, key, code, coordinates): the order of (code, key) in each sample.

    Rows are numbered inside the cells of the leading bits of the code, and a running sum of the cells' counts
    (at most 2 ** CELL_BITS a sample) gives each cell's first place, so one large sample is many tasks.
    """
    dims = len(axes(points))
    cell = F.shiftright("code", BITS[dims] * dims - CELL_BITS)
    coded = morton_encode(points, bounds).withColumn("_cell", cell)
    cells = coded.groupBy("b", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    cells = cells.select("b", "_cell", F.expr("coalesce(sum(_n) OVER (PARTITION BY b ORDER BY _cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("_base"))
    ranked = coded.withColumn("_rank", F.expr(f"row_number() OVER (PARTITION BY b, _cell ORDER BY code, {key}) - 1"))
    return ranked.join(cells, ["b", "_cell"]).withColumn("leaf_pos", (F.col("_base") + F.col("_rank")).cast("long")).drop("_cell", "_rank", "_base")


def leaf_level(n: Column) -> Column:
    """Levels above the leaves of a tree of ``n`` leaves: the length in bits of n - 1."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(F.lit(0)).cast("int")


def tree_metadata(points: DataFrame) -> DataFrame:
    """(b, num_leaves, leaf_level, virtual_leaves, num_real_nodes, dim) for each sample."""
    dim = len(axes(points)) if "x" in points.columns else None
    n = points.groupBy("b").agg(F.count(F.lit(1)).alias("num_leaves")).withColumn("leaf_level", leaf_level(F.col("num_leaves")))
    n = n.withColumn("virtual_leaves", F.expr("shiftleft(1L, leaf_level) - num_leaves"))
    n = n.withColumn("num_real_nodes", F.expr("2 * num_leaves - 1 + bit_count(virtual_leaves)"))
    return n.withColumn("dim", F.lit(dim)) if dim else n


def _boxes(leaves: DataFrame, names: Names) -> DataFrame:
    """Merges leaf boxes upward: a node of level l covers the leaves that share their upper l bits."""
    size = leaves.groupBy("b").agg(F.count(F.lit(1)).alias("num_leaves"))
    size = size.withColumn("leaf_level", leaf_level(F.col("num_leaves"))).withColumn("virtual", F.expr("shiftleft(1L, leaf_level) - num_leaves"))
    rows = leaves.join(size, "b").withColumn("level", F.explode(F.sequence(F.lit(0), F.col("leaf_level"))))
    rows = rows.withColumn("j", F.expr("shiftright(leaf_pos, leaf_level - level)"))
    nodes = rows.groupBy("b", "level", "j").agg(
        *(F.min(f"lo_{a}").alias(f"lo_{a}") for a in names), *(F.max(f"hi_{a}").alias(f"hi_{a}") for a in names),
        F.first("leaf_level").alias("leaf_level"), F.first("virtual").alias("virtual"),
    )
    # nodes cut off on the levels above: those of a complete subtree under each cut node of the last of them
    nodes = nodes.withColumn("cut", F.expr("shiftright(virtual, leaf_level - level + 1)"))
    return nodes.select(
        "b", "level", "j", F.expr("shiftleft(1L, level) - 1 + j - (2 * cut - bit_count(cut))").alias("mem_idx"), *(f"{s}_{a}" for s in ("lo", "hi") for a in names)
    )


def tree_nodes(points: DataFrame) -> DataFrame:
    """(b, level, j, mem_idx, lo_*, hi_*): boxes of all nodes of the tree over the Morton order."""
    names = axes(points)
    order = morton_order(points)
    return _boxes(order.select("b", "leaf_pos", *(F.col(a).alias(f"{s}_{a}") for s in ("lo", "hi") for a in names)), names)


def tree_links(nodes: DataFrame) -> DataFrame:
    """(b, mem_idx, left_child_mem, right_child_mem, mem_to_leaf): children by memory index, -1 if none."""
    key = nodes.select("b", "level", "j", "mem_idx")
    depth = key.groupBy("b").agg(F.max("level").alias("depth"))
    child = key.select("b", (F.col("level") - 1).alias("level"), F.expr("shiftright(j, 1)").alias("j"), F.expr("j % 2").alias("side"), F.col("mem_idx").alias("c"))
    kids = child.groupBy("b", "level", "j").agg(F.max(F.when(F.col("side") == 0, F.col("c"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("c"))).alias("r"))
    joined = key.join(kids, ["b", "level", "j"], "left").join(depth, "b")
    minus = F.lit(-1).cast("long")
    return joined.select(
        "b", "mem_idx", F.coalesce("l", minus).alias("left_child_mem"), F.coalesce("r", minus).alias("right_child_mem"),
        F.when(F.col("level") == F.col("depth"), F.col("j")).otherwise(minus).alias("mem_to_leaf"),
    )


def vertex_names(kind: str) -> list[list[str]]:
    """Coordinate columns of the vertices of a primitive table."""
    if kind == "segment":
        return [[f"{a}{v}" for a in "xy"] for v in range(2)]
    if kind == "triangle":
        return [[f"{a}{v}" for a in "xyz"] for v in range(3)]
    raise ValueError("RayBVH: primitive_type must be 'segment' or 'triangle'")


def primitive_boxes(primitives: DataFrame, kind: str) -> DataFrame:
    """(b, prim_id, lo_*, hi_*, centre): vertex bounds, and the vertex mean as x, y[, z]."""
    vertices = vertex_names(kind)
    names = "xyz"[: len(vertices[0])]
    out = {}
    for k, a in enumerate(names):
        own = [F.col(v[k]) for v in vertices]
        out[f"lo_{a}"], out[f"hi_{a}"] = F.least(*own), F.greatest(*own)
        out[a] = sum(own[1:], own[0]) / F.lit(float(len(own)))
    return primitives.select("b", "prim_id", *(c.alias(n) for n, c in out.items()))


def primitive_nodes(primitives: DataFrame, kind: str) -> DataFrame:
    """Tree boxes over primitives: Morton order of the centres within the bounds of all boxes."""
    boxes = primitive_boxes(primitives, kind)
    names = axes(boxes)
    bounds = boxes.groupBy("b").agg(*(F.min(f"lo_{a}").alias(f"min_{a}") for a in names), *(F.max(f"hi_{a}").alias(f"max_{a}") for a in names))
    return _boxes(morton_order(boxes, "prim_id", bounds), names)
