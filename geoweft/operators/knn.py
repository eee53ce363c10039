"""Exact k-nearest-neighbour joins and gathers of neighbour values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import knn as plans
from ..schema import as_double, axes, require_same_axes


def knn_join(points: DataFrame, queries: DataFrame, k: int, *, keys: Sequence[str] = ("b", "qid"), positions: bool = False, strategy: str = "auto") -> DataFrame:
    """(keys, rank, pid, dist_sq[, nx, ny, nz]): the k points of the same sample with least (dist_sq, pid).

    ``strategy`` is "brute", "grid" or "auto", which counts the candidate pairs first.
    """
    names = axes(points)
    found = neighborhoods(points, queries, k, keys=keys, strategy=strategy)
    return found.select(*keys, "rank", "pid", "dist_sq", *((f"n{a}" for a in names) if positions else ()))


def neighborhoods(points: DataFrame, queries: DataFrame, k: int, *, keys: Sequence[str] = ("b", "qid"), strategy: str = "auto") -> DataFrame:
    """As ``knn_join``, with the coordinates of both the query and the neighbour."""
    names = require_same_axes("query_knn", points, queries, "query_points")
    asked = as_double(queries.select(*dict.fromkeys((*keys, "b", *names))), names)
    n_points = None
    if strategy == "auto":
        n_pairs, n_points = plans.pair_count(points, queries)
        strategy = "brute" if n_pairs <= plans.BRUTE_PAIRS else "grid"
    if strategy == "brute":
        found = plans.brute(points, asked, k, names, tuple(keys), n_points)
    elif strategy == "grid":
        found = plans.grid(points, asked, k, names, tuple(keys))
    else:
        raise ValueError("query_knn: strategy must be 'auto', 'brute' or 'grid'")
    return found.select(*asked.columns, F.col("rank").cast("int").alias("rank"), "pid", *(f"n{a}" for a in names), "dist_sq")


def attach_positions(neighbors: DataFrame, source: DataFrame) -> DataFrame:
    """Neighbour rows with the coordinates that ``source`` (which may differ from the indexed cloud) has for them."""
    names = axes(source)
    return neighbors.join(source.select("b", "pid", *(F.col(a).cast("double").alias(f"n{a}") for a in names)), ["b", "pid"])


def displaced_knn(points: DataFrame, queries: DataFrame, k: int, *, positions: bool = True, strategy: str = "auto") -> DataFrame:
    """k-NN of per-head queries (b, qid, h): heads are queries of one cloud."""
    return knn_join(points, queries, k, keys=("b", "qid", "h"), positions=positions, strategy=strategy)


def gather_values(neighbors: DataFrame, values: DataFrame, *, check: bool = True) -> DataFrame:
    """Neighbour rows with ``f`` of the neighbour, from the matching head where both have heads.

    With ``check``, an index without value is an error (one aggregate of the join's misses).
    """
    on = ["b", "pid", *(["h"] if "h" in values.columns and "h" in neighbors.columns else [])]
    if check and neighbors.join(values.select(*on), on, "left_anti").limit(1).count():
        raise ValueError("gather_neighbor_values: indices must be local source indices")
    return neighbors.join(values.select(*on, "f"), on)
