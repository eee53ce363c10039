"""Physical strategies of the k-NN join.

``brute`` is an equi-join on the sample and a rank; Spark cuts each task's rows to k a query before the
shuffle.  ``grid`` joins by cells of equal counts (``blocks``): a query meets the nearest cell first, and is
done if its k-th distance is less than the distance to every other cell; else it meets those cells that are
nearer than that, which certifies the answer.  Of the points at one place only the k of least pid can be
among the neighbours of a query, so the others are left out before: else all cells of a crowded place would
be equally near, and every query near it would meet all of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import cols, dot, squared_distance
from ..storage import materialize
from . import blocks

#: Candidate pairs up to which ``auto`` takes the brute strategy.
BRUTE_PAIRS = 20_000_000
#: Points up to which a cloud is sent to every task.
BROADCAST_POINTS = 500_000
#: Distances of queries and points computed at once.
STEP = 1 << 20


def ranked(candidates: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """The k rows of least (dist_sq, pid) of each query."""
    order = f"row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY dist_sq, pid)"
    return candidates.withColumn("rank", F.expr(order)).filter(F.col("rank") <= k)


def _targets(points: DataFrame, names: Sequence[str]) -> DataFrame:
    return points.select("b", "pid", *(F.col(a).cast("double").alias(f"n{a}") for a in names))


def brute(points: DataFrame, queries: DataFrame, k: int, names: Sequence[str], keys: Sequence[str], n_points: int | None = None) -> DataFrame:
    """All pairs of a sample.

    Queries are dealt out by their keys, which is also what the rank needs, so there is no other shuffle
    of candidates.  A counted cloud of up to BROADCAST_POINTS points goes to every task; a larger one is
    joined by sample and block of queries, so that one sample is still many tasks.
    """
    spark = queries.sparkSession
    found = _targets(points, names)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    if (points.count() if n_points is None else n_points) <= BROADCAST_POINTS:
        pairs = queries.repartition(parts, *keys).join(F.broadcast(found), "b")
    else:
        block = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")
        copies = found.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        pairs = queries.withColumn("_block", block).join(copies, ["b", "_block"]).drop("_block")
    return ranked(pairs.withColumn("dist_sq", squared_distance(cols(names), cols(names, "n"))), keys, k)


def pair_count(points: DataFrame, queries: DataFrame) -> tuple[int, int]:
    """Candidate pairs of the brute strategy, and points."""
    both = points.select("b", F.lit(1).alias("p")).unionByName(queries.select("b", F.lit(0).alias("p")))
    sizes = both.groupBy("b").agg(F.sum("p").alias("n"), F.sum(1 - F.col("p")).alias("m"))
    row = sizes.agg(F.sum(F.col("n") * F.col("m")).alias("t"), F.sum("n").alias("n")).first()
    return row["t"] or 0, row["n"] or 0


def _near_far(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distances of points to boxes, in the order of operations of the exact distance."""
    near = [np.maximum(np.maximum(lo[..., k] - q[..., k], q[..., k] - hi[..., k]), 0.0) for k in range(q.shape[-1])]
    far = [np.maximum(np.abs(q[..., k] - lo[..., k]), np.abs(hi[..., k] - q[..., k])) for k in range(q.shape[-1])]
    return dot(near, near), dot(far, far)


def _reach(query: np.ndarray, far: np.ndarray, n: np.ndarray, k: int, n_queries: int) -> np.ndarray:
    """For each query a distance within which boxes that hold k points lie as a whole; infinite if they hold fewer."""
    order = np.lexsort((far, query))
    who, held = query[order], np.cumsum(n[order])
    first = np.searchsorted(who, np.arange(n_queries))
    before = np.concatenate([[0], held])[first]
    enough = np.flatnonzero(held - before[who] >= k)
    out = np.full(n_queries, np.inf)
    hit, at = np.unique(who[enough], return_index=True)
    out[hit] = far[order][enough[at]]
    return out


def _route(k: int) -> blocks.Route:
    def route(q: np.ndarray, held: blocks.Boxes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        near, far = _near_far(q[:, None, :], held.upper_lo[None], held.upper_hi[None])
        every = np.repeat(np.arange(len(q)), near.shape[1])
        reach = _reach(every, far.ravel(), np.tile(held.upper_n, len(q)), k, len(q))
        asked, block = held.under(*np.nonzero(near <= reach[:, None]))
        near, far = _near_far(q[asked], held.lo[block], held.hi[block])
        reach = np.minimum(reach, _reach(asked, far, held.n[block], k, len(q)))
        keep = near <= reach[asked]
        return asked[keep], block[keep], near[keep]

    return route


def _nearest(names: Sequence[str], kept: Sequence[str], k: int):
    """The k points of a block nearest to each query."""

    def search(asked: pa.Table, ids: np.ndarray, points: np.ndarray) -> pa.Table:
        q = np.stack([asked.column(a).to_numpy() for a in names], axis=1)
        most, step = min(k, len(ids)), max(1, STEP // len(ids))
        rows, hits, dist = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for a in range(0, len(q), step):
            d = [q[a : a + step, i, None] - points[None, :, i] for i in range(len(names))]
            d = dot(d, d)
            least = np.partition(d, most - 1, axis=1)[:, most - 1 : most]
            i, j = np.nonzero(d <= least)
            order = np.lexsort((ids[j], d[i, j], i))
            i, j = i[order], j[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < most
            i, j = i[keep], j[keep]
            rows.append(i + a)
            hits.append(j)
            dist.append(d[i, j])
        take, j = pa.array(np.concatenate(rows)), np.concatenate(hits)
        columns = {c: asked.column(c).take(take) for c in kept} | {"pid": ids[j]} | {f"n{a}": points[j, i] for i, a in enumerate(names)}
        return pa.table(columns | {"dist_sq": np.concatenate(dist)})

    return search


def _places(points: DataFrame, k: int, names: Sequence[str]) -> DataFrame:
    """At each place the k points of least pid, as a stored table; each task cuts its own rows before the shuffle."""
    own = points.select("b", "pid", *(F.col(a).cast("double").alias(a) for a in names))
    order = f"row_number() OVER (PARTITION BY {', '.join(['b', *names])} ORDER BY pid)"
    return materialize(own.withColumn("_copy", F.expr(order)).filter(F.col("_copy") <= k).drop("_copy"), "places")


def grid(points: DataFrame, queries: DataFrame, k: int, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Neighbours by cells of equal counts: the nearest cell, then the cells that can hold nearer points.

    Samples of at most a cell (of k points at a place at most) are searched whole.
    """
    points = _places(points, k, names)
    n_points = points.count()
    large, small = blocks.by_size(points, n_points)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema)
    schema = f"{kinds}, pid long, " + ", ".join(f"n{a} double" for a in names) + ", dist_sq double"
    search = _nearest(names, queries.columns, k)
    found = [] if small is None else [blocks.by_sample(queries, small, "pid", [list(names)], keys, search, schema)]
    if large is not None:
        found += _by_cells(large, queries, k, names, keys, n_points, search, schema)
    return ranked(reduce(DataFrame.unionByName, found), keys, k)


def _by_cells(points: DataFrame, queries: DataFrame, k: int, names: Sequence[str], keys: Sequence[str], n_points: int, search: blocks.Search, schema: str) -> list[DataFrame]:
    """Candidates of the nearest cell of each query, and of the cells that can hold nearer points."""
    index = blocks.build(points, "pid", [list(names)], n_points)
    sent = points.sparkSession.sparkContext.broadcast(blocks.boxes(index))
    pairs = blocks.routed(queries, names, sent, _route(k))
    first = blocks.searched(pairs.filter("turn = 0"), index, keys, search, schema)
    first = blocks.materialize(first, "nearest")
    found = first.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max("dist_sq").alias("_far"))
    found = found.select(*(F.col(c).alias(f"_{c}") for c in keys), F.when(F.col("_n") >= k, F.col("_far")).alias("_far"))
    same = [F.col(c) == F.col(f"_{c}") for c in keys]
    rest = pairs.filter("turn > 0").join(found, same, "left").filter("_far IS NULL OR near <= _far").select(*pairs.columns)
    return [first, blocks.searched(rest, index, keys, search, schema)]
