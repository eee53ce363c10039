"""Farthest-point sampling.

Each choice needs all earlier ones, so a sample is one Arrow group and samples run in parallel; a
sample's cloud has to fit one executor.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import cols, squared_distance
from ..schema import axes
from ..storage import materialize
from .index import morton_order

#: Rounds of the approximate mode from one refresh of all bucket maxima to the next.
REFRESH = 8


@dataclass
class FPSResult:
    """anchors(b, slot, pid, x, y[, z], radius_sq, cnt, coarse_rank) and assignment(b, pid, slot, dist_sq)."""

    anchors: DataFrame
    assignment: DataFrame


def _seed(xyz: np.ndarray, seed: int) -> int:
    if seed >= 0:
        return seed
    middle = 0.5 * (xyz.min(axis=0) + xyz.max(axis=0))
    return int(np.argmin(((xyz - middle) ** 2).sum(axis=1)))


class _Buckets:
    """Runs of the Morton order as rows of matrices, with their boxes and the farthest open point of each.

    A new anchor changes only buckets whose box is nearer to it than their farthest point is to its anchor.
    """

    def __init__(self, xyz: np.ndarray, order: np.ndarray, size: int, reuse: bool) -> None:
        n, width = len(xyz), min(size, len(xyz))
        rows = -(-n // width)
        self.ids = np.full(rows * width, n)
        self.ids[:n] = order
        self.ids = self.ids.reshape(rows, width)
        held = np.concatenate([xyz, np.full((1, xyz.shape[1]), np.nan)])[self.ids]
        self.lo, self.hi, self.at = np.nanmin(held, axis=1), np.nanmax(held, axis=1), np.moveaxis(held, 2, 0)
        self.least = np.where(self.ids < n, np.inf, -np.inf)
        self.slot = np.zeros(self.ids.shape, np.int32)
        self.place = np.empty(n, np.int64)
        self.place[order] = np.arange(n)
        #: Whether a point may be chosen again, as the exact mode does once all distinct points are chosen.
        self.reuse, self.open = reuse, self.ids < n
        self.top, self.first = np.full(rows, np.inf), self.ids.min(axis=1)
        self.stale = np.zeros(rows, bool)
        self.chosen: list[int] = []

    def commit(self, i: int) -> None:
        row, column = divmod(int(self.place[i]), self.ids.shape[1])
        x = self.at[:, row, column]
        gap = np.maximum(np.maximum(self.lo - x, x - self.hi), 0.0)
        near = _square(list(gap.T))
        if not self.reuse:
            self.open[row, column] = False
            self.stale[row] = True
        hit = np.flatnonzero(near < self.top)
        d = _square([a[hit] - v for a, v in zip(self.at, x, strict=True)])
        closer = d < self.least[hit]
        self.least[hit] = np.where(closer, d, self.least[hit])
        self.slot[hit] = np.where(closer, len(self.chosen), self.slot[hit])
        self.stale[hit] = True
        self.chosen.append(i)

    def refresh(self, rows: np.ndarray) -> None:
        """The farthest open point of buckets, the lowest index of equals."""
        rows = rows[self.stale[rows]]
        far = np.where(self.open[rows], self.least[rows], -np.inf)
        self.top[rows] = far.max(axis=1, initial=-np.inf)
        self.first[rows] = np.where(far == self.top[rows, None], self.ids[rows], len(self.place)).min(axis=1, initial=len(self.place))
        self.stale[rows] = False

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        """Slot and squared distance of each point."""
        return self.slot.ravel()[self.place], self.least.ravel()[self.place]


def _square(d: list[np.ndarray]) -> np.ndarray:
    out = d[0] * d[0]
    for x in d[1:]:
        out = out + x * x
    return out


def exact(xyz: np.ndarray, order: np.ndarray, m: int, seed: int, bucket: int) -> _Buckets:
    """Each next anchor is the point farthest from all so far, the lowest index of equals."""
    state = _Buckets(xyz, order, bucket, reuse=True)
    state.commit(_seed(xyz, seed))
    while len(state.chosen) < m:
        state.refresh(np.flatnonzero(state.stale))
        state.commit(int(state.first[state.top == state.top.max()].min()))
    return state


def _queue(state: _Buckets, size: int) -> np.ndarray:
    """The ``size`` buckets with the farthest points, brought up to date; others keep maxima that are never too small."""
    renewed = size
    while True:
        pick = np.argsort(-state.top, kind="stable")[:renewed]
        if not state.stale[pick[:size]].any():
            return pick[:size]
        state.refresh(pick)
        renewed *= 2


def approximate(xyz: np.ndarray, order: np.ndarray, m: int, seed: int, r: int, c: int, alpha: float, bucket: int) -> _Buckets:
    """Several anchors a round, from the buckets with the farthest points.

    The queue of buckets is by their last known maxima, which are never too small; its head is brought up to
    date until it holds the farthest points of all, and all buckets every REFRESH rounds.  A candidate that a
    choice of the same round has come nearer to than all before waits for a later round: in a large cloud the
    candidates crowd at one place, and its anchors would leave other places bare.
    """
    state = _Buckets(xyz, order, bucket, reuse=False)
    state.commit(_seed(xyz, seed))
    rounds = 0
    while len(state.chosen) < m:
        if rounds % REFRESH == 0:
            state.refresh(np.flatnonzero(state.stale))
        rounds += 1
        pick = _queue(state, max(r, r * c))
        before, taken = state.top[pick], 0
        for b, far in zip(pick.tolist(), before.tolist(), strict=True):
            if taken == r or len(state.chosen) == m:
                break
            state.refresh(np.array([b]))
            if state.top[b] < 0 or taken and (state.top[b] < far or state.top[b] <= alpha * alpha * before[0]):
                continue
            state.commit(int(state.first[b]))
            taken += 1
    return state


def fps(
    points: DataFrame, m: int, *, seed: int = 0, r: int = 4, c: int = 2, alpha: float = 0.25, mode: str = "exact_bucketed", bucket_size: int = 256
) -> FPSResult:
    """``m`` anchors of each sample and the nearest anchor of each point; pids number a sample from 0."""
    names = axes(points)
    order = morton_order(points).select("b", "pid", "leaf_pos", *(F.col(a).cast("double").alias(a) for a in names))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pid")
        xyz = np.stack([table.column(a).to_numpy() for a in names], axis=1)
        pid = table.column("pid").to_numpy()
        if not 1 <= m <= len(pid):
            raise ValueError("fps: target token count must be in [1, N]")
        if not -1 <= seed < len(pid):
            raise ValueError("fps: seed must be -1 or an original point index in [0, N)")
        morton = np.argsort(table.column("leaf_pos").to_numpy())
        if mode == "exact_bucketed":
            state = exact(xyz, morton, m, seed, bucket_size)
        else:
            state = approximate(xyz, morton, m, seed, r, c, alpha, bucket_size)
        chosen, (slot, least) = np.array(state.chosen), state.result()
        rows = [np.concatenate(x) for x in ((pid, pid[chosen]), (slot, np.arange(m, dtype=np.int32)), (least, np.zeros(m)))]
        anchor = np.repeat([False, True], [len(pid), m])
        key = table.column("b").take(pa.array(np.zeros(len(anchor), np.int64)))
        return pa.table({"b": key, "pid": rows[0], "slot": rows[1], "dist_sq": rows[2], "anchor": anchor})

    kind = dict(points.dtypes)["b"]
    found = materialize(order.groupBy("b").applyInArrow(run, f"b {kind}, pid long, slot int, dist_sq double, anchor boolean"), "samples")
    assignment = found.filter(~F.col("anchor")).drop("anchor")
    return FPSResult(anchor_metadata(found.filter("anchor").select("b", "slot", "pid"), assignment, order), assignment)


def anchor_metadata(anchors: DataFrame, assignment: DataFrame, order: DataFrame) -> DataFrame:
    """Anchors with coordinates, the number and the greatest squared distance of their points, and their rank in Morton order."""
    own = assignment.groupBy("b", "slot").agg(F.count(F.lit(1)).cast("int").alias("cnt"), F.max("dist_sq").alias("radius_sq"))
    out = anchors.join(own, ["b", "slot"], "left").join(order, ["b", "pid"])
    out = out.withColumn("coarse_rank", F.expr("row_number() OVER (PARTITION BY b ORDER BY leaf_pos, slot) - 1").cast("int"))
    return out.select(
        "b", "slot", "pid", *axes(order), F.coalesce("radius_sq", F.lit(0.0)).alias("radius_sq"), F.coalesce("cnt", F.lit(0)).alias("cnt"), "coarse_rank"
    )


def upsample(values: DataFrame, result: FPSResult) -> DataFrame:
    """Each point with the value ``f`` (by pid) of its nearest anchor."""
    held = result.anchors.select("b", "slot", "pid").join(values.select("b", "pid", "f"), ["b", "pid"]).select("b", "slot", "f")
    return result.assignment.select("b", "pid", "slot").join(held, ["b", "slot"]).select("b", "pid", "f")


def check_assignment(result: FPSResult, points: DataFrame) -> DataFrame:
    """Points whose stored distance is not that to their anchor (for tests and audits)."""
    names = axes(points)
    anchors = result.anchors.select("b", "slot", *(F.col(a).alias(f"n{a}") for a in names))
    rows = result.assignment.join(points, ["b", "pid"]).join(anchors, ["b", "slot"])
    return rows.filter(squared_distance(cols(names), cols(names, "n")) != F.col("dist_sq"))
