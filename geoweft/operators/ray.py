"""Closest-hit ray tracing against 2-D segments and 3-D triangles.

Rays that start near each other and the primitives around them are cut together into small groups (``Scene``); a
ray's nearest hit so far bounds the section of it that is still searched.  Counted primitives up to
BROADCAST_PRIMITIVES go to every task; more are blocks (``plans/blocks``) that rays are dealt to, first to the nearest
block and then to those that are not behind its hit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import add, cols, cross2, cross3, dot, scale, sub
from ..plans import blocks
from ..storage import materialize
from .index import morton_encode, vertex_names

# Fixed value: eight units in the last place of a float32.
EPS = 8 * 1.1920928955078125e-07
#: Primitives up to which they are sent to every task.
BROADCAST_PRIMITIVES = 2_000_000
#: Primitives of a group that are tested first, and pairs of rays and primitives tested at once.
LEAF, CELLS = 64, 1 << 18
#: What rounding to single precision may add, in sizes of the scene.
SLACK = 4e-6
#: Rays that are met together.
TOGETHER = 65_536


def _hits_segments(o, d, v) -> tuple[np.ndarray, np.ndarray]:
    """t, and whether the ray meets the segment; all as arrays that broadcast."""
    edge, a = sub(v[1], v[0]), sub(v[0], o)
    size, den = dot(d, d) * dot(edge, edge), cross2(d, edge)
    t, u = cross2(a, edge) / den, cross2(a, d) / den
    return t, (size > 0) & (np.abs(den) > EPS * np.sqrt(size)) & (u >= -EPS) & (u <= 1 + EPS)


def _hits_triangles(o, d, v) -> tuple[np.ndarray, np.ndarray]:
    e1, e2, a = sub(v[1], v[0]), sub(v[2], v[0]), sub(o, v[0])
    normal, p, q = cross3(e1, e2), cross3(d, e2), cross3(a, e1)
    det, size = dot(e1, p), dot(d, d) * dot(normal, normal)
    u, w, t = dot(a, p) / det, dot(d, q) / det, dot(e2, q) / det
    return t, (size > 0) & (np.abs(det) > EPS * np.sqrt(size)) & (u >= -EPS) & (w >= -EPS) & (u + w <= 1 + EPS)


_HITS = {"segment": _hits_segments, "triangle": _hits_triangles}


def _within(t: np.ndarray, least: np.ndarray, times: float = 1.0) -> np.ndarray:
    """Whether ``t`` is as near as the least but for the tolerance."""
    return t <= least + times * EPS * np.maximum(1.0, np.abs(least))


def _span(o: np.ndarray, d: np.ndarray, lo: np.ndarray, hi: np.ndarray, t_max: float) -> tuple[np.ndarray, np.ndarray]:
    """The t at which rays (rows) enter and leave boxes (same leading shape or broadcast); the first is infinite if they miss them.

    The exact test allows a relative overshoot of EPS at the ends of a primitive, so boxes are widened by twice that.
    """
    pad = 2 * EPS * (hi - lo) + 1e-12 * np.maximum(np.abs(lo), np.abs(hi))
    near, far, inside = 0.0, t_max, True
    for k in range(o.shape[-1]):
        x, v, a, b = o[..., k], d[..., k], lo[..., k] - pad[..., k], hi[..., k] + pad[..., k]
        t0, t1 = (a - x) / v, (b - x) / v
        still = v == 0
        near = np.maximum(near, np.where(still, -np.inf, np.minimum(t0, t1)))
        far = np.minimum(far, np.where(still, np.inf, np.maximum(t0, t1)))
        inside = inside & (~still | ((x >= a) & (x <= b)))
    return np.where(inside & (near <= far), near, np.inf), far


def _entries(o: np.ndarray, d: np.ndarray, lo: np.ndarray, hi: np.ndarray, t_max: float) -> np.ndarray:
    """The t at which rays enter boxes."""
    return _span(o, d, lo, hi, t_max)[0]


def _reach(t: np.ndarray) -> np.ndarray:
    """What is clearly behind a hit at ``t``; places and hits are rounded in other ways."""
    return t + 8 * EPS * np.maximum(1.0, np.abs(t))


def _first_of_ids(ray: np.ndarray, prim: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The places of hits whose id is less than that of every nearer hit of the ray; no other can count."""
    order = np.lexsort((prim, t, ray))
    rank = np.unique(prim, return_inverse=True)[1][order]
    # a later ray has lower keys than all before, so the running minimum starts anew with each ray
    key = rank - ray[order] * (len(prim) + 1)
    first = np.ones(len(order), bool)
    first[1:] = key[1:] < np.minimum.accumulate(key)[:-1]
    return order[first]


class Scene:
    """Primitives of one sample, met by sections of rays.

    Groups of sections and the primitives that their common box meets are cut together: many rays by place, long
    sections into a near and a far half, and what begins behind a ray's nearest hit is dropped.  A few primitives
    of each group are tested first, which bounds the sections, so rays among large crossing primitives, whose
    boxes tell nothing, are short before they meet many.
    """

    def __init__(self, ids: np.ndarray, coordinates: np.ndarray, kind: str) -> None:
        self.kind, self.dims = kind, len(vertex_names(kind)[0])
        sound = np.flatnonzero(np.isfinite(coordinates).all(axis=1))
        # in no order of place, so the first of any part are spread over it
        sound = sound[np.random.default_rng(0).permutation(len(sound))]
        self.ids, self.coordinates = ids[sound], coordinates[sound]
        v = [self.coordinates[:, n * self.dims : (n + 1) * self.dims].T for n in range(self.coordinates.shape[1] // self.dims)]
        lo, hi = reduce(np.minimum, v), reduce(np.maximum, v)
        self.size = float(np.abs(self.coordinates).max(initial=0.0)) or 1.0
        pad = 2 * EPS * (hi - lo) + 1e-12 * np.maximum(np.abs(lo), np.abs(hi))
        self.lo, self.hi = (lo - pad).min(axis=1, initial=np.inf), (hi + pad).max(axis=1, initial=-np.inf)
        edges = [list(w / self.size - v[0] / self.size) for w in v[1:]]
        with np.errstate(all="ignore"):
            length = reduce(np.multiply, [np.sqrt(dot(e, e)) for e in edges])
            normal = np.nan_to_num(np.stack(cross3(*edges) if self.dims == 3 else [-edges[0][1], edges[0][0]]) / length, posinf=0.0, neginf=0.0)
        #: Least and greatest coordinates, and the line or plane with normals of at most 1; in sizes of the scene, SLACK too wide.
        self.sides = np.concatenate([(lo - pad) / self.size - SLACK, (hi + pad) / self.size + SLACK, normal, np.abs(normal), dot(list(normal), list(v[0] / self.size))[None]]).astype(np.float32)

    def _meeting(self, sides: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Primitives (columns of ``sides``) that may meet a box; the line or plane and the bounds are tested."""
        n, lo, hi = self.dims, np.clip(lo / self.size, -2.0, 2.0), np.clip(hi / self.size, -2.0, 2.0)
        middle, half, none = 0.5 * (lo + hi), 0.5 * (hi - lo), np.zeros(n)
        gap, room = np.array([[*middle, *none, -1.0], [*none, *half, 0.0]], np.float32) @ sides[2 * n :]
        at = np.flatnonzero(np.abs(gap, out=gap) <= room + np.float32(SLACK))
        lo, hi = lo.astype(np.float32), hi.astype(np.float32)
        for k in range(n):
            low, high = sides[k].take(at), sides[n + k].take(at)
            at = at[(low <= hi[k]) & (high >= lo[k])]
        return at

    def hits(self, o: np.ndarray, d: np.ndarray, t_min: float, t_max: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ray, prim_id, t) of hits as near as each ray's least, those with a lower id than all nearer ones."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        least = np.full(len(o), np.inf)

        def test(rays: np.ndarray, own: np.ndarray, keep: bool) -> None:
            step = max(1, CELLS // len(rays))
            for k in range(0, len(own), step):
                part = own[k : k + step]
                v = self.coordinates[part].T[:, None, :]
                v = [list(v[n : n + self.dims]) for n in range(0, len(v), self.dims)]
                t, good = _HITS[self.kind](list(o[rays].T[:, :, None]), list(d[rays].T[:, :, None]), v)
                t = np.where(good & (t >= t_min) & (t <= t_max), t, np.inf)
                least[rays] = np.minimum(least[rays], t.min(axis=1))
                if keep:
                    i, j = np.nonzero(np.isfinite(t) & _within(t, least[rays][:, None]))
                    found.append((rays[i], self.ids[part[j]], t[i, j]))

        with np.errstate(all="ignore"):
            for rays, own in self._groups(o, d, t_max, least, test):
                test(rays, own, True)
        ray, prim, t = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = np.flatnonzero(_within(t, least[ray]))
        keep = keep[_first_of_ids(ray[keep], prim[keep], t[keep])]
        return ray[keep], prim[keep], t[keep]

    def _groups(self, o, d, t_max, least, test) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rays and primitives that have to be tested; ``least`` is each ray's nearest hit so far."""
        if not len(self.ids) or not len(o):
            return
        t0, t1 = _span(o, d, self.lo, self.hi, t_max)
        rays = np.flatnonzero(np.isfinite(o).all(axis=1) & np.isfinite(d).all(axis=1) & (d != 0).any(axis=1) & np.isfinite(t0) & (t0 <= t1))
        t0, t1 = np.maximum(0.0, 2 * t0 - _reach(t0)), np.minimum(_reach(t1), np.finfo(float).max)
        pad = 1e-9 * self.size + 1e-12 * np.abs(o).max(axis=1)
        # rays, primitives, their sides, first and last place, primitives of the group it comes from, whether cut along the rays
        stack = [(rays, np.arange(len(self.ids)), self.sides, t0[rays], t1[rays], len(self.ids), False)]
        while stack:
            rays, own, sides, t0, t1, before, halved = stack.pop()
            t1 = np.minimum(t1, _reach(least[rays]))
            ahead = t0 <= t1
            if not ahead.all():
                rays, t0, t1 = rays[ahead], t0[ahead], t1[ahead]
            if not len(rays):
                continue
            x, v, p = o[rays], d[rays], pad[rays, None]
            a, z = x + t0[:, None] * v, x + t1[:, None] * v
            at = self._meeting(sides, (np.minimum(a, z) - p).min(axis=0), (np.maximum(a, z) + p).max(axis=0))
            if not len(at):
                continue
            dull = halved and len(at) > 0.7 * before
            if len(rays) * len(at) <= 128 * LEAF or len(rays) == 1 and dull:
                yield rays, own[at]
                continue
            if len(at) < 0.6 * len(own):
                own, sides = own[at], sides.take(at, axis=1)
            if len(at) > 8 * LEAF:
                test(rays, own[:LEAF], False)
                t1 = np.minimum(t1, np.maximum(t0, _reach(least[rays])))
                z = x + t1[:, None] * v
            long = np.median(np.abs(z - a).max(axis=1)) > 2 * np.ptp(a, axis=0).max()
            if len(rays) == 1 or long and not dull:
                middle = 0.5 * (t0 + t1)
                stack += [(rays, own, sides, middle, t1, len(at), True), (rays, own, sides, t0, middle, len(at), True)]
            else:
                ends = np.concatenate([a, z], axis=1)
                order = np.argpartition(ends[:, int(np.argmax(np.ptp(ends, axis=0)))], len(rays) // 2)
                stack += [(rays[i], own, sides, t0[i], t1[i], len(at), False) for i in (order[: len(rays) // 2], order[len(rays) // 2 :])]


def _ray_names(kind: str) -> list[str]:
    return [s + a for s in "od" for a in "xyz"[: len(vertex_names(kind)[0])]]


def _of_table(table, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Origins and directions of Arrow rows."""
    at = np.stack([table.column(c).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(c).to_numpy() for c in names], axis=1).astype(np.float64)
    return at[:, : len(names) // 2], at[:, len(names) // 2 :]


def _answer(table, keys: Sequence[str], found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> dict:
    ray, prim, t = found
    take = pa.array(ray)
    return {k: table.column(k).take(take) for k in keys} | {"prim_id": pa.array(prim, pa.int64()), "t": pa.array(t, pa.float64())}


def _near_hits(rays: DataFrame, primitives: DataFrame, kind: str, t_min: float, t_max: float, keys: Sequence[str], n: int) -> DataFrame:
    """(keys, prim_id, t): hits of each ray that are about as near as its nearest; primitives go to every task."""
    spark, names = rays.sparkSession, _ray_names(kind)
    table = primitives.toPandas().sort_values("prim_id", kind="stable")
    vertices = sum(vertex_names(kind), [])
    sent = spark.sparkContext.broadcast({b: (own["prim_id"].to_numpy(np.int64), own[vertices].to_numpy(np.float64)) for b, own in table.groupby("b")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scenes: dict[object, Scene] = {}
        for batch in _joined(batches):
            members: dict[object, list[int]] = {}
            for i, b in enumerate(batch.column("b").to_pylist()):
                members.setdefault(b, []).append(i)
            o, d = _of_table(batch, names)
            for b in members.keys() & sent.value.keys():
                if b not in scenes:
                    scenes[b] = Scene(*sent.value[b], kind)
                own = np.array(members[b])
                ray, prim, t = scenes[b].hits(o[own], d[own], t_min, t_max)
                yield pa.RecordBatch.from_pydict(_answer(batch, keys, (own[ray], prim, t)))

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    asked = rays.select(*dict.fromkeys([*keys, "b", *names]))
    # rays of a task start near each other, so they meet about the same primitives
    placed = morton_encode(asked.withColumns({a: F.col(f"o{a}").cast("double") for a in "xyz"[: len(names) // 2]}))
    dealt = placed.select(*asked.columns, "code").repartitionByRange(parts, "b", "code", *(k for k in keys if k != "b"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.select(*keys).schema)
    return dealt.drop("code").mapInArrow(run, f"{types}, prim_id long, t double")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about TOGETHER rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= TOGETHER:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _near_hits_in_blocks(rays: DataFrame, primitives: DataFrame, kind: str, t_min: float, t_max: float, keys: Sequence[str], n: int) -> DataFrame:
    """As ``_near_hits``, for any number of primitives: rays meet the first block on their way, then those not behind its hit."""
    names, vertices = _ray_names(kind), vertex_names(kind)
    large, small = blocks.by_size(primitives, n)
    asked = rays.select(*dict.fromkeys([*keys, "b", *names]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.select(*keys).schema) + ", prim_id long, t double"

    def search(asked: pa.Table, ids: np.ndarray, coordinates: np.ndarray) -> pa.Table:
        return pa.table(_answer(asked, keys, Scene(ids, coordinates, kind).hits(*_of_table(asked, names), t_min, t_max)))

    found = [] if small is None else [blocks.by_sample(asked, small, "prim_id", vertices, keys, search, schema)]
    if large is None:
        return found[0]
    index = blocks.build(large, "prim_id", vertices, n)
    sent = rays.sparkSession.sparkContext.broadcast(blocks.boxes(index))
    dims = len(names) // 2

    def route(at: np.ndarray, held: blocks.Boxes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        with np.errstate(all="ignore"):
            o, d = at[:, :dims], at[:, dims:]
            upper = _entries(o[:, None, :], d[:, None, :], held.upper_lo[None], held.upper_hi[None], t_max)
            ray, block = held.under(*np.nonzero(np.isfinite(upper)))
            entry = _entries(o[ray], d[ray], held.lo[block], held.hi[block], t_max)
        keep = np.isfinite(entry)
        return ray[keep], block[keep], entry[keep]

    pairs = blocks.routed(asked, names, sent, route)
    first = blocks.materialize(blocks.searched(pairs.filter("turn = 0"), index, keys, search, schema), "first-hits")
    least = first.groupBy(*keys).agg(F.min("t").alias("_least")).select(*(F.col(k).alias(f"_{k}") for k in keys), "_least")
    rest = pairs.filter("turn > 0").join(least, [F.col(k) == F.col(f"_{k}") for k in keys], "left")
    rest = rest.filter(F.col("_least").isNull() | (F.col("near") <= F.col("_least") + 8 * EPS * F.greatest(F.lit(1.0), F.abs("_least")))).select(*pairs.columns)
    return reduce(DataFrame.unionByName, [*found, first, blocks.searched(rest, index, keys, search, schema)])


def _nearest(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, best): of the hits within a relative EPS of the least t the lowest id."""
    found = hits.withColumn("least", F.expr(f"min(t) OVER (PARTITION BY {', '.join(keys)})"))
    found = found.filter(F.col("t") <= F.col("least") + EPS * F.greatest(F.lit(1.0), F.abs("least")))
    return found.groupBy(*keys).agg(F.min(F.struct("prim_id", "t")).alias("best"))


def raytrace(rays: DataFrame, primitives: DataFrame, kind: str, *, t_min: float = 1e-7, t_max: float = math.inf, keys: Sequence[str] = ("b", "ray_id")) -> DataFrame:
    """(keys, prim_id, t, p*, hit) of all rays; a miss has prim_id -1, t infinite and points NaN.

    Of the hits within a relative EPS of the least t the lowest prim_id counts.
    """
    if not math.isfinite(t_min) or math.isnan(t_max) or t_min < 0 or t_max <= t_min:
        raise ValueError("RayBVH.trace: expected finite 0 <= t_min < t_max")
    names = "xyz"[: len(vertex_names(kind)[0])]
    # of equal primitives only the one of least id can be hit
    own = materialize(primitives.groupBy("b", *sum(vertex_names(kind), [])).agg(F.min("prim_id").alias("prim_id")), "primitives")
    n = own.count()
    best = _nearest((_near_hits if n <= BROADCAST_PRIMITIVES else _near_hits_in_blocks)(rays, own, kind, t_min, t_max, keys, n), keys)
    out = rays.join(best, list(keys), "left")
    t, hit = F.col("best.t"), F.col("best").isNotNull()
    place = add(cols([f"o{a}" for a in names]), scale(cols([f"d{a}" for a in names]), t))
    return out.select(
        *keys, F.coalesce("best.prim_id", F.lit(-1).cast("long")).alias("prim_id"), F.coalesce(t, F.lit(math.inf)).alias("t"),
        *(F.coalesce(x, F.lit(math.nan)).alias(f"p{a}") for a, x in zip(names, place, strict=True)), hit.alias("hit"),
    )
