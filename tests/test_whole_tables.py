import numpy as np
import pytest
from pyspark.sql import functions as F

from geoweft import queries
from geoweft.operators import ray
from geoweft.plans import blocks

from .test_rays import prims, rays


def test_misses_are_shown_as_nulls(spark):
    hits = queries.ray.raytrace(rays(spark, [[0, 0, 1, 0], [0, 0, -1, 0]], 2), prims(spark, [[1, -1, 1, 1]], "segment"), "segment")
    got = {r.ray_id: (r.prim_id, r.t, r.px, r.py, r.hit) for r in queries._shown(hits, "xy").collect()}
    assert got == {0: (0, 1.0, 1.0, 0.0, True), 1: (-1, None, None, None, False)}


@pytest.mark.parametrize("kind", ["segment", "triangle"])
def test_blocks_and_broadcast_agree(spark, sf_dir, monkeypatch, kind):
    """Small blocks, some primitives with equal ids, and rays of a sample that has none."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 16)
    monkeypatch.setattr(blocks, "UPPER", 4)
    monkeypatch.setattr(blocks, "SEARCHES", 50)
    monkeypatch.setattr(ray, "LEAF", 5)
    asked, own = queries.tables.rays(spark, sf_dir, kind), queries.tables.primitives(spark, sf_dir, kind)
    swap = {"x0": "x1", "x1": "x0"}
    own = own.unionByName(own.filter("prim_id % 7 = 0").select(*(F.col(swap.get(c, c)).alias(c) for c in own.columns)))
    own = own.unionByName(own.filter("prim_id % 50 = 1").withColumn("b", F.lit(5)))
    asked = asked.unionByName(asked.filter("ray_id % 3 = 0").withColumn("b", F.lit(5))).unionByName(asked.limit(3).withColumn("b", F.lit(9)))
    found = []
    for most in (10**6, 10):
        monkeypatch.setattr(ray, "BROADCAST_PRIMITIVES", most)
        found.append(sorted(map(repr, ray.raytrace(asked, own, kind, t_max=3.0).collect())))
    assert found[0] == found[1] and any("hit=True" in r for r in found[0]) and any("hit=False" in r for r in found[0])


def test_few_pairs_are_tested(monkeypatch):
    """A ray through a regular wall of triangles meets a small part of them."""
    rng, n = np.random.default_rng(3), 60
    x, y = (a.ravel().astype(float) for a in np.meshgrid(np.arange(n), np.arange(n)))
    z = np.zeros(n * n)
    scene = ray.Scene(np.arange(n * n), np.stack([x, y, z, x + 1, y, z, x, y + 1, z], axis=1), "triangle")
    o = np.concatenate([rng.random((500, 2)) * n, np.full((500, 1), -0.5)], axis=1)
    tested, hits = [], ray._hits_triangles
    monkeypatch.setitem(ray._HITS, "triangle", lambda o, d, v: tested.append(v[0][0].size) or hits(o, d, v))
    found = scene.hits(o, np.tile([0.0, 0.0, 1.0], (500, 1)), 1e-7, np.inf)
    assert sum(tested) < 0.05 * 500 * n * n
    px, py = o[:, 0] % 1, o[:, 1] % 1
    want = {i: int(o[i, 1]) * n + int(o[i, 0]) for i in range(500) if px[i] + py[i] <= 1}
    assert dict(zip(found[0].tolist(), found[1].tolist(), strict=True)) == want


@pytest.mark.parametrize(("kind", "dims"), [("segment", 2), ("triangle", 3)])
def test_few_pairs_of_crossing_primitives_are_tested(monkeypatch, kind, dims):
    """Primitives that all reach through the whole scene, some of them equal; hits are those of all pairs."""
    rng, n, m = np.random.default_rng(4), 8000, 400
    own = rng.normal(size=(n, dims * dims))
    own[n // 2 : n // 2 + 50] = own[:50]
    ids, rays = rng.permutation(n), rng.normal(size=(m, 2 * dims))
    o, d = rays[:, :dims], rays[:, dims:]
    tested, hits = [], ray._HITS[kind]
    monkeypatch.setitem(ray._HITS, kind, lambda *a: tested.append((out := hits(*a))[0].size) or out)
    found = ray.Scene(ids, own, kind).hits(o, d, 1e-7, np.inf)
    assert sum(tested) < 0.4 * m * n
    v = [[own[None, :, k * dims + x] for x in range(dims)] for k in range(dims)]
    with np.errstate(all="ignore"):
        t, good = hits([o[:, x, None] for x in range(dims)], [d[:, x, None] for x in range(dims)], v)
    t = np.where(good & (t >= 1e-7), t, np.inf)
    near = np.isfinite(t) & ray._within(t, t.min(axis=1, keepdims=True))
    want = {int(i): int(ids[near[i]].min()) for i in np.flatnonzero(near.any(axis=1))}
    got: dict[int, int] = {}
    for i, prim in zip(found[0].tolist(), found[1].tolist(), strict=True):
        got[i] = min(prim, got.get(i, n))
    assert got == want


def test_equal_primitives_are_one_hit():
    """A ray that meets many copies of a primitive has one hit, the lowest id."""
    wall = np.tile([1.0, -1.0, 1.0, 1.0], (1000, 1))
    found = ray.Scene(np.arange(1000)[::-1], wall, "segment").hits(np.zeros((3, 2)), np.tile([1.0, 0.0], (3, 1)), 1e-7, np.inf)
    assert found[0].tolist() == [0, 1, 2] and found[1].tolist() == [0, 0, 0]


@pytest.mark.parametrize("far", [1e-12, 1.0, 1e9])
def test_rays_from_afar_and_scenes_of_any_size(far):
    """Scenes of any size are met from near and from a billion of their sizes away; rows that are no numbers are misses."""
    own = np.array([[1.0, -1, 1, 1], [2, -1, 2, 1], [np.nan, 0, 1, 1]]) * far
    o = np.array([[-1.0, 0], [-1e9, 0], [np.nan, 0], [3, 0], [0, 5]]) * far
    d = np.array([[1.0, 0], [1, 0], [1, 0], [-1, 0], [0, 0]]) * far
    found = ray.Scene(np.arange(3), own, "segment").hits(o, d, 1e-7, np.inf)
    assert dict(zip(found[0].tolist(), found[1].tolist(), strict=True)) == {0: 0, 1: 0, 3: 1}
