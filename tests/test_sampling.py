import numpy as np
import pytest

from geoweft.operators import fps, medoids

from .oracles import cloud

RNG = np.random.default_rng(5)


def dense(xyz, m, seed):
    chosen, near = [seed], np.full(len(xyz), 0)
    least = ((xyz - xyz[seed]) ** 2).sum(axis=1)
    while len(chosen) < m:
        i = int(np.argmax(least))
        d = ((xyz - xyz[i]) ** 2).sum(axis=1)
        near[d < least] = len(chosen)
        least = np.minimum(least, d)
        chosen.append(i)
    return chosen, near, least


@pytest.mark.parametrize("seed", [0, 7, -1])
def test_exact(spark, seed):
    xyz = RNG.random((257, 3))
    result = fps.fps(cloud(spark, xyz), 64, seed=seed)
    start = seed if seed >= 0 else int(np.argmin(((xyz - 0.5 * (xyz.min(0) + xyz.max(0))) ** 2).sum(axis=1)))
    chosen, near, least = dense(xyz, 64, start)
    anchors = result.anchors.orderBy("slot").collect()
    assert [r.pid for r in anchors] == chosen
    assert [r.slot for r in result.assignment.orderBy("pid").collect()] == near.tolist()
    assert [r.cnt for r in anchors] == np.bincount(near, minlength=64).tolist()
    np.testing.assert_allclose([r.radius_sq for r in anchors], [least[near == s].max() for s in range(64)], rtol=1e-12)
    assert sorted(r.coarse_rank for r in anchors) == list(range(64))


def test_fewer_distinct_points_than_anchors(spark):
    xyz = np.repeat([[0.0, 0], [1, 1]], 4, axis=0)
    assert [r.pid for r in fps.fps(cloud(spark, xyz), 5).anchors.orderBy("slot").collect()] == [0, 4, 0, 0, 0]


def test_approximate_invariants(spark):
    xyz = RNG.random((1024, 3))
    points = cloud(spark, xyz)
    result = fps.fps(points, 256, mode="approx_bucketed")
    anchors = [r.pid for r in result.anchors.collect()]
    assert len(set(anchors)) == 256
    assert fps.check_assignment(result, points).count() == 0
    got = np.array([r.dist_sq for r in result.assignment.collect()])
    d = ((xyz[:, None] - xyz[anchors][None]) ** 2).sum(axis=2).min(axis=1)
    np.testing.assert_allclose(np.sort(got), np.sort(d), rtol=1e-9, atol=1e-15)
    assert np.sqrt(got).mean() < 1.25 * np.sqrt(dense(xyz, 256, 0)[2]).mean()


@pytest.mark.parametrize("copies", [1, 50])
def test_approximate_spreads_in_large_clouds(copies):
    """Candidates of a round crowd at one place where buckets are small, also among equal points."""
    rng = np.random.default_rng(0)
    xyz = np.tile(rng.random((20_000 // copies, 3)), (copies, 1))
    order = np.lexsort((xyz * 32).astype(int).T)
    found = fps.approximate(xyz, order, 16, 0, 4, 2, 0.25, 16)
    exact = fps.exact(xyz, order, 16, 0, 256)
    assert len(set(found.chosen)) == 16
    assert np.sqrt(found.result()[1]).mean() < 1.25 * np.sqrt(exact.result()[1]).mean()


def test_upsample(spark):
    xyz = RNG.random((50, 2))
    result = fps.fps(cloud(spark, xyz), 5)
    values = spark.createDataFrame([(0, i, [float(i)]) for i in range(50)], "b int, pid long, f array<double>")
    chosen, near, _ = dense(xyz, 5, 0)
    got = {r.pid: r.f[0] for r in fps.upsample(values, result).collect()}
    assert got == {i: float(chosen[near[i]]) for i in range(50)}


def test_medoids(spark):
    xyz = np.array([[0.0, 0], [1, 0], [10, 0], [5, 5], [5, 5]])
    members = spark.createDataFrame([(0, 0, 0, 0), (0, 0, 1, 1), (0, 0, 2, 2), (0, 1, 0, 2), (0, 1, 1, 0), (0, 2, 0, 4), (0, 2, 1, 3), (0, 2, 2, 0)], "b int, grp int, slot int, pid long")
    got = {r.grp: (r.medoid, r.centroid_x) for r in medoids.select_medoids(members, cloud(spark, xyz)).collect()}
    assert got[0] == (1, pytest.approx(11 / 3)) and got[1] == (2, 5.0) and got[2][0] == 4
