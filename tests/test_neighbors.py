from functools import reduce

import numpy as np
import pytest
from pyspark.sql import DataFrame

from geoweft.operators import interpolate, knn
from geoweft.plans import blocks
from geoweft.plans import knn as plans
from geoweft.schema import from_offsets, pack_neighbors

from .oracles import cloud
from .oracles import knn as dense

RNG = np.random.default_rng(7)
CLOUDS = {
    "uniform": RNG.random((64, 3)),
    "flat": RNG.random((200, 2)),
    "collinear": np.stack([np.linspace(0, 1, 17)] * 2, axis=1),
    "coplanar": np.concatenate([RNG.random((40, 2)), np.full((40, 1), 7.0)], axis=1),
    "duplicates": np.repeat(RNG.random((6, 3)), 3, axis=0),
    "mixed scale": RNG.random((60, 2)) * [1e6, 1e-3],
    "outlier": np.concatenate([RNG.random((50, 3)), [[1000.0] * 3, [-1000.0] * 3]]),
    "clusters": np.concatenate([RNG.normal(0, 1e-3, (80, 2)), RNG.normal(5, 1, (80, 2))]),
}


def rows(df, keys=("b", "qid")):
    return [tuple(r) for r in df.orderBy(*keys, "rank").select("qid", "rank", "pid", "dist_sq").collect()]


@pytest.mark.parametrize("name", CLOUDS)
@pytest.mark.parametrize("strategy", ["brute", "grid", "whole samples"])
def test_matches_dense(spark, name, strategy, monkeypatch):
    points = CLOUDS[name]
    if strategy == "grid":
        monkeypatch.setattr(blocks, "BLOCK_ROWS", 8)
        monkeypatch.setattr(blocks, "UPPER", 3)
        monkeypatch.setattr(blocks, "SEARCHES", 4)
    strategy = "brute" if strategy == "brute" else "grid"
    queries = np.concatenate([points[:9] + 0.01, points[:5], points[:1] + 1e6])
    index, dist = dense(points, queries, 8)
    found = rows(knn.knn_join(cloud(spark, points), cloud(spark, queries, key="qid"), 8, strategy=strategy))
    assert found == [(i, r + 1, int(index[i, r]), dist[i, r]) for i in range(len(queries)) for r in range(8)]


def test_crowded_places(spark, monkeypatch):
    """Points at few places are as many candidates as a few points of each place; ties go to the lowest pid."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 8)
    points = np.concatenate([np.array([[float(i % 5), float(i % 3)] for i in range(900)]), [[0.0, -0.0]] * 9])
    met, search = spark.sparkContext.accumulator(0), plans._nearest

    def counted(*args):
        own = search(*args)
        return lambda asked, ids, at: met.add(asked.num_rows * len(ids)) or own(asked, ids, at)

    monkeypatch.setattr(plans, "_nearest", counted)
    queries = points[:200] + [0.25, 0.0]
    index, dist = dense(points, queries, 4)
    found = rows(knn.knn_join(cloud(spark, points), cloud(spark, queries, key="qid"), 4, strategy="grid"))
    assert found == [(i, r + 1, int(index[i, r]), dist[i, r]) for i in range(len(queries)) for r in range(4)]
    assert 0 < met.value <= 200 * 15 * 4


def test_samples_do_not_leak(spark):
    parts = [CLOUDS["uniform"] + shift for shift in (0, 100, -100)]
    points, queries = (None, None)
    for b, p in enumerate(parts):
        own, ask = cloud(spark, p, b), cloud(spark, parts[(b + 1) % 3][:5], b, key="qid")
        points, queries = (own, ask) if points is None else (points.union(own), queries.union(ask))
    for strategy in ("brute", "grid"):
        found = knn.knn_join(points, queries, 4, strategy=strategy).collect()
        assert len(found) == 60
        for r in found:
            q, p = parts[(r.b + 1) % 3][r.qid], parts[r.b][r.pid]
            assert r.dist_sq == pytest.approx(((q - p) ** 2).sum(), rel=1e-12)


def test_large_and_small_samples(spark, monkeypatch):
    """Samples of more and of fewer points than a block, in one search; a sample without points has no answer."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 20)
    monkeypatch.setattr(blocks, "SEARCHES", 7)
    own = {0: RNG.random((90, 2)), 1: RNG.random((20, 2)), 2: RNG.random((3, 2)), 3: RNG.random((41, 2))}
    points = reduce(DataFrame.union, (cloud(spark, p, b) for b, p in own.items()))
    queries = reduce(DataFrame.union, (cloud(spark, own.get(b, own[0])[:15] + 0.02, b, key="qid") for b in (0, 1, 2, 3, 9)))
    found = knn.knn_join(points, queries, 4, strategy="grid").orderBy("b", "qid", "rank").collect()
    want = []
    for b, p in own.items():
        asked = p[:15] + 0.02
        index, dist = dense(p, asked, min(4, len(p)))
        want += [(b, i, r + 1, int(index[i, r]), dist[i, r]) for i in range(len(asked)) for r in range(min(4, len(p)))]
    assert [(r.b, r.qid, r.rank, r.pid, r.dist_sq) for r in found] == want


def test_ragged_offsets(spark):
    xyz = RNG.random((30, 2))
    packed = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(xyz)], "row long, x double, y double")
    out = from_offsets(packed, [0, 8, 19, 30])
    assert [tuple(r) for r in out.groupBy("b").count().orderBy("b").collect()] == [(0, 8), (1, 11), (2, 11)]
    assert out.filter("b = 1 AND pid = 0").first()["x"] == xyz[8, 0]
    for bad in ([0], [1, 30], [0, 29], [0, 5, 5, 30]):
        with pytest.raises(ValueError):
            from_offsets(packed, bad)


def test_pack_and_fewer_points_than_k(spark):
    found = knn.knn_join(cloud(spark, CLOUDS["uniform"][:3]), cloud(spark, CLOUDS["uniform"][:2], key="qid"), 8, strategy="grid")
    packed = pack_neighbors(found).orderBy("qid").collect()
    assert [r.indices[0] for r in packed] == [0, 1] and len(packed[0].indices) == 3


def test_gather_checks_range(spark):
    found = spark.createDataFrame([(0, 0, 1, 99, 0.5)], "b int, qid long, rank int, pid long, dist_sq double")
    values = spark.createDataFrame([(0, 1, [1.0])], "b int, pid long, f array<double>")
    with pytest.raises(ValueError, match="local source indices"):
        knn.gather_values(found, values)


def test_inverse_distance(spark):
    near = [(0, 0, 0, 0.0, [2.0]), (0, 0, 1, 0.0, [4.0]), (0, 0, 2, 1.0, [100.0]), (0, 1, 0, 1.0, [2.0]), (0, 1, 1, 4.0, [4.0])]
    rows_ = spark.createDataFrame(near, "b int, qid long, pid long, dist_sq double, f array<double>")
    got = {r.qid: r.value for r in interpolate.inverse_distance(rows_, ("b", "qid")).collect()}
    assert got[0] == 3.0 and got[1] == pytest.approx((2 + 4 / 4) / 1.25)


def test_empty_tables(spark):
    none = cloud(spark, np.zeros((1, 2))).limit(0)
    assert knn.knn_join(none, none.withColumnRenamed("pid", "qid"), 4, strategy="brute").count() == 0
    assert knn.knn_join(none, none.withColumnRenamed("pid", "qid"), 4, strategy="grid").count() == 0
