import numpy as np
import pytest

from geoweft.operators import conditional, gradients, mls

from .oracles import cloud
from .oracles import mls as dense

RNG = np.random.default_rng(3)


def features(spark, f, b=0):
    return spark.createDataFrame([(b, i, [float(v) for v in np.atleast_1d(r)]) for i, r in enumerate(f)], "b int, pid long, f array<double>")


LINE = np.linspace(0, 1, 24)
CASES = {
    "random 2-D": (RNG.random((40, 2)), RNG.random((12, 2))),
    "random 3-D": (RNG.random((50, 3)), RNG.random((12, 3))),
    "diagonal line": (np.stack([LINE, LINE], axis=1), np.stack([LINE[2:9] + 0.01, LINE[2:9] + 0.013], axis=1)),
    "diagonal line 3-D": (np.stack([LINE] * 3, axis=1), np.stack([LINE[2:9] + 0.01] * 3, axis=1)),
    "axis line, query beside": (np.stack([LINE, 0 * LINE], axis=1), np.stack([LINE[2:9] + 0.01, 0 * LINE[2:9] + 0.02], axis=1)),
    "axis line, query on it": (np.stack([LINE, 0 * LINE], axis=1), np.stack([LINE[2:9] + 0.01, 0 * LINE[2:9]], axis=1)),
    "exact hits": (np.repeat(RNG.random((8, 2)), 3, axis=0), None),
}


@pytest.mark.parametrize("name", CASES)
def test_matches_float64(spark, name):
    points, queries = CASES[name]
    queries = points[::3] if queries is None else queries
    f = np.sin(3 * points[:, 0]) + points[:, -1] ** 2
    names = "xyz"[: points.shape[1]]
    got = mls.mls(cloud(spark, points), cloud(spark, queries, key="qid"), features(spark, f), 8, slopes=True).orderBy("qid").collect()
    want = dense(points, queries, f, 8)
    np.testing.assert_allclose([[r.value, *(r[f"slope_{a}"] for a in names)] for r in got], want, rtol=1e-7, atol=1e-9)


def test_conditional_ignores_the_other_branch(spark):
    t, f = RNG.random((19, 2)), RNG.random((23, 2))
    route = RNG.random(9) < 0.55
    queries = RNG.random((9, 2))
    nan = float("nan")
    rows = [(0, i, 0, bool(r), *((*map(float, q), nan, nan) if r else (nan, nan, *map(float, q)))) for i, (r, q) in enumerate(zip(route, queries, strict=True))]
    routed = spark.createDataFrame(rows, "b int, qid long, h int, route boolean, tx double, ty double, fx double, fy double")
    heads = lambda v: features(spark, v).selectExpr("b", "pid", "0 AS h", "f")
    got = conditional.conditional_mls(routed, cloud(spark, t), heads(t[:, 0]), cloud(spark, f), heads(f[:, 1]), 4).orderBy("qid").collect()
    want = np.where(route, dense(t, queries, t[:, 0], 4)[:, 0], dense(f, queries, f[:, 1], 4)[:, 0])
    np.testing.assert_allclose([r.value for r in got], want, rtol=1e-8)


def test_vjp_is_the_derivative(spark):
    points, queries = RNG.random((20, 2)), RNG.random((4, 2))
    f = np.cos(4 * points[:, 0]) * points[:, 1]
    g = np.array([1.3, -0.4, 0.7])
    up = spark.createDataFrame([(0, i, 0, *map(float, g)) for i in range(4)], "b int, qid long, c int, g0 double, g_x double, g_y double")
    to_q, to_f = gradients.mls_vjp(cloud(spark, points), cloud(spark, queries, key="qid"), features(spark, f), up, 8)
    loss = lambda q, v: (dense(points, q, v, 8) * g).sum()
    eps = 1e-6
    got = np.array([[r.g_x, r.g_y] for r in to_q.orderBy("qid").collect()])
    for i in range(4):
        for a in range(2):
            d = np.zeros_like(queries)
            d[i, a] = eps
            assert got[i, a] == pytest.approx((loss(queries + d, f) - loss(queries - d, f)) / (2 * eps), rel=1e-4, abs=1e-6)
    by = {r.pid: r.grad for r in to_f.collect()}
    for i in range(20):
        d = np.zeros(20)
        d[i] = eps
        assert by.get(i, 0.0) == pytest.approx((loss(queries, f + d) - loss(queries, f - d)) / (2 * eps), rel=1e-5, abs=1e-7)


def test_exact_hits_share_the_gradient(spark):
    points = np.array([[0.0, 0], [0, 0], [1, 0], [0, 1], [1, 1], [2, 2], [3, 1], [1, 3]])
    up = spark.createDataFrame([(0, 0, 0, 2.0)], "b int, qid long, c int, g0 double")
    to_q, to_f = gradients.mls_vjp(cloud(spark, points), cloud(spark, points[:1], key="qid"), features(spark, points[:, 0]), up, 4)
    assert to_q.first()["g_x"] == 0.0
    assert {r.pid: r.grad for r in to_f.collect() if r.grad} == {0: 1.0, 1: 1.0}
