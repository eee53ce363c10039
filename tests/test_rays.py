import math

import numpy as np
import pytest

from geoweft.operators import gradients, ray
from geoweft.operators.index import vertex_names

RNG = np.random.default_rng(9)


def table(spark, rows, names, key):
    return spark.createDataFrame([(0, i, *map(float, r)) for i, r in enumerate(rows)], f"b int, {key} long, " + ", ".join(f"{n} double" for n in names))


def prims(spark, rows, kind):
    return table(spark, rows, sum(vertex_names(kind), []), "prim_id")


def rays(spark, rows, dims):
    return table(spark, rows, [s + a for s in "od" for a in "xyz"[:dims]], "ray_id")


def first_hit(o, d, p, kind):
    if kind == "segment":
        e, a = p[2:] - p[:2], p[:2] - o
        den = d[0] * e[1] - d[1] * e[0]
        if abs(den) < 1e-12:
            return None
        t, u = (a[0] * e[1] - a[1] * e[0]) / den, (a[0] * d[1] - a[1] * d[0]) / den
        return t if t >= 1e-7 and 0 <= u <= 1 else None
    v = p.reshape(3, 3)
    m = np.stack([-d, v[1] - v[0], v[2] - v[0]], axis=1)
    if abs(np.linalg.det(m)) < 1e-12:
        return None
    t, u, w = np.linalg.solve(m, o - v[0])
    return t if t >= 1e-7 and u >= 0 and w >= 0 and u + w <= 1 else None


@pytest.mark.parametrize(("kind", "dims"), [("segment", 2), ("triangle", 3)])
def test_random(spark, kind, dims):
    p = RNG.normal(size=(37, 2 * dims if kind == "segment" else 9))
    r = RNG.normal(size=(35, 2 * dims))
    got = ray.raytrace(rays(spark, r, dims), prims(spark, p, kind), kind).orderBy("ray_id").collect()
    for row, x in zip(got, r, strict=True):
        ts = [(t, i) for i, q in enumerate(p) if (t := first_hit(x[:dims], x[dims:], q, kind)) is not None]
        assert row.hit == bool(ts)
        if ts:
            assert row.prim_id == min(ts)[1] and row.t == pytest.approx(min(ts)[0], rel=1e-9)
            np.testing.assert_allclose([row[f"p{a}"] for a in "xyz"[:dims]], x[:dims] + row.t * x[dims:], rtol=1e-9, atol=1e-12)
        else:
            assert row.prim_id == -1 and math.isinf(row.t) and math.isnan(row.px)


def test_ties_ranges_and_degenerates(spark):
    walls = [[1, -1, 1, 1], [1, -1, 1, 1], [3, -1, 3, 1], [5, 5, 5, 5], [0, 0, 9, 0]]
    p = prims(spark, walls, "segment")
    r = rays(spark, [[0, 0.5, 1, 0], [2, 0.5, 1, 0], [0, 0.5, 0, 0], [0, 0, 1, 0], [2, 0.5, -1, 0]], 2)
    got = {x.ray_id: (x.prim_id, x.hit) for x in ray.raytrace(r, p, "segment").collect()}
    assert got == {0: (0, True), 1: (2, True), 2: (-1, False), 3: (0, True), 4: (0, True)}
    assert ray.raytrace(r, p, "segment", t_max=0.5).filter("hit").count() == 0
    for bad in ({"t_min": -1.0}, {"t_min": 1.0, "t_max": 1.0}, {"t_max": math.nan}, {"t_min": math.inf}):
        with pytest.raises(ValueError, match="finite 0 <= t_min < t_max"):
            ray.raytrace(r, p, "segment", **bad)


def test_triangles_are_double_sided(spark):
    p = prims(spark, [[-1, -1, 2, 1, -1, 2, 0, 1, 2]], "triangle")
    r = rays(spark, [[0, 0, 0, 0, 0, 2], [0, 0, 4, 0, 0, -1], [9, 9, 0, 0, 0, 1]], 3)
    assert [x.t for x in ray.raytrace(r, p, "triangle").orderBy("ray_id").collect()][:2] == [1.0, 2.0]
    assert ray.raytrace(r, p, "triangle", t_max=0.75).filter("hit").count() == 0


@pytest.mark.parametrize(("kind", "dims"), [("segment", 2), ("triangle", 3)])
def test_vjp_is_the_derivative(spark, kind, dims):
    p = np.array([[1.0, -2, 1.2, 2]]) if kind == "segment" else np.array([[-1, -1, 2, 2, -1, 2.5, 0, 2, 2.2]])
    x = np.array([[0.1, 0.2, 1.0, 0.15]]) if kind == "segment" else np.array([[0.1, 0.1, 0, 0.05, 0.02, 1.0]])
    gt, gp = 0.7, np.array([0.3, -0.2, 0.5])[:dims]
    r, q = rays(spark, x, dims), prims(spark, p, kind)
    up = r.selectExpr("b", "ray_id", f"{gt}D AS gt", *(f"{v}D AS gp{a}" for v, a in zip(gp, "xyz", strict=False)))
    to_r, to_p = gradients.ray_vjp(r, q, ray.raytrace(r, q, kind), up, kind)

    def loss(x, p):
        t = first_hit(x[0, :dims], x[0, dims:], p[0], kind)
        return gt * t + gp @ (x[0, :dims] + t * x[0, dims:])

    names = [f"g_{s}{a}" for s in "od" for a in "xyz"[:dims]], [f"g_{n}" for v in vertex_names(kind) for n in v]
    for (base, other, flip), df, cols in zip([(x, p, False), (p, x, True)], (to_r, to_p), names, strict=True):
        row = df.first()
        for i, name in enumerate(cols):
            d = np.zeros_like(base)
            d[0, i] = 1e-6
            f = (lambda v: loss(other, v)) if flip else (lambda v: loss(v, other))
            assert row[name] == pytest.approx((f(base + d) - f(base - d)) / 2e-6, rel=1e-5, abs=1e-7)


def test_misses_have_no_gradient(spark):
    r, q = rays(spark, [[0, 0, 0, 1]], 2), prims(spark, [[1, -1, 1, 1]], "segment")
    up = r.selectExpr("b", "ray_id", "1D AS gt", "1D AS gpx", "1D AS gpy")
    to_r, to_p = gradients.ray_vjp(r, q, ray.raytrace(r, q, "segment"), up, "segment")
    assert tuple(to_r.first())[2:] == (0.0, 0.0, 0.0, 0.0) and to_p.count() == 0
