"""First-order vector-Jacobian products of gathers, interpolation and rays, as explicit operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import cols, cross3, dot, scale, sub
from ..schema import BANDWIDTH_MIN, axes
from ..schema import EXACT_DISTANCE_EPSILON as EPS
from .index import vertex_names
from .mls import fit, solve, split_heads, weighted, with_features


def gather_vjp(neighbors: DataFrame, upstream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Gradient of gathered values: ``upstream(keys, rank, c, g)`` summed by (b, pid[, h], c)."""
    on = ["b", "pid", *(["h"] if "h" in keys else [])]
    return neighbors.join(upstream, [*keys, "rank"]).groupBy(*on, "c").agg(F.sum("g").alias("grad"))


def mls_vjp(points: DataFrame, queries: DataFrame, features: DataFrame, upstream: DataFrame, k: int = 8, *, strategy: str = "auto") -> tuple[DataFrame, DataFrame]:
    """Gradients of ``mls`` to queries (keys, g_*) and to features (b, pid[, h], c, grad).

    ``upstream(keys, c, g0[, g_x, ..])`` is the gradient of the value and of the slopes.  Source points
    get no gradient; a query with exact hits gets none, and its hits share the value's.
    """
    names = axes(points)
    size = len(names) + 1
    asked = split_heads(queries)
    keys = ["b", "qid", *(["h_"] if "h_" in asked.columns else [])]
    rows = with_features(weighted(points, asked, k, keys, strategy), features, keys)
    given = split_heads(upstream)
    slopes = [F.coalesce(F.col(f"g_{a}"), F.lit(0.0)) if f"g_{a}" in given.columns else F.lit(0.0) for a in names]
    given = given.select(*keys, "c", F.col("g0").alias("u_0"), *(g.alias(f"u_{i + 1}") for i, g in enumerate(slopes)))
    solved = solve(fit(rows, names, keys).join(given, [*keys, "c"]), size, "u_", "G_")
    solved = solved.select(*keys, "c", "u_0", *(f"s_{i}" for i in range(size)), *(f"G_{i}" for i in range(size)))
    rows = rows.join(solved, [*keys, "c"])
    phi = [F.lit(1.0), *cols(names, "d")]
    w, h, s, exact = F.col("w"), F.col("h"), F.col("dist_sq"), F.col("hits") > 0
    rows = rows.withColumn("_a", dot(phi, [F.col(f"G_{i}") for i in range(size)])).withColumn("_e", F.col("v") - dot(phi, [F.col(f"s_{i}") for i in range(size)]))
    a, e = F.col("_a"), F.col("_e")
    feature = F.when(exact, F.when(s <= EPS, F.col("u_0") / F.col("hits")).otherwise(F.lit(0.0))).otherwise(w * a)
    on = ["b", "pid", *(["h_"] if "h_" in keys else [])]
    to_features = rows.groupBy(*on, "c").agg(F.sum(feature).alias("grad"))
    middle = (k - 1) // 2 + 1
    direct = {n: F.sum(w * (e * F.col(f"G_{i + 1}") - a * F.col(f"s_{i + 1}")) - a * e * w * F.col(f"d{n}") / h).alias(f"_q{n}") for i, n in enumerate(names)}
    through = F.sum(a * e * w * s / (h * h)).alias("_h")
    median = {n: F.max(F.when(F.col("rank") == middle, F.col(f"d{n}"))).alias(f"_m{n}") for n in names}
    sums = rows.groupBy(*keys).agg(*direct.values(), through, *median.values(), F.max("hits").alias("hits"), F.max("median_sq").alias("m2"))
    moves = F.when(F.col("m2") > BANDWIDTH_MIN, F.col("_h")).otherwise(F.lit(0.0))
    to_queries = sums.select(
        *(F.col(x).alias(x.rstrip("_")) for x in keys),
        *(F.when(exact, F.lit(0.0)).otherwise(F.col(f"_q{n}") + moves * F.col(f"_m{n}")).alias(f"g_{n}") for n in names),
    )
    return to_queries, to_features.withColumnRenamed("h_", "h")


def ray_vjp(rays: DataFrame, primitives: DataFrame, hits: DataFrame, upstream: DataFrame, kind: str, keys: Sequence[str] = ("b", "ray_id")) -> tuple[DataFrame, DataFrame]:
    """Gradients of ``raytrace``: to rays (keys, g_o*, g_d*) and to primitives (b, prim_id, g_ and the vertex column).

    ``upstream(keys, gt, gp*)`` is the gradient of t and of the hit point; misses give zeros.
    """
    vertices = vertex_names(kind)
    names = "xyz"[: len(vertices[0])]
    rows = rays.join(hits.select(*keys, "prim_id", "t", "hit"), list(keys)).join(upstream, list(keys))
    rows = rows.join(primitives.select("b", "prim_id", *sum(vertices, [])), ["b", "prim_id"], "left")
    o, d, gp = (cols([p + a for a in names]) for p in ("o", "d", "gp"))
    v, t = [cols(x) for x in vertices], F.col("t")
    total = F.col("gt") + dot(gp, d)
    if kind == "segment":
        edge, a = sub(v[1], v[0]), sub(v[0], o)
        den = d[0] * edge[1] - d[1] * edge[0]
        n, c = total / den, -total * t / den
        ga = [n * edge[1], -n * edge[0]]
        ge = [-n * a[1] - c * d[1], n * a[0] + c * d[0]]
        gv, go = [sub(ga, ge), ge], sub(gp, ga)
        gd = [t * gp[0] + c * edge[1], t * gp[1] - c * edge[0]]
    else:
        e1, e2 = sub(v[1], v[0]), sub(v[2], v[0])
        normal = cross3(e1, e2)
        k = total / dot(normal, d)
        gn = scale(sub(sub(v[0], o), scale(d, t)), k)
        g1, g2, kn = cross3(e2, gn), cross3(gn, e1), scale(normal, k)
        gv, go = [sub(sub(kn, g1), g2), g1, g2], sub(gp, kn)
        gd = scale(go, t)
    zero = lambda x: F.when(F.col("hit"), x).otherwise(F.lit(0.0))
    flat = {f"g_{name}": g for own, grads in zip(vertices, gv, strict=True) for name, g in zip(own, grads, strict=True)}
    to_rays = rows.select(*keys, *(zero(x).alias(f"g_o{a}") for a, x in zip(names, go, strict=True)), *(zero(x).alias(f"g_d{a}") for a, x in zip(names, gd, strict=True)))
    to_primitives = rows.filter("hit").select("b", "prim_id", *(x.alias(n) for n, x in flat.items())).groupBy("b", "prim_id").agg(*(F.sum(n).alias(n) for n in flat))
    return to_rays, to_primitives
