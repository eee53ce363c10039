"""Moving-least-squares interpolation: a weighted local-linear fit around each query.

The weights fall off with the lower median of the k distances.  Per query and channel one aggregate
gives the normal matrix and the right-hand side; the Cholesky factor, with its pivot floors and its
second attempt on a jittered diagonal, and the substitutions are unrolled columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BANDWIDTH_MIN, REGULARIZATION, axes
from ..schema import EXACT_DISTANCE_EPSILON as EPS
from .knn import neighborhoods

# Fixed values of the factorisation.
PIVOT_LEAST, PIVOT_MOST, PIVOT_SHARE = 1e-12, 1e-5, 1e-3
JITTER_LEAST, JITTER_SHARE = 1e-5, 1e-4
DIVISOR_LEAST = 1e-20


def weighted(points: DataFrame, queries: DataFrame, k: int, keys: Sequence[str], strategy: str = "auto") -> DataFrame:
    """Neighbour rows with offsets d* (query minus neighbour), bandwidth h, weight w and the count of exact hits."""
    names = axes(points)
    rows = neighborhoods(points, queries, k, keys=keys, strategy=strategy)
    own = f"OVER (PARTITION BY {', '.join(keys)})"
    rows = rows.withColumns({f"d{a}": F.col(a) - F.col(f"n{a}") for a in names})
    middle = (k - 1) // 2 + 1
    rows = rows.withColumn("median_sq", F.expr(f"max(CASE WHEN rank = {middle} THEN dist_sq END) {own}"))
    rows = rows.withColumn("hits", F.expr(f"sum(CASE WHEN dist_sq <= {EPS} THEN 1 ELSE 0 END) {own}"))
    rows = rows.withColumn("h", F.greatest(F.col("median_sq"), F.lit(BANDWIDTH_MIN)))
    return rows.withColumn("w", F.exp(-F.col("dist_sq") / (2.0 * F.col("h"))))


def with_features(rows: DataFrame, features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Neighbour rows by channel: c and v, from the matching head where there are heads."""
    on = ["b", "pid", *(["h_"] if "h_" in keys else [])]
    table = features.withColumnRenamed("h", "h_") if "h_" in keys else features
    return rows.join(table.select(*on, "f"), on).select(*rows.columns, F.posexplode("f").alias("c", "v"))


def _basis(names: Sequence[str]) -> list[Column]:
    return [F.lit(1.0), *(F.col(f"d{a}") for a in names)]


def fit(rows: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, c, hits, hit_mean, l_ij, s_i): factor and solution of each query and channel."""
    phi, size = _basis(names), len(names) + 1
    w, v = F.col("w"), F.col("v")
    sums = [F.sum(w * phi[i] * phi[j]).alias(f"a_{i}{j}") for i in range(size) for j in range(i + 1)]
    sums += [F.sum(w * phi[i] * v).alias(f"r_{i}") for i in range(size)]
    out = rows.groupBy(*keys, "c").agg(F.first("hits").alias("hits"), F.avg(F.when(F.col("dist_sq") <= EPS, v)).alias("hit_mean"), *sums)
    out = out.withColumns({f"a_{i}{i}": F.col(f"a_{i}{i}") + REGULARIZATION for i in range(size)})
    return solve(factor(out, size), size, "r_", "s_")


def factor(df: DataFrame, size: int) -> DataFrame:
    """Columns l_ij of the Cholesky factor of a_ij; the second attempt replaces a first with a bad pivot."""
    trace = sum((F.col(f"a_{i}{i}") for i in range(1, size)), F.col("a_00"))
    df = df.withColumn("jitter", F.greatest(F.lit(JITTER_LEAST), JITTER_SHARE * trace / size))
    for t in range(2):
        bad = F.lit(False)
        for i in range(size):
            for j in range(i + 1):
                value = F.col(f"a_{i}{j}")
                if i == j and t:
                    value = value + F.col("jitter")
                for m in range(j):
                    value = value - F.col(f"l{t}_{i}{m}") * F.col(f"l{t}_{j}{m}")
                if i == j:
                    diagonal = F.col(f"a_{i}{i}") + (F.col("jitter") if t else 0.0)
                    floor = F.greatest(F.lit(PIVOT_LEAST), F.least(F.lit(PIVOT_MOST), PIVOT_SHARE * F.abs(diagonal)))
                    df = df.withColumn(f"p{t}_{i}", value).withColumn(f"f{t}_{i}", floor)
                    low = F.col(f"p{t}_{i}") <= F.col(f"f{t}_{i}")
                    bad = bad | low
                    df = df.withColumn(f"l{t}_{i}{i}", F.sqrt(F.when(low, F.col(f"f{t}_{i}")).otherwise(F.col(f"p{t}_{i}"))))
                else:
                    df = df.withColumn(f"l{t}_{i}{j}", value / F.col(f"l{t}_{j}{j}"))
        df = df.withColumn(f"bad{t}", bad)
    pairs = [(i, j) for i in range(size) for j in range(i + 1)]
    df = df.withColumns({f"l_{i}{j}": F.when(F.col("bad0"), F.col(f"l1_{i}{j}")).otherwise(F.col(f"l0_{i}{j}")) for i, j in pairs})
    spare = [f"{x}{t}_{i}" for t in range(2) for x in "pf" for i in range(size)] + [f"l{t}_{i}{j}" for t in range(2) for i, j in pairs]
    return df.drop(*spare, "jitter", "bad0", "bad1")


def solve(df: DataFrame, size: int, right: str, left: str) -> DataFrame:
    """Columns ``left``i with L L' x = ``right``."""
    pivot = lambda i: F.greatest(F.col(f"l_{i}{i}"), F.lit(DIVISOR_LEAST))
    for i in range(size):
        value = F.col(f"{right}{i}")
        for j in range(i):
            value = value - F.col(f"l_{i}{j}") * F.col(f"_y{j}")
        df = df.withColumn(f"_y{i}", value / pivot(i))
    for i in reversed(range(size)):
        value = F.col(f"_y{i}")
        for j in range(i + 1, size):
            value = value - F.col(f"l_{j}{i}") * F.col(f"{left}{j}")
        df = df.withColumn(f"{left}{i}", value / pivot(i))
    return df.drop(*(f"_y{i}" for i in range(size)))


def split_heads(df: DataFrame) -> DataFrame:
    """Inside, the head is ``h_``, since h is the bandwidth."""
    return df.withColumnRenamed("h", "h_") if "h" in df.columns else df


def mls(points: DataFrame, queries: DataFrame, features: DataFrame, k: int = 8, *, slopes: bool = False, strategy: str = "auto") -> DataFrame:
    """(b, qid[, h], c, value[, slope_*]) at the queries; slopes are along query minus neighbour."""
    names = axes(points)
    asked = split_heads(queries)
    keys = ["b", "qid", *(["h_"] if "h_" in asked.columns else [])]
    fitted = fit(with_features(weighted(points, asked, k, keys, strategy), features, keys), names, keys)
    exact = F.col("hits") > 0
    out = [F.when(exact, F.col("hit_mean")).otherwise(F.col("s_0")).alias("value")]
    if slopes:
        out += [F.when(exact, F.lit(0.0)).otherwise(F.col(f"s_{i + 1}")).alias(f"slope_{a}") for i, a in enumerate(names)]
    return fitted.select(*(F.col(x).alias(x.rstrip("_")) for x in keys), "c", *out)
