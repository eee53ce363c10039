"""Routed interpolation: each (b, qid, h) is answered from exactly one of two clouds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import axes
from .mls import mls


def active_queries(routed: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The query of the route; what the other branch holds (it may be NaN) is never read."""
    chosen = {a: F.when(F.col("route"), F.col(f"t{a}")).otherwise(F.col(f"f{a}")) for a in names}
    return routed.select("b", "qid", "h", "route", *(c.alias(a) for a, c in chosen.items()))


def _tagged(df: DataFrame, route) -> DataFrame:
    """Sample and route as one key, so that a route's rows meet that route's rows only."""
    return df.withColumn("b", F.col("b") * 2 + route.cast("int"))


def conditional_mls(
    routed: DataFrame, true_points: DataFrame, true_features: DataFrame, false_points: DataFrame, false_features: DataFrame,
    k: int = 4, *, slopes: bool = False, strategy: str = "auto",
) -> DataFrame:
    """(b, qid, h, c, value[, slope_*]) of ``routed(b, qid, h, route, t*, f*)``."""
    names = axes(true_points)
    both = lambda t, f: _tagged(t, F.lit(True)).unionByName(_tagged(f, F.lit(False)))
    queries = _tagged(active_queries(routed, names), F.col("route")).drop("route")
    out = mls(both(true_points, false_points), queries, both(true_features, false_features), k, slopes=slopes, strategy=strategy)
    return out.withColumn("b", F.expr("b div 2").cast("int"))
