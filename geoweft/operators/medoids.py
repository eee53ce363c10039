"""Medoids of small groups of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import cols, squared_distance
from ..schema import axes


def select_medoids(members: DataFrame, points: DataFrame) -> DataFrame:
    """(b, grp, medoid, centroid_*) of ``members(b, grp, slot, pid)``.

    The medoid is the member nearest to the centroid, the first slot of equals; of two members it is the
    first.
    """
    names = axes(points)
    rows = members.join(points.select("b", "pid", *(F.col(a).cast("double").alias(a) for a in names)), ["b", "pid"])
    own = "OVER (PARTITION BY b, grp)"
    rows = rows.withColumns({f"centroid_{a}": F.expr(f"avg({a}) {own}") for a in names} | {"n": F.expr(f"count(1) {own}")})
    away = F.when(F.col("n") == 2, F.lit(0.0)).otherwise(squared_distance(cols(names), cols(names, "centroid_")))
    best = rows.groupBy("b", "grp").agg(F.min_by("pid", F.struct(away.alias("d"), F.col("slot"))).alias("medoid"), *(F.first(f"centroid_{a}").alias(f"centroid_{a}") for a in names))
    return best
