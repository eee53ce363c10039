"""Inverse-distance interpolation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import EXACT_DISTANCE_EPSILON as EPS


def inverse_distance(gathered: DataFrame, keys: Sequence[str] = ("b", "qid", "h")) -> DataFrame:
    """(keys, c, value) of neighbour rows with ``dist_sq`` and ``f``.

    Weights are 1 / (d2 + eps), normalised; if a query has exact hits, it is their plain mean.
    """
    exact, weight = F.col("dist_sq") <= EPS, 1.0 / (F.col("dist_sq") + EPS)
    rows = gathered.select(*keys, "dist_sq", F.posexplode("f").alias("c", "v"))
    sums = rows.groupBy(*keys, "c").agg(
        F.avg(F.when(exact, F.col("v"))).alias("hit"), F.sum(weight * F.col("v")).alias("top"), F.sum(weight).alias("bottom")
    )
    return sums.select(*keys, "c", F.coalesce("hit", F.col("top") / F.greatest("bottom", F.lit(EPS))).alias("value"))
