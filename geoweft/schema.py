"""Canonical tables, their validation, and adapters.

A cloud is ``points(b, pid, x, y[, z])``; ``b`` is the sample, so single, fixed-size and ragged batches
are one code path.  Queries are ``queries(b, qid[, h], x, y[, z])``, features ``features(b, pid[, h], f)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the contracts.
SUPPORTED_K = (4, 8, 16)
SUPPORTED_DIMS = (2, 3)
EXACT_DISTANCE_EPSILON = 1e-12
BANDWIDTH_MIN = 1e-12
REGULARIZATION = 1e-6

AXES = ("x", "y", "z")


def axes(df: DataFrame) -> tuple[str, ...]:
    """The coordinate columns of a table: x, y and, in 3-D, z."""
    if "x" not in df.columns or "y" not in df.columns:
        raise ValueError("D must be 2 or 3")
    return AXES[: 2 + ("z" in df.columns)]


def require(df: DataFrame, columns: Sequence[str], op: str, name: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{op}: {name} must have columns {', '.join(missing)}")


def require_k(op: str, k: int) -> None:
    if k not in SUPPORTED_K:
        raise ValueError(f"{op}: k must be 4, 8, or 16")


def require_same_axes(op: str, a: DataFrame, b: DataFrame, name: str) -> tuple[str, ...]:
    if axes(a) != axes(b):
        raise ValueError(f"{op}: {name} dimension must match points")
    return axes(a)


def as_double(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def check_offsets(op: str, offsets: Sequence[int], total: int) -> list[int]:
    values = [int(v) for v in offsets]
    if len(values) < 2:
        raise ValueError(f"{op}: offsets must contain at least two entries")
    if values[0] != 0:
        raise ValueError(f"{op}: offsets must start at 0")
    if values[-1] != total:
        raise ValueError(f"{op}: final offset must match the packed tensor length")
    if any(b <= a for a, b in zip(values, values[1:], strict=False)):
        raise ValueError(f"{op}: offsets must be strictly increasing")
    return values


def from_offsets(packed: DataFrame, offsets: Sequence[int], row: str = "row", local: str = "pid", total: int | None = None) -> DataFrame:
    """A packed ragged table (numbered by ``row``) as a batch: ``b`` and the local number replace ``row``."""
    values = check_offsets("from_offsets", offsets, packed.count() if total is None else total)
    ranges = packed.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(values, values[1:], strict=False))], "b int, _from long, _to long")
    joined = packed.join(ranges, (F.col(row) >= F.col("_from")) & (F.col(row) < F.col("_to")))
    return joined.withColumn(local, F.col(row) - F.col("_from")).drop("_from", "_to", *([row] if row != local else []))


def single(df: DataFrame) -> DataFrame:
    """A cloud without samples as sample 0."""
    return df if "b" in df.columns else df.withColumn("b", F.lit(0))


def point(df: DataFrame, prefix: str = "") -> dict[str, Column]:
    return {a: F.col(prefix + a) for a in axes(df)}


def pack_neighbors(neighbors: DataFrame, keys: Sequence[str] = ("b", "qid")) -> DataFrame:
    """Long k-NN rows as one row a query with arrays ``indices`` and ``distances`` in rank order."""
    rows = neighbors.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "pid", "dist_sq"))).alias("n"))
    return rows.select(*keys, F.col("n.pid").alias("indices"), F.col("n.dist_sq").alias("distances"))
