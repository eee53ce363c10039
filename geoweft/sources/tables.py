"""Clouds, features, primitives and rays derived from ordinary tables of numeric columns and vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import AXES


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vector_columns(df: DataFrame, keys: dict[str, str], vector: str, columns: Sequence[str], first: int) -> DataFrame:
    """``keys`` (new name to SQL) and consecutive vector elements, cast to double, as columns."""
    return df.select(*(F.expr(v).alias(k) for k, v in keys.items()), *(F.col(vector)[first + i].cast("double").alias(c) for i, c in enumerate(columns)))


def points(spark: SparkSession, folder: str, dims: int = 3, first: int = 0, b: str = "label", key: str = "pid") -> DataFrame:
    """Vectors as points: a sample for each label (ragged), or one for all with ``b`` "0"."""
    return vector_columns(read(spark, folder, "embeddings"), {"b": f"cast({b} AS int)", key: "cast(vec_id AS bigint)"}, "embedding", AXES[:dims], first)


def features(spark: SparkSession, folder: str, first: int = 8, channels: int = 4, b: str = "label") -> DataFrame:
    df = read(spark, folder, "embeddings")
    return df.select(F.expr(f"cast({b} AS int)").alias("b"), F.col("vec_id").cast("long").alias("pid"), F.transform(F.slice("embedding", first + 1, channels), lambda x: x.cast("double")).alias("f"))


def with_heads(df: DataFrame, heads: int = 3, shift: float = 0.01) -> DataFrame:
    """Each row once a head; coordinates move by ``shift`` a head, features are scaled by 1 + head."""
    out = df.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(heads - 1))))
    out = out.withColumns({a: F.col(a) + F.lit(shift) * F.col("h") for a in AXES if a in df.columns})
    return out.withColumn("f", F.expr("transform(f, v -> v * (1 + h))")) if "f" in df.columns else out


def primitives(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Segments or triangles from the first elements of the vectors, one sample."""
    names = ["x0", "y0", "x1", "y1"] if kind == "segment" else [f"{a}{v}" for v in range(3) for a in "xyz"]
    return vector_columns(read(spark, folder, "embeddings"), {"b": "0", "prim_id": "cast(vec_id AS bigint)"}, "embedding", names, 0)


def rays(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    names, first = (["ox", "oy", "dx", "dy"], 4) if kind == "segment" else (["ox", "oy", "oz", "dx", "dy", "dz"], 9)
    return vector_columns(read(spark, folder, "embeddings"), {"b": "0", "ray_id": "cast(vec_id AS bigint)"}, "embedding", names, first)


def event_points(spark: SparkSession, folder: str) -> DataFrame:
    """(time in seconds, value) of events as 2-D points, a sample for each type."""
    df = read(spark, folder, "events")
    return df.select(F.col("event_type").alias("b"), F.col("event_id").cast("long").alias("pid"), F.unix_timestamp("ts").cast("double").alias("x"), F.col("value").cast("double").alias("y"))


def part_points(spark: SparkSession, folder: str) -> DataFrame:
    """(size, size mod 5) of parts: at most fifty distinct points, so full of ties."""
    return read(spark, folder, "part").select(
        F.lit(0).alias("b"), F.col("p_partkey").cast("long").alias("pid"), F.col("p_size").cast("double").alias("x"), (F.col("p_size") % 5).cast("double").alias("y")
    )
