"""Helpers on the caller's columns and on intermediate tables, which go under the session's shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialize, shared_dir

#: Bytes of an Arrow batch.  Spark's own bound is 64 MB, which two workers of an executor hold several times over.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

__all__ = ["discard", "input_bytes", "materialize", "narrow", "placed", "shared_dir", "text_or_empty"]


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df`` in bytes, 0 where it has none; runs no job."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else 0


def placed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns renamed by place, and the new name of each (of equal names the first).

    Columns that an operator adds can then not clash with the caller's, whatever their names or case.  All
    operators begin here, so this is also where the session's Arrow batches are bounded, unless it has set a
    bound of its own.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH) == "67108864b":
        conf.set(_BATCH, str(BATCH_BYTES))
    found: dict[str, str] = {}
    for i, name in enumerate(df.columns):
        found.setdefault(name, f"_c{i}")
    return df.toDF(*(f"_c{i}" for i in range(len(df.columns)))), found


def narrow(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns of ``df``, matched by exact name."""
    inner, at = placed(df)
    return inner.select(*(F.col(at[n]).alias(n) for n in names))


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))
