"""Stream-static neighbours: queries of a stream against a fixed cloud.

An extension: ranks need all of a query's candidates, so each micro-batch is joined as a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.knn import knn_join


def knn_stream(points: DataFrame, queries: DataFrame, k: int, sink: Callable[[DataFrame, int], None], *, strategy: str = "auto") -> DataStreamWriter:
    """A writer that gives each micro-batch's neighbours to ``sink(neighbors, batch_id)``."""

    def each(batch: DataFrame, batch_id: int) -> None:
        sink(knn_join(points, batch, k, strategy=strategy), batch_id)

    return queries.writeStream.foreachBatch(each)
