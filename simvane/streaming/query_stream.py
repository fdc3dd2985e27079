"""A stream of queries answered batch by batch from a fixed vector table; no state is kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from simvane.functions.metrics import Metric
from simvane.operators.knn import knn


def search_stream(queries: DataFrame, vectors: DataFrame, k: int, sink: Callable[[DataFrame, int], None], metric: str | Metric = "l2") -> DataStreamWriter:
    """A writer, to be started, that gives ``sink`` each micro-batch's neighbours and its number.

    A batch may come again after a failure; a sink that overwrites by batch number makes results exact.
    """

    def answer(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            sink(knn(vectors, batch, k, metric), number)

    return queries.writeStream.foreachBatch(answer)
