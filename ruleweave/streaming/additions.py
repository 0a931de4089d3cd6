"""Models of streams that only grow: each micro-batch is an update with new source rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..reasoner import Reasoner


def maintained(stream: DataFrame, reasoner: Reasoner, pred: str, after: Callable[[Reasoner, int], None] | None = None) -> DataStreamWriter:
    """A writer that adds each micro-batch of `stream` to the source `pred` and updates the model.

    A batch that comes again after a failure adds facts that are there already, which
    changes nothing.
    """

    def step(batch: DataFrame, number: int) -> None:
        if reasoner.model is None:
            reasoner.materialize()
        if not batch.isEmpty():
            reasoner.update(added={pred: batch})
        if after:
            after(reasoner, number)

    return stream.writeStream.foreachBatch(step)
