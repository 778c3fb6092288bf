"""Resumable runs over a stream of new quantiles or forecasts: each micro-batch is merged idempotently."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.panel import QuantileTable


def stream_quantiles(stream: DataFrame, store: QuantileTable, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream of quantile rows to the store: an origin stored before keeps its rows, so replays change nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        store.append(batch)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
