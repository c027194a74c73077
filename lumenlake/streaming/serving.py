"""Query streams against a fixed gallery (an extension: each micro-batch runs the batch search unchanged)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.search import search


def serve(queries: DataFrame, gallery: DataFrame, path: str, checkpoint: str, k: int = 5, once: bool = False) -> StreamingQuery:
    """queries: a stream of query_id, embedding. Each micro-batch's answers go to path/batch=N, so a batch that is
    run again after a failure replaces its own answers."""

    def answer(batch: DataFrame, number: int) -> None:
        search(batch, gallery, k).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
