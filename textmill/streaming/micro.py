"""Compression of a stream: contexts are independent, so every micro-batch is compressed by itself, without state or watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from textmill.config import Options
from textmill.plans.pipeline import compress


def compress_stream(contexts: DataFrame, options: Options, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Starts a query that writes ``results`` of each micro-batch to ``out`` as Parquet, a folder for each batch, so that a batch that runs again replaces itself."""
    options.check()

    def sink(batch: DataFrame, number: int) -> None:
        done = compress(batch, options)
        done.results.write.mode("overwrite").parquet(f"{out}/batch={number}")
        done.release()

    return contexts.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
