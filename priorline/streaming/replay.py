"""Scoring of arriving incident requests, one micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def score_stream(
    requests: DataFrame, score: Callable[[DataFrame], DataFrame], output: str, checkpoint: str,
    once: bool = True,
) -> StreamingQuery:
    """Apply a batch scoring function to each micro-batch and write it as Parquet.

    Every batch goes to its own ``batch=<id>`` directory in overwrite mode, so a batch that is
    replayed after a failure replaces its earlier output. ``checkpoint`` must be shared storage.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    writer = requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
