"""The one stream there is: log entries and progress rows as they are appended, for a live view."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from weftline.model import LOG_ENTRY
from weftline.operators.batches import last_rows


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(LOG_ENTRY).parquet(path)


def follow(entries: DataFrame, show: Callable[[DataFrame, int], None], checkpoint: str, keep: int = 5000) -> StreamingQuery:
    """Calls show with the last `keep` rows of each micro-batch."""
    return entries.writeStream.foreachBatch(lambda df, epoch: show(last_rows(df, ["seq"], keep), epoch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
