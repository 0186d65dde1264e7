"""Incremental enrichment: each micro-batch of raw transactions goes through the batch expressions, joined with static tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.enrich import enrich


def enrich_stream(raw: DataFrame, accounts: DataFrame, assigned: DataFrame, n_accounts: int, profiles: DataFrame, patterns: DataFrame) -> DataFrame:
    """The observable ledger of a stream of raw transactions. Stateless, so there is no watermark; each row depends on nothing but itself."""
    return enrich(raw, accounts, assigned, n_accounts, profiles, patterns)


def append(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append to a parquet table, exactly once by the sink's own log."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
