"""Structured Streaming extension: group diagnostics of scored completions as
they arrive. Beyond what the batch operators cover; marked as an extension.

Each micro-batch is summarised per group and written under its batch number,
so that a batch replayed after a failure replaces itself: the result is the
same as if each row had come once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.scoring import run_summary, summarize_groups


def start_reward_log(stream: DataFrame, keys: list[str], sink: str, checkpoint: str, components: list[str]) -> StreamingQuery:
    """Writes one Parquet folder ``batch=<n>`` of group summaries per batch."""

    def write(batch: DataFrame, number: int) -> None:
        summarize_groups(batch, keys, components=components).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reward_log_summary(groups: DataFrame, components: list[str]) -> DataFrame:
    """The run's summary over all batches."""
    return run_summary(groups, components=components)


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts per window and key, with a watermark for late rows."""
    from pyspark.sql import functions as F

    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"))
