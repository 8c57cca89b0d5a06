"""Event logs as streams: gap-free numbers, exactly-once requests, windows, and idempotent publication."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def numbered(events: DataFrame, task: str, order: str) -> DataFrame:
    """(task, order, seq): events of each task numbered from 1 without a gap, over all batches; the state is one counter a task."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (last,) = state.get if state.exists else (0,)
        rows = pd.concat(list(frames))[[task, order]].sort_values(order)
        rows["seq"] = range(last + 1, last + 1 + len(rows))
        state.update((last + len(rows),))
        yield rows

    return events.groupBy(task).applyInPandasWithState(step, f"{task} {kinds[task]}, {order} {kinds[order]}, seq long", "last long", "append", "NoTimeout")


def once(requests: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each request id; ids are remembered as long as ``delay`` behind the watermark."""
    return requests.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed(events: DataFrame, time: str, size: str, delay: str, by: str, value: str) -> DataFrame:
    """(start, by, n, total) of tumbling windows, given out once the watermark has passed them."""
    grouped = events.withWatermark(time, delay).groupBy(F.window(time, size), by)
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, delay: str, by: str) -> DataFrame:
    """(start, end, by, n) of runs of events with no longer pause than ``gap``."""
    grouped = events.withWatermark(time, delay).groupBy(F.session_window(time, gap), by).agg(F.count("*").alias("n"))
    return grouped.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


def publish(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each batch under its own number: a batch that is run again overwrites what it wrote before."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
