"""Forecasts that follow a stream: observations are summed by period, and touched series are forecast anew.

The reference capabilities are batch ones; this is an addition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def period_totals(stream: DataFrame, time: str, key: str, value: str, period: str = "1 day", late: str = "2 days") -> DataFrame:
    """Sums by key and period; rows later than ``late`` don't count."""
    windowed = stream.withWatermark(time, late).groupBy(F.window(time, period), F.col(key).alias("uid"))
    return windowed.agg(F.sum(value).alias("y")).select("uid", F.col("window.start").alias("start"), "y")


def refresh(totals: DataFrame, history: Callable[[], DataFrame], forecast: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Each batch: add its totals to ``history()`` (without them), forecast the series it touched, write ``sink/batch=N``.

    A batch that Spark replays after a failure replaces what it wrote before.
    """

    def step(batch: DataFrame, number: int) -> None:
        touched = batch.select("uid").distinct()
        rows = history().join(touched, "uid", "left_semi").unionByName(batch)
        forecast(rows).write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch={number}")

    return totals.writeStream.outputMode("append").foreachBatch(step).option("checkpointLocation", checkpoint).start()
