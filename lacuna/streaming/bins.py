"""The complete-bin rule on a stream: a bin is usable once it is complete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def completed_bins(readings: DataFrame, step: str, late: str, low: float, high: float) -> DataFrame:
    """case_id, start, value: the median per case and bin of readings (case_id, ts, value) in [low, high].

    In append mode a bin is emitted once, when the watermark (``late`` behind the newest reading) has passed its end;
    later readings of it are dropped. State holds the open bins only.
    """
    kept = readings.where(F.col("value").between(low, high)).withWatermark("ts", late)
    return kept.groupBy("case_id", F.window("ts", step)).agg(F.median("value").alias("value")).select("case_id", F.col("window.start").alias("start"), "value")
