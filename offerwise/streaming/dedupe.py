"""Duplicate claims in a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_repeats(
    claims: DataFrame, keys: list[str], event_time: str, within: str = "2 hours"
) -> DataFrame:
    """Drop repeats of a key that arrive within the delay; state is dropped after it."""
    return claims.withWatermark(event_time, within).dropDuplicatesWithinWatermark(keys)


def once_per_window(
    claims: DataFrame, keys: list[str], event_time: str, window: str = "1 day", late: str = "2 hours"
) -> DataFrame:
    """One row per key and window of event time; the struct ``window`` stands in place of the time.

    The result doesn't depend on how rows fall into micro-batches: a window's keys are kept until
    the watermark, ``late`` behind the latest event, has passed its end, and leave the state then.
    Rows of a window that is over are late and are dropped, as are rows without a time.
    """
    timed = claims.withWatermark(event_time, late).withColumn("window", F.window(event_time, window))
    return timed.drop(event_time).dropDuplicates([*keys, "window"])
