"""How often a detector raises an alarm, in windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def alarm_rate(flagged: DataFrame, time: str, window: str, lateness: str, keys: tuple[str, ...] = ("domain",)) -> DataFrame:
    """(window_start, window_end, keys, n, n_flagged, rate) of a stream of rows with ``flagged`` 0 or 1.

    Windows tumble. A window comes out once the stream is ``lateness`` past its end, and rows that
    arrive for it after that are dropped; so the state kept is that of open windows only. Rows without a time
    belong to no window; a missing decision counts as a row without alarm. On a batch every window comes out.
    """
    counted = flagged.withWatermark(time, lateness).groupBy(F.window(time, window).alias("window"), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("flagged"), F.lit(0)).cast("long").alias("n_flagged"))
    return counted.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n", "n_flagged",
        (F.col("n_flagged") / F.col("n")).alias("rate"))
