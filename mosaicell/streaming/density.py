"""An extension beyond batch parity: neighbourhood counts of a growing point stream.

Points arrive as files; each micro-batch adds its points to grid cells, so the count of a cell and
its neighbours is current without reading old points again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grid_counts(points: DataFrame, size: float) -> DataFrame:
    """gx, gy, n; for streams use output mode 'complete' or 'update'."""
    return points.groupBy(F.floor(F.col("x") / size).alias("gx"), F.floor(F.col("y") / size).alias("gy")).agg(F.count("*").alias("n"))


def windowed_counts(events: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Counts by time window, closed once the watermark has passed."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
