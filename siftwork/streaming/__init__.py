"""Feature counts over streams: constructs keep arriving, their label counts are kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_counts(nodes: DataFrame, by: str = "construct_id", label: str = "label") -> DataFrame:
    """Running counts (by, feature, value) of a stream of nodes; for output mode complete or update."""
    return nodes.groupBy(by, F.col(label).alias("feature")).agg(F.count("*").alias("value"))


def windowed_counts(events: DataFrame, time: str, window: str = "1 hour", late: str = "2 hours", label: str = "label") -> DataFrame:
    """Counts (start, feature, value) of a stream's labels in tumbling windows; rows later than `late` are dropped by the watermark,
    which also bounds the state; for output mode append or update."""
    w = F.window(time, window)
    return events.withWatermark(time, late).groupBy(w, F.col(label).alias("feature")).agg(F.count("*").alias("value")).select(F.col("window.start").alias("start"), "feature", "value")
