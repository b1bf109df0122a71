"""Append-only logs as Structured Streaming jobs; each equals its batch form over what has arrived."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_fraction(records: DataFrame) -> DataFrame:
    """Positives, rows and their share by epoch of a composition log (batch or stream; complete or update mode)."""
    n, p = F.sum("batch_size"), F.sum("n_positive")
    return records.groupBy("epoch").agg(p.alias("n_positive"), n.alias("n_rows"), (p / F.nullif(n, F.lit(0))).alias("positive_fraction"))


def latest_label_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each tile's label that was given last (update or complete mode)."""
    last = F.max(F.struct("labelled_at", "label"))
    return events.withWatermark("labelled_at", late).groupBy("tile_id").agg(last.alias("__l")).select("tile_id", F.col("__l.label").alias("label"), F.col("__l.labelled_at").alias("labelled_at"))


def labels_by_window(events: DataFrame, length: str = "10 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Labels given by window, tumbling or sliding; what comes later than the watermark is dropped."""
    w = F.window("labelled_at", length, slide) if slide else F.window("labelled_at", length)
    return events.withWatermark("labelled_at", late).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def review_sittings(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """A reviewer's sittings: labels without a pause longer than the gap."""
    return events.withWatermark("labelled_at", late).groupBy("reviewer", F.session_window("labelled_at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("reviewer", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
