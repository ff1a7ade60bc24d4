"""Streaming forms of the event reports and the catalogue upsert (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from andamio.operators import snapshots, suggestions


def suggestion_windows(events: DataFrame, length: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts of suggestions and decisions by window and confidence, for late events up to ``late``."""
    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    rows = events.withColumn("created", F.col("created").cast("timestamp")).withWatermark("created", late)
    groups = rows.groupBy(F.window("created", length), "confidence")
    counts = groups.agg(count(suggestions.ADDED).alias("suggested"), count(suggestions.ACCEPTED).alias("accepted"), count(suggestions.REPLACED).alias("replaced"), count(suggestions.REMOVED).alias("removed"))
    return counts.select(F.col("window.start").alias("begin"), "confidence", "suggested", "accepted", "replaced", "removed")


def upsert_stream(batches: DataFrame, path: str, checkpoint: str, buckets: int = snapshots.BUCKETS):
    """Writes a version of the catalogue under ``path`` for each micro-batch, numbered by it.

    A version rewrites the buckets that its batch touches (``snapshots``). A batch that is
    repeated after a failure writes its own version again from the one before, so its
    effect is the same.
    """

    def apply(batch: DataFrame, number: int) -> None:
        snapshots.upsert(batch, path, number, number - 1 if number else None, buckets)

    return batches.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
