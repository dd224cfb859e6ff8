"""Aging buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: upper edge in hours (exclusive) and label of each bucket --
BUCKET_EDGES = [24, 48, 72, 168]
BUCKET_LABELS = ["0-24h", "24-48h", "48-72h", "72h-7d", "7d+"]


def aging_bucket(hours: Column) -> Column:
    """Label of the left-closed bucket that holds `hours`; null for null or negative."""
    bucket = F.when(hours < 0, F.lit(None).cast("string"))
    for edge, label in zip(BUCKET_EDGES, BUCKET_LABELS):
        bucket = bucket.when(hours < edge, label)
    return bucket.when(hours.isNotNull(), BUCKET_LABELS[-1])
