"""Provider responses: freshness and sources out of service."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Statuses never kept, and the status that ends a source for the run.
UNCACHED = [401, 403, 429]
LIMIT_STATUS = 429


def keepable(status):
    s = F.col(status) if isinstance(status, str) else status
    return ~(s.isin(UNCACHED) | s.between(500, 599))


def fresh_responses(events: DataFrame, now, ttl_seconds: float) -> DataFrame:
    """Newest kept payload per request key that is younger than the lifetime."""
    age = F.lit(now).cast("timestamp").cast("double") - F.col("ts").cast("timestamp").cast("double")
    rows = events.filter(keepable("status")).filter(F.greatest(age, F.lit(0)) < ttl_seconds)
    return rows.groupBy("key").agg(F.max("ts").alias("ts"), F.max_by("payload", F.struct("ts", "payload")).alias("payload"))


def limited_sources(events: DataFrame) -> DataFrame:
    """First limit status per source."""
    return events.filter(F.col("status") == LIMIT_STATUS).groupBy("source").agg(F.min("ts").alias("limited_at"))


def before_limit(events: DataFrame) -> DataFrame:
    """Events of a source up to its limit; later ones are dropped.

    One row per source joins back, and hot sources are split by the adaptive skew join.
    """
    return events.join(limited_sources(events), "source", "left").filter("limited_at IS NULL OR ts < limited_at").drop("limited_at")
