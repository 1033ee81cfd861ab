"""Streaming forms of screening, merging and response freshness."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quire.operators.responses import LIMIT_STATUS, keepable
from quire.operators.screening import match_rules, triage
from quire.sources.versions import Store
from quire.streaming.buckets import BUCKETS, MergeTable


def screen_stream(stream: DataFrame, known: DataFrame, accept: list[str], reject: list[str], unmatched: str = "manual-review") -> DataFrame:
    """Outcome of each key when it first arrives, however late; ``stream``: doi, ts, text.

    The keys seen so far are the state: one entry per key for good, in the checkpoint of the query.
    Known keys are dropped before they enter it. Without a watermark no row is lost; give the
    session the RocksDB state store, which keeps the keys on disk.
    """
    fresh = stream.join(known.select("doi"), "doi", "left_anti").dropDuplicates(["doi"])
    rows = fresh.withColumn("accept_matches", match_rules("text", accept)).withColumn("reject_matches", match_rules("text", reject))
    return rows.withColumn("outcome", triage("accept_matches", "reject_matches", unmatched))


def screen_into(stream: DataFrame, known: DataFrame, accept: list[str], reject: list[str], path: str, checkpoint: str, delay: str = "30 days",
                unmatched: str = "manual-review", available_now: bool = True) -> StreamingQuery:
    """Screen a stream into two tables under ``path``: rows in time, and rows that came late.

    Late is a first arrival whose ``ts`` lies more than ``delay`` before the newest one of earlier
    batches. Both kinds are screened and kept; ``arrivals`` reads them. A batch is written by one
    job into a folder of its own and then committed with the newest time, so a batch that comes
    again changes nothing.
    """
    store = Store(stream.sparkSession, path)
    outcomes = screen_stream(stream, known, accept, reject, unmatched)

    def keep(batch: DataFrame, batch_id: int) -> None:
        number, done = store.current() or (-1, {"batches": {}, "newest": None})
        if batch_id <= done["batches"].get(checkpoint, -1):
            return
        newest = done["newest"]
        behind = F.lit(False) if newest is None else F.coalesce(F.col("ts") < F.timestamp_micros(F.lit(newest)) - F.expr(f"INTERVAL {delay}"), F.lit(False))
        seen = Observation()
        rows = batch.withColumn("late", behind).observe(seen, F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("newest"))
        rows.write.mode("overwrite").partitionBy("late").parquet(f"{path}/arrivals/batch={number + 1}")
        latest = max((x for x in (newest, seen.get["newest"]) if x is not None), default=None)
        store.commit(number + 1, {"batches": done["batches"] | {checkpoint: batch_id}, "newest": latest})
        store.retire(lambda m: set(), lambda: [])

    writer = outcomes.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def arrivals(spark: SparkSession, path: str, late: bool) -> DataFrame:
    """Screened rows of all committed batches of ``screen_into`` that came in time, or late, with their ``batch``."""
    done = Store(spark, path).current()
    rows = spark.read.parquet(f"{path}/arrivals")
    return rows.filter((F.col("batch") <= (done[0] if done else -1)) & (F.col("late") == str(late).lower())).drop("late")


def merge_stream(stream: DataFrame, base: DataFrame, path: str, checkpoint: str, available_now: bool = True, buckets: int = BUCKETS) -> StreamingQuery:
    """Merge every micro-batch into a table in buckets under ``path``; ``base`` is its first version.

    A batch rewrites the buckets whose rows it changes and nothing else; a replayed batch is a no-op.
    """
    table = MergeTable.create(stream.sparkSession, path, base, buckets)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        table.merge_batch(batch, batch_id, checkpoint)

    writer = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_version(spark: SparkSession, path: str) -> DataFrame:
    """Newest version of a table written by ``merge_stream``."""
    return MergeTable(spark, path).read()


class NewestResponse(StatefulProcessor):
    """Keeps the newest payload per request key for its lifetime and emits it when it changes."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "ts timestamp, payload string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = self.newest.get() if self.newest.exists() else None
        changed = False
        for frame in rows:
            top = frame.sort_values(["ts", "payload"]).iloc[-1]
            if best is None or (top["ts"], top["payload"]) > (pd.Timestamp(best[0]), best[1]):
                best, changed = (top["ts"].to_pydatetime(), top["payload"]), True
        if changed:
            self.newest.update(best)
            yield pd.DataFrame({"key": [key[0]], "ts": [best[0]], "payload": [best[1]]})

    def close(self) -> None:
        pass


def fresh_responses_stream(stream: DataFrame, ttl_seconds: int, now=None) -> DataFrame:
    """Newest kept payload per request key that is younger than the lifetime; state expires after it.

    ``now`` fixes the time of a replay; without it each batch takes its own.
    """
    clock = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    age = clock.cast("double") - F.col("ts").cast("timestamp").cast("double")
    rows = stream.filter(keepable("status")).filter(F.greatest(age, F.lit(0.0)) < ttl_seconds).select("key", "ts", "payload")
    return rows.groupBy("key").transformWithStateInPandas(
        NewestResponse(ttl_seconds * 1000), "key string, ts timestamp, payload string", "Update", "ProcessingTime")


def limited_sources_stream(stream: DataFrame) -> DataFrame:
    """Running first limit status per source."""
    return stream.filter(F.col("status") == LIMIT_STATUS).groupBy("source").agg(F.min("ts").alias("limited_at"))
