"""Queries of the work ledger over orders, and of responses over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.operators import ledger as L, responses as R, sets as O
from quire.plans import views as V
from quire.plans.catalog import query


def items(spark, sf) -> DataFrame:
    """Orders as work items; the state follows the priority."""
    state = (F.when(F.col("o_orderpriority") == "1-URGENT", "active").when(F.col("o_orderpriority") == "2-HIGH", "completed")
             .when(F.col("o_orderpriority") == "3-MEDIUM", "retryable").when(F.col("o_orderpriority") == "5-LOW", "failed").otherwise("pending"))
    return V.table(spark, sf, "orders").select(
        V.doi("10.1/o", "o_orderkey").alias("key"), F.col("o_orderkey").alias("ord"), state.alias("state"),
        F.when(state == "pending", 0).otherwise(1).cast("long").alias("attempts"), F.lit("").alias("detail"))


def batches(spark, sf) -> DataFrame:
    """Urgent work is in the open batch 2, all other attempted work in the closed batch 1."""
    i = items(spark, sf).filter("state <> 'pending'")
    return i.select(F.when(F.col("state") == "active", 2).otherwise(1).alias("batch_no"), "key", (F.col("state") != "active").alias("closed"))


_I = """WITH i AS (SELECT '10.1/o' || o_orderkey AS key, o_orderkey AS ord, CASE o_orderpriority WHEN '1-URGENT' THEN 'active' WHEN '2-HIGH' THEN 'completed' WHEN '3-MEDIUM' THEN 'retryable'
    WHEN '5-LOW' THEN 'failed' ELSE 'pending' END AS state, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 0 ELSE 1 END AS attempts, o_totalprice AS price, o_orderstatus AS status FROM orders)"""


@query("w1_sync_items", _I + """ SELECT key, CASE WHEN status = 'F' AND attempts > 0 THEN 'retryable' ELSE state END AS state, attempts FROM i WHERE price > 50000
    UNION ALL SELECT key, 'pending', 0 FROM i WHERE price <= 50000 AND status = 'F'""")
def w1(spark, sf):
    old = items(spark, sf).join(V.table(spark, sf, "orders").filter("o_totalprice > 50000").select(V.doi("10.1/o", "o_orderkey").alias("key")), "key", "left_semi")
    keys = V.table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(V.doi("10.1/o", "o_orderkey").alias("key"), F.col("o_orderkey").alias("ord"))
    return L.sync_items(old, keys, full=True).select("key", "state", "attempts")


@query("t5_next_batch", _I + " SELECT key, attempts + 1 AS attempts FROM i WHERE state = 'pending' ORDER BY ord LIMIT 50")
def t5(spark, sf):
    return L.next_batch(items(spark, sf), 50).select("key", "attempts")


@query("t5_open_batch", _I + """, b AS (SELECT key FROM i WHERE state = 'pending' ORDER BY ord LIMIT 50)
    SELECT state, count(*) AS n, sum(attempts)::BIGINT AS attempts FROM (SELECT CASE WHEN key IN (SELECT key FROM b) THEN 'active' ELSE state END AS state,
      attempts + CASE WHEN key IN (SELECT key FROM b) THEN 1 ELSE 0 END AS attempts FROM i) GROUP BY state""")
def t5_open(spark, sf):
    i = items(spark, sf)
    return L.open_batch(i, L.next_batch(i, 50)).groupBy("state").agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts"))


@query("w2_validate_ledger", _I + " SELECT key, 'attempts do not match batches' AS problem FROM i WHERE price > 400000 UNION ALL SELECT '10.1/u' || user_id, 'unknown key' FROM events GROUP BY user_id")
def w2(spark, sf):
    rich = V.table(spark, sf, "orders").filter("o_totalprice > 400000").select(V.doi("10.1/o", "o_orderkey").alias("key"), F.lit(1).alias("x"))
    i = items(spark, sf).join(rich, "key", "left").withColumn("attempts", F.col("attempts") + F.coalesce("x", F.lit(0))).drop("x")
    i = i.withColumn("state", F.when((F.col("state") == "pending") & (F.col("attempts") > 0), "retryable").otherwise(F.col("state")))
    stray = V.table(spark, sf, "events").select(F.lit(1).alias("batch_no"), V.doi("10.1/u", "user_id").alias("key"), F.lit(True).alias("closed")).distinct()
    return L.validate_ledger(i, batches(spark, sf).unionByName(stray))


@query("w3_record_results", _I + """ SELECT key, CASE WHEN state = 'active' THEN CASE WHEN price > 200000 THEN 'completed' ELSE 'retryable' END ELSE state END AS state FROM i""")
def w3(spark, sf):
    res = V.table(spark, sf, "orders").select(V.doi("10.1/o", "o_orderkey").alias("key"), F.when(F.col("o_totalprice") > 200000, "completed").otherwise("retryable").alias("state"), F.lit("x").alias("detail"))
    return L.record_results(items(spark, sf), res)[0].select("key", "state")


@query("w3_refused_results", _I + " SELECT key, 'not active' AS problem FROM i WHERE state <> 'active'")
def w3_refused(spark, sf):
    res = items(spark, sf).select("key", F.lit("completed").alias("state"), "detail")
    return L.record_results(items(spark, sf), res)[1].select("key", "problem")


@query("w3_can_close", _I + " SELECT 2 AS batch_no, count(*) AS active FROM i WHERE state = 'active'")
def w3_close(spark, sf):
    return L.can_close(items(spark, sf), batches(spark, sf))


@query("a16_progress", _I + """ SELECT count(*) AS total, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'active') AS active, count(*) FILTER (state = 'completed') AS completed,
    count(*) FILTER (state = 'retryable') AS retryable, count(*) FILTER (state = 'failed') AS failed, 2 AS batches_opened, 1 AS batches_closed, false AS exhausted, false AS successful FROM i""")
def a16(spark, sf):
    return L.progress(items(spark, sf), batches(spark, sf))


@query("w5_reconcile_work", _I + """ SELECT key, CASE WHEN state = 'active' AND (price > 450000 OR price < 60000 OR status = 'F') THEN 'completed' ELSE state END AS state FROM i""")
def w5(spark, sf):
    report = V.table(spark, sf, "orders").select(V.doi("10.1/o", "o_orderkey").alias("doi"), F.when(F.col("o_totalprice") > 450000, "skipped").otherwise("queued").alias("outcome"))
    return L.reconcile_work(items(spark, sf), report, O.state_membership(V.order_states(spark, sf)))[0].select("key", "state")


@query("w5_vanished", _I + """ SELECT key FROM i WHERE state = 'active' AND NOT (price > 450000 OR price < 60000 OR status = 'F' OR status = 'O')""")
def w5_gone(spark, sf):
    report = V.table(spark, sf, "orders").select(V.doi("10.1/o", "o_orderkey").alias("doi"), F.when(F.col("o_totalprice") > 450000, "skipped").otherwise("queued").alias("outcome"))
    return L.reconcile_work(items(spark, sf), report, O.state_membership(V.order_states(spark, sf)))[1]


def responses(spark, sf) -> DataFrame:
    """Events as responses: the status follows type and value."""
    status = F.when(F.col("event_type") == "error", F.when(F.col("value") > 50, 429).otherwise(503)).otherwise(200)
    return V.table(spark, sf, "events").select(
        F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), "ts", F.col("props").alias("payload"), status.alias("status"),
        V.doi("u", "user_id").alias("source"), "event_id")


_R = """WITH r AS (SELECT user_id || ':' || event_type AS key, ts, props AS payload, CASE WHEN event_type = 'error' THEN CASE WHEN value > 50 THEN 429 ELSE 503 END ELSE 200 END AS status,
    'u' || user_id AS source, event_id FROM events)"""


@query("x3_fresh_responses", _R + " SELECT key, (max(ts)::VARCHAR)[:19] AS ts, arg_max(payload, (ts, payload)) AS payload FROM r WHERE status = 200 AND ts > TIMESTAMP '2024-01-21' GROUP BY key")
def x3(spark, sf):
    out = R.fresh_responses(responses(spark, sf), "2024-01-31 00:00:00", 10 * 86400)
    return out.select("key", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "payload")


@query("x4_limited_sources", _R + " SELECT source, count(*) AS kept FROM (SELECT r.*, min(ts) FILTER (status = 429) OVER (PARTITION BY source) AS lim FROM r) WHERE lim IS NULL OR ts < lim GROUP BY source")
def x4(spark, sf):
    return R.before_limit(responses(spark, sf)).groupBy("source").agg(F.count("*").alias("kept"))
