"""Stateful streaming of response freshness."""

import tempfile

from quire.streaming import jobs as J


def test_fresh_responses_stream(spark):
    folder = tempfile.mkdtemp(prefix="quire-test-")
    rows = [("a", "2024-01-01 00:00:00", "old", 200), ("a", "2024-01-02 00:00:00", "new", 200), ("a", "2024-01-03 00:00:00", "bad", 429), ("b", "2024-01-01 00:00:00", "x", 404),
            ("c", "2023-12-01 00:00:00", "too old", 200)]
    df = spark.createDataFrame(rows, "key string, ts string, payload string, status int").selectExpr("key", "cast(ts AS timestamp) AS ts", "payload", "status")
    df.coalesce(1).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{folder}/in")

    def keep(batch, batch_id):
        batch.write.mode("append").parquet(f"{folder}/out")

    q = (J.fresh_responses_stream(stream, 10 ** 6, "2024-01-05 00:00:00").writeStream.outputMode("update").foreachBatch(keep)
         .option("checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination(90)
    assert sorted((r["key"], r["payload"]) for r in spark.read.parquet(f"{folder}/out").collect()) == [("a", "new"), ("b", "x")]
