"""Work ledger: items ``(key, ord, state, attempts, detail)`` and batches ``(batch_no, key, closed)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Item states and the ones a result may set.
ITEM_STATES = ["pending", "active", "completed", "retryable", "failed"]
RESULT_STATES = ["completed", "retryable", "failed"]


def sync_items(items: DataFrame, keys: DataFrame, full: bool = False) -> DataFrame:
    """Add new keys as pending; a full re-run marks attempted current keys retryable."""
    current = keys.select("key", "ord").withColumn("_cur", F.lit(True))
    both = items.join(current.select("key", "_cur"), "key", "left")
    if full:
        again = F.coalesce(F.col("_cur"), F.lit(False)) & (F.col("attempts") > 0)
        both = both.withColumn("state", F.when(again, "retryable").otherwise(F.col("state"))).withColumn(
            "detail", F.when(again, "").otherwise(F.col("detail")))
    new = current.join(items.select("key"), "key", "left_anti").select(
        "key", "ord", F.lit("pending").alias("state"), F.lit(0).cast("long").alias("attempts"), F.lit("").alias("detail"))
    return both.select("key", "ord", "state", F.col("attempts").cast("long").alias("attempts"), "detail").unionByName(new)


def next_batch(items: DataFrame, size: int) -> DataFrame:
    """Keys of the next batch: pending items in order, retryable ones only when none is pending.

    The best rank is a scalar subquery; the first ``size`` rows come from a bounded sort.
    """
    ranked = items.withColumn("rank", F.when(F.col("state") == "pending", 0).when(F.col("state") == "retryable", 1))
    best = ranked.agg(F.min("rank")).scalar()
    return ranked.filter(F.col("rank") == best).orderBy("ord").limit(size).select("key", "ord", (F.col("attempts") + 1).alias("attempts"))


def open_batch(items: DataFrame, batch: DataFrame) -> DataFrame:
    """Items with the batch's keys set active."""
    b = batch.select("key", F.lit(True).alias("_in"))
    rows = items.join(b, "key", "left")
    on = F.col("_in").isNotNull()
    return rows.select("key", "ord", F.when(on, "active").otherwise(F.col("state")).alias("state"),
                       (F.col("attempts") + on.cast("int")).alias("attempts"), F.when(on, "").otherwise(F.col("detail")).alias("detail"))


def record_results(items: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items with the results ``(key, state, detail)`` recorded, and refused results."""
    r = results.select("key", F.col("state").alias("new_state"), F.coalesce("detail", F.lit("")).alias("new_detail"))
    rows = items.join(r, "key", "full")
    problem = (F.when(F.col("new_state").isNull(), F.lit(None)).when(F.col("state").isNull(), "unknown item")
               .when(~F.col("new_state").isin(RESULT_STATES), "unsupported state").when(F.col("state") != "active", "not active"))
    rows = rows.withColumn("problem", problem)
    take = F.col("new_state").isNotNull() & F.col("problem").isNull()
    updated = rows.filter("state IS NOT NULL").select(
        "key", "ord", F.when(take, F.col("new_state")).otherwise(F.col("state")).alias("state"), "attempts",
        F.when(take, F.col("new_detail")).otherwise(F.col("detail")).alias("detail"))
    return updated, rows.filter("problem IS NOT NULL").select("key", F.col("new_state").alias("state"), "problem")


def can_close(items: DataFrame, batches: DataFrame) -> DataFrame:
    """Active items per open batch; an open batch with 0 may be closed."""
    rows = batches.filter("NOT closed").join(items.select("key", "state"), "key")
    return rows.groupBy("batch_no").agg(F.count_if(F.col("state") == "active").alias("active"))


def validate_ledger(items: DataFrame, batches: DataFrame) -> DataFrame:
    """Violations ``(key, problem)`` of the ledger invariants."""
    twice = items.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", F.lit("duplicate key").alias("problem"))
    seen = batches.groupBy("key").agg(
        F.count("*").alias("uses"), F.bool_or(~F.col("closed")).alias("open"), F.count_distinct("batch_no").alias("in_batches"))
    both = items.join(seen, "key", "full")
    uses = F.coalesce("uses", F.lit(0))
    checks = F.array_compact(F.array(
        F.when(F.col("state").isNull(), F.lit("unknown key")),
        F.when(F.col("uses") != F.col("in_batches"), F.lit("repeated in one batch")),
        F.when(F.col("state").isNotNull() & ~F.col("state").isin(ITEM_STATES), F.lit("unknown state")),
        F.when(F.col("attempts") != uses, F.lit("attempts do not match batches")),
        F.when((F.col("state") == "pending") & (F.col("attempts") > 0), F.lit("pending with attempts")),
        F.when((F.col("state") == "active") & ~F.coalesce(F.col("open"), F.lit(False)), F.lit("active outside the open batch"))))
    rows = both.select("key", F.explode(checks).alias("problem"))
    opened = batches.filter("NOT closed").select("batch_no").distinct().agg(F.count("*").alias("n")).filter("n > 1").select(
        F.lit("").alias("key"), F.lit("several open batches").alias("problem"))
    return twice.unionByName(rows).unionByName(opened)


def progress(items: DataFrame, batches: DataFrame) -> DataFrame:
    """One row of counters with the exhausted and successful flags."""
    b = batches.groupBy("batch_no").agg(F.bool_and("closed").alias("closed")).agg(
        F.count("*").alias("opened"), F.count_if("closed").alias("done"))
    opened, done = b.select("opened").scalar(), b.select("done").scalar()
    state = F.col("state")
    rows = items.agg(F.count("*").alias("total"), *[F.count_if(state == s).alias(s) for s in ITEM_STATES])
    rows = rows.withColumn("batches_opened", opened).withColumn("batches_closed", done)
    exhausted = (F.col("pending") + F.col("active") + F.col("retryable") == 0) & (F.col("batches_opened") == F.col("batches_closed"))
    return rows.withColumn("exhausted", exhausted).withColumn("successful", exhausted & (F.col("failed") == 0))


def reconcile_work(items: DataFrame, report: DataFrame, membership: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Active items against the state tables: ``(items, vanished keys)``.

    Skipped, rejected or merged keys are completed, keys still in flight stay.
    """
    rows = (items.join(report.select(F.col("doi").alias("key"), "outcome"), "key", "left")
            .join(membership.withColumnRenamed("doi", "key"), "key", "left"))
    on = lambda f: F.coalesce(F.col(f), F.lit(False))
    judged = (F.col("state") == "active") & F.col("outcome").isNotNull()
    done = judged & ((F.col("outcome") == "skipped") | on("rejected") | on("canonical"))
    flying = on("queued") | on("review") | on("staged")
    out = rows.withColumn("_gone", judged & ~done & ~flying)
    return (out.select("key", "ord", F.when(done, "completed").otherwise(F.col("state")).alias("state"), "attempts", "detail"),
            out.filter("_gone").select("key"))
