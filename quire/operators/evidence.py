"""Relevance evidence: upsert, decisions, final labels, backfill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.text import blank_to_null


def merge_evidence(old: DataFrame, new: DataFrame) -> DataFrame:
    """New snapshots replace old ones; blank decisions and batch context inherit the old values.

    ``doi`` is unique on both sides, so one full join decides every row.
    """
    sticky = {"human_decision", "correction_decision"}
    context = {"batch_id", "attempt"}
    o = old.select(F.col("doi"), F.struct(*[c for c in old.columns if c != "doi"]).alias("o"))
    n = new.select(F.col("doi"), F.struct(*[c for c in new.columns if c != "doi"]).alias("n"))
    both = o.join(n, "doi", "full")
    has_old, has_new = F.col("o").isNotNull(), F.col("n").isNotNull()
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""

    def pick(c: str) -> Column:
        fresh, stale = F.col(f"n.{c}"), F.col(f"o.{c}")
        if c == "ord":
            return F.when(has_old, stale).otherwise(fresh)
        if c in sticky:
            return F.when(~has_new | (has_old & blank(f"n.{c}") & ~blank(f"o.{c}")), stale).otherwise(fresh)
        if c in context:
            return F.when(~has_new | (has_old & blank("n.batch_id") & ~blank("o.batch_id")), stale).otherwise(fresh)
        return F.when(has_new, fresh).otherwise(stale)

    columns = [c for c in old.columns if c != "doi"]
    return both.select("doi", F.when(has_old, 0).otherwise(1).alias("side"), *[pick(c).alias(c) for c in columns])


def record_decisions(evidence: DataFrame, decisions: DataFrame, column: str = "human_decision") -> DataFrame:
    """Write ``decision`` per doi into ``column``; keys without evidence are ignored."""
    d = decisions.select("doi", F.lower(F.trim("decision")).alias("_d")).filter(F.col("_d").isin("keep", "reject"))
    return evidence.join(d, "doi", "left").withColumn(column, F.coalesce("_d", column)).drop("_d")


def record_corrections(evidence: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``record_decisions`` for corrections; keys without evidence are returned as violations."""
    unknown = corrections.join(evidence.select("doi"), "doi", "left_anti")
    return record_decisions(evidence, corrections, "correction_decision"), unknown


def labels(evidence: DataFrame, canonical: DataFrame, rejected: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Final label with its source per key, and decisions that contradict the state tables.

    Precedence: correction, human decision, state of the alias target, canonical, rejected.
    ``aliases`` is the resolved table ``(src, terminal)``. The key sets stay slim, and each
    is joined once on its own key.
    """
    canon = canonical.select("doi").distinct().withColumn("in_canon", F.lit(True))
    gone = rejected.select("doi").distinct().withColumn("in_rejected", F.lit(True))
    alias_state = (
        aliases.select(F.col("src").alias("doi"), F.col("terminal").alias("t"))
        .join(canon.select(F.col("doi").alias("t"), F.lit(True).alias("t_canon")), "t", "left")
        .join(gone.select(F.col("doi").alias("t"), F.lit(True).alias("t_rejected")), "t", "left")
        .select("doi", F.lit(True).alias("is_alias"), "t_canon", "t_rejected")
    )
    rows = (
        evidence.select("doi", blank_to_null("correction_decision").alias("c"), blank_to_null("human_decision").alias("h"))
        .join(alias_state, "doi", "left").join(canon, "doi", "left").join(gone, "doi", "left")
    )
    pair = lambda label, source: F.struct(label.alias("label"), F.lit(source).alias("source"))
    keep, reject = F.lit("keep"), F.lit("reject")
    verdict = (
        F.when(F.col("c").isNotNull(), pair(F.col("c"), "correction"))
        .when(F.col("h").isNotNull(), pair(F.col("h"), "human"))
        .when(F.col("is_alias"), F.when(F.col("t_canon"), pair(keep, "alias")).when(F.col("t_rejected"), pair(reject, "alias")))
        .when(F.col("in_canon"), pair(keep, "canonical"))
        .when(F.col("in_rejected"), pair(reject, "terminal"))
    )
    judged = rows.withColumn("v", verdict).filter("v IS NOT NULL").select("doi", "v.*", "in_canon", "in_rejected")
    clash = F.col("source").isin("correction", "human") & (
        ((F.col("label") == "keep") & F.col("in_rejected").isNotNull())
        | ((F.col("label") == "reject") & F.col("in_canon").isNotNull()))
    return (
        judged.filter(~clash).select("doi", "label", "source"),
        judged.filter(clash).select("doi", "label", "source"),
    )


def backfill_evidence(evidence: DataFrame, publications: DataFrame, rejected: DataFrame, works: DataFrame,
                      context: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence rows for canonical and rejected keys that have none, and rejected keys without a record.

    ``publications`` and ``works``: doi, title, abstract, keywords, work_type.
    ``context``: doi, batch_id, attempt.
    """
    fields = ["doi", "title", "abstract", "keywords", "work_type"]
    known = evidence.select("doi")
    canon = publications.filter("doi IS NOT NULL").select(*fields).join(known, "doi", "left_anti").withColumn(
        "source", F.lit("canonical-backfill"))
    missing = rejected.select("doi").distinct().join(known, "doi", "left_anti").join(
        publications.select("doi"), "doi", "left_anti")
    found = missing.join(works.select(*fields), "doi").withColumn("source", F.lit("backfill"))
    unavailable = missing.join(works.select("doi"), "doi", "left_anti")
    added = canon.unionByName(found).join(context.select("doi", "batch_id", "attempt"), "doi", "left")
    return added.select(
        *fields, F.lit("unknown").alias("screening_outcome"), "source",
        F.coalesce("batch_id", F.lit("")).alias("batch_id"), F.coalesce("attempt", F.lit(0)).alias("attempt"),
    ), unavailable
