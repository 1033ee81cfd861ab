"""Alias chains between identifiers: edges ``(src, dst, reason)`` with unique ``src``."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from quire.session import cut_lineage


def resolve_aliases(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(src, terminal)`` of every chain, and the ``src`` rows that run into a cycle.

    Pointer doubling: each round doubles the distance a row looks ahead, so chains of n
    edges need log2(n) joins. Finished rows leave the join; rows still open after the last
    round lie on, or lead into, a cycle.
    """
    edges = edges.select("src", "dst")
    sources = edges.select(F.col("src").alias("dst")).withColumn("open", F.lit(True))
    cur = cut_lineage(edges.join(sources, "dst", "left").select(
        "src", "dst", F.coalesce("open", F.lit(False)).alias("open")))
    rounds = math.ceil(math.log2(max(cur.count(), 2))) + 1
    for _ in range(rounds):
        if cur.filter("open").isEmpty():
            break
        ahead = cur.select(F.col("src").alias("dst"), F.col("dst").alias("next"), F.col("open").alias("next_open"))
        moved = cur.filter("open").join(ahead, "dst").select(
            "src", F.col("next").alias("dst"), F.col("next_open").alias("open"))
        cur = cut_lineage(cur.filter(~F.col("open")).unionByName(moved))
    return (
        cur.filter(~F.col("open")).select("src", F.col("dst").alias("terminal")),
        cur.filter("open").select("src"),
    )


def alias_cycles(edges: DataFrame) -> DataFrame:
    return resolve_aliases(edges)[1]


def add_aliases(edges: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Record reviewed replacements; returns the new edge table and the refused rows.

    The target is resolved first. The same terminal again is a no-op, another one is a
    conflict, and a source may neither be its own target nor close a cycle.
    """
    resolved, _ = resolve_aliases(edges)
    ends = resolved.select(F.col("src").alias("dst"), F.col("terminal").alias("end"))
    known = resolved.select("src", F.col("terminal").alias("known_end"))
    wanted = (
        new.select("src", "dst").distinct()
        .join(ends, "dst", "left")
        .withColumn("target", F.coalesce("end", "dst"))
        .join(known, "src", "left")
    )
    spread = wanted.groupBy("src").agg(F.min("target").alias("lo"), F.max("target").alias("hi"))
    judged = wanted.join(spread, "src").withColumn(
        "problem",
        F.when(F.col("src") == F.col("target"), "self")
        .when(F.col("known_end").isNotNull() & (F.col("known_end") != F.col("target")), "conflict")
        .when(F.col("known_end").isNull() & (F.col("lo") != F.col("hi")), "ambiguous"),
    )
    fresh = judged.filter("problem IS NULL AND known_end IS NULL").select(
        "src", F.col("target").alias("dst"), F.lit("superseded").alias("reason")).distinct()
    merged = edges.select("src", "dst", "reason").unionByName(fresh)
    looped = alias_cycles(merged).join(fresh.select("src"), "src", "left_semi")
    kept = merged.join(looped, "src", "left_anti")
    refused = judged.filter("problem IS NOT NULL").select("src", F.col("target").alias("dst"), "problem").unionByName(
        fresh.join(looped, "src", "left_semi").select("src", "dst", F.lit("cycle").alias("problem")))
    return kept, refused
