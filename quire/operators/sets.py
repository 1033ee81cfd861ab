"""Ordered set operators: dedupe, append, violations, status sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.functions.identity import norm_doi


def dedupe_first(df: DataFrame, *keys: str, order: str = "ord") -> DataFrame:
    """Keep the first row of each key by ``order``.

    The rank filter becomes a window group limit: each task keeps one row per key before
    the shuffle, so copies of a hot key do not meet in one task.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def append_unique(a: DataFrame, b: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """Rows of ``a``, then the new keys of ``b``, first occurrence kept in order."""
    tagged = a.withColumn("_side", F.lit(0)).unionByName(b.withColumn("_side", F.lit(1)))
    ranked = tagged.withColumn("_pos", F.struct("_side", order))
    return dedupe_first(ranked, key, order="_pos").drop("_side", "_pos")


def prepare_keys(df: DataFrame, known: DataFrame, key: str = "doi", order: str = "ord") -> DataFrame:
    """Normalised, non-blank, first-occurrence keys that are not known yet."""
    keys = df.withColumn(key, norm_doi(key)).filter(F.col(key).isNotNull())
    return dedupe_first(keys.join(known.select(key), key, "left_anti"), key, order=order)


def exclude_substrings(df: DataFrame, fragments: list[str], key: str = "doi") -> DataFrame:
    """Drop keys holding any of the fragments."""
    wanted = [f.strip().lower() for f in fragments if f.strip()]
    if not wanted:
        return df
    return df.filter(~reduce(Column.__or__, [F.contains(F.col(key), F.lit(f)) for f in wanted]))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    present = reduce(Column.__and__, [F.col(k).isNotNull() & (F.col(k).cast("string") != "") for k in keys])
    return df.filter(present).groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def state_membership(tables: dict[str, DataFrame], key: str = "doi") -> DataFrame:
    """One row per key with a boolean column per state table."""
    tagged = reduce(
        DataFrame.unionByName,
        [df.select(key, F.lit(name).alias("_state")) for name, df in tables.items()],
    )
    flags = [F.bool_or(F.col("_state") == name).alias(name) for name in tables]
    return tagged.groupBy(key).agg(*flags)


# Pairs of states one key may not hold together.
FORBIDDEN_OVERLAPS = [
    ("queued", "review"), ("queued", "rejected"), ("review", "rejected"), ("review", "staged"),
    ("review", "canonical"), ("rejected", "staged"), ("rejected", "canonical"), ("staged", "canonical"),
]


def state_overlaps(membership: DataFrame, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """Rows ``(key, left_state, right_state)`` for every forbidden pair a key holds."""
    allowed = set(membership.columns)
    checks = [
        F.when(F.col(a) & F.col(b), F.struct(F.lit(a).alias("left_state"), F.lit(b).alias("right_state")))
        for a, b in (pairs or FORBIDDEN_OVERLAPS)
        if a in allowed and b in allowed
    ]
    key = membership.columns[0]
    return membership.select(key, F.explode(F.array_compact(F.array(*checks))).alias("p")).select(key, "p.*")
