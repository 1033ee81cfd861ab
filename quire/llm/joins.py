"""Joins used by several operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def meet(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where null equals null; the keys of ``left`` stay."""
    renamed = right.select(*[F.col(c).alias(f"_right_{c}") if c in keys else F.col(c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys])
    out = left.join(renamed, same, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_right_{k}" for k in keys])


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most so many rows; without one beyond."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
