"""Evaluation stages inside one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def stage(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated once, however often later expressions use them.

    Plain projections are merged by the optimiser, and a filter pushed below one carries its
    whole expression along, even into array lambdas. A one-row generator is never merged; it
    adds no shuffle and stays in the JVM.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline_outer(F.array(row)))


def let(value: Column, use) -> Column:
    """``use`` of ``value``, evaluated once: inside one expression what ``stage`` is for a plan. Unlike a stage it is skipped where a condition excludes it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
