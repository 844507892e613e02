"""Null-safe equi-joins: null keys match each other (a null zone or time window is a group
like any other, as in a lookup keyed by the tuple of values)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_on(left: DataFrame, right: DataFrame, cols: list[str], right_prefix: str = "") -> F.Column:
    cond = None
    for c in cols:
        eq = left[c].eqNullSafe(right[f"{right_prefix}{c}"])
        cond = eq if cond is None else cond & eq
    return cond


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` treating null = null, with the key columns kept once (from ``left``)."""
    renamed = right.select(*[F.col(c).alias(f"r_{c}") for c in keys], *[c for c in right.columns if c not in keys])
    return left.join(renamed, null_safe_on(left, renamed, keys, "r_"), how).drop(*[f"r_{c}" for c in keys])
