"""Joins on grouping columns whose NULLs are a group of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """As ``left.join(right, keys, how)``, but NULL keys meet; ``how`` is inner or left."""
    if not keys:
        return left.join(right, how="cross" if how == "inner" else how)
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = None
    for k in keys:
        same = left[k].eqNullSafe(named[f"_right_{k}"])
        condition = same if condition is None else condition & same
    return left.join(named, condition, how).drop(*[f"_right_{k}" for k in keys])
