"""Contributions of features to predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgauge.operators.ordering import hash_digits, hash_key, hash_rank
from linkgauge.session import materialize


def univariate_slopes(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Least-squares slope of the target on each feature and the feature's mean, one pass."""
    wide = df.agg(*[e for i, c in enumerate(features) for e in (
        F.regr_slope(F.col(target), F.col(c).cast("double")).alias(f"w{i}"), F.avg(c).alias(f"m{i}"))])
    entries = [
        F.struct(F.lit(c).alias("feature"), F.col(f"w{i}").alias("weight"), F.col(f"m{i}").alias("mean"))
        for i, c in enumerate(features)
    ]
    return wide.select(F.inline(F.array(*entries)))


def linear_attributions(df: DataFrame, id_columns: list[str], weights: dict[str, float]) -> DataFrame:
    """Exact contribution of each feature under a linear model: weight * (value - mean)."""
    means = df.agg(*[F.avg(c).alias(c) for c in weights])
    entries = [
        F.struct(F.lit(c).alias("feature"),
                 (F.lit(float(w)) * (F.col(c) - means.select(c).scalar())).alias("contribution"))
        for c, w in weights.items()
    ]
    return df.select(*id_columns, F.inline(F.array(*entries)))


def mean_abs_attribution(df: DataFrame, weights: DataFrame, features: list[str]) -> DataFrame:
    """Mean absolute contribution per feature, side by side in one aggregation.

    ``weights`` has feature, weight and mean, one row per feature.
    """
    facts = weights.agg(*[
        F.max(F.when(F.col("feature") == c, F.col(part))).alias(f"{part}{i}")
        for i, c in enumerate(features) for part in ("weight", "mean")
    ])
    wide = df.agg(*[
        F.avg(F.abs(facts.select(f"weight{i}").scalar() * (F.col(c) - facts.select(f"mean{i}").scalar()))).alias(f"a{i}")
        for i, c in enumerate(features)
    ])
    entries = [F.struct(F.lit(c).alias("feature"), F.col(f"a{i}").alias("mean_abs")) for i, c in enumerate(features)]
    return wide.select(F.inline(F.array(*entries)))


def permute_column(df: DataFrame, id_columns: list[str], column: str, seed: int = 42) -> DataFrame:
    """The table with one column's values dealt to other rows: an exact permutation by hash rank."""
    # keys as bytes are half as long in the shuffles and have the same order; a byte is two hex digits of a bucket
    key = lambda n: F.unhex(hash_key(n, *id_columns))
    prefix = (hash_digits(df) + 1) // 2
    left = hash_rank(df.withColumn("_key", key(seed)), "_key", prefix=prefix, name="_rank").drop("_key", column)
    values = df.select(key(seed + 1).alias("_key"), F.col(column))
    right = hash_rank(values, "_key", prefix=prefix, name="_rank").drop("_key")
    return left.join(right, "_rank").drop("_rank").select(*df.columns)


def permutation_importance(df: DataFrame, predict, target: str, features: list[str], id_columns: list[str],
                           seed: int = 42) -> DataFrame:
    """Rise of the squared error when a feature's values are permuted, for any fitted model.

    The table is written once: each feature reads it several times.
    """
    df = materialize(df, "permuted")
    error = F.avg(F.pow(F.col("y_pred") - F.col(target), F.lit(2)))
    base = predict(df).agg(error).scalar()
    rows = [
        predict(permute_column(df, id_columns, c, seed + i)).agg((error).alias("permuted")).select(
            F.lit(c).alias("feature"), (F.col("permuted") - base).alias("importance"))
        for i, c in enumerate(features)
    ]
    return reduce(DataFrame.unionByName, rows)
