"""Samples, hold-outs and folds, all reproducible from a row key and a seed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgauge.operators.ordering import hash_key, hash_rank, hash_take, hash_unit


def quota_sample(df: DataFrame, by: str, id_columns: list[str], n: int, seed: int = 42, prefix: int | None = None) -> DataFrame:
    """``max(1, n // groups)`` rows per group (per file), picked in hash order over the whole group."""
    groups = df.select(by).distinct().agg(F.count("*").alias("groups"))
    quota = F.greatest(F.lit(1), F.floor(F.lit(n) / groups.scalar()))
    keyed = df.withColumn("_key", hash_key(seed, *id_columns))
    return hash_take(keyed, "_key", quota, [by], prefix).drop("_key")


def sample_rows(df: DataFrame, id_columns: list[str], n: int, seed: int = 42, prefix: int | None = None) -> DataFrame:
    """Exactly ``n`` rows, or all rows when there are fewer."""
    keyed = df.withColumn("_key", hash_key(seed, *id_columns))
    return hash_take(keyed, "_key", F.lit(n), prefix=prefix).drop("_key")


def train_test_split(
    df: DataFrame, id_columns: list[str], test_size: float = 0.2, seed: int = 42, exact: bool = False, prefix: int | None = None
) -> DataFrame:
    """Add ``is_test``. By default a row decides alone from its hash and no data moves.

    ``exact`` puts exactly ceil(n * test_size) rows into the test part, at the price of a shuffle.
    """
    keyed = df.withColumn("_key", hash_key(seed, *id_columns))
    if not exact:
        return keyed.withColumn("is_test", hash_unit(F.col("_key")) < test_size).drop("_key")
    size = df.agg(F.ceil(F.count("*") * F.lit(test_size)).alias("size"))
    ranked = hash_rank(keyed, "_key", prefix=prefix, name="_rank")
    return ranked.withColumn("is_test", F.col("_rank") <= size.scalar()).drop("_key", "_rank")


def validation_split(df: DataFrame, id_columns: list[str], val_size: float = 0.1, seed: int = 42) -> DataFrame:
    """Split the training rows once more: adds ``part`` = test, validation or train."""
    outer = train_test_split(df, id_columns, seed=seed)
    unit = hash_unit(hash_key(seed + 1, *id_columns))
    part = F.when(F.col("is_test"), "test").when(unit < val_size, "validation").otherwise("train")
    return outer.withColumn("part", part).drop("is_test")


def kfold(
    df: DataFrame, id_columns: list[str], k: int = 5, seed: int = 42, exact: bool = False, prefix: int | None = None
) -> DataFrame:
    """Add ``fold`` 0..k-1; k of 1 or less turns folding off (NULL fold).

    ``exact`` makes fold sizes differ by at most one row.
    """
    if k <= 1:
        return df.withColumn("fold", F.lit(None).cast("int"))
    if df.limit(k).count() < k:
        raise ValueError(f"{k} folds need at least {k} rows")
    keyed = df.withColumn("_key", hash_key(seed, *id_columns))
    if exact:
        ranked = hash_rank(keyed, "_key", prefix=prefix, name="_rank")
        return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_key", "_rank")
    return keyed.withColumn("fold", F.floor(hash_unit(F.col("_key")) * k).cast("int")).drop("_key")


def stratified_kfold(
    df: DataFrame, label: str, id_columns: list[str], k: int = 5, seed: int = 42, prefix: int | None = None
) -> DataFrame:
    """Folds with the same share of every label, exact per label; a missing label is a label."""
    keyed = df.withColumn("_key", hash_key(seed, *id_columns))
    ranked = hash_rank(keyed, "_key", [label], prefix, "_rank")
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_key", "_rank")


def training_rows(df: DataFrame, fold: int) -> DataFrame:
    """All rows outside one fold."""
    return df.filter(F.col("fold") != fold)
