"""Paired comparison of two models over the same folds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _t_two_sided():
    @F.pandas_udf("double")
    def p_value(t: pd.Series, df: pd.Series) -> pd.Series:
        import math

        def beta_fraction(a, b, x):
            # modified Lentz evaluation of the continued fraction of the incomplete beta function
            tiny = 1e-300
            c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
            d = 1.0 / (d if abs(d) > tiny else tiny)
            value = d
            for m in range(1, 400):
                for step in (
                    m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
                ):
                    d = 1.0 + step * d
                    c = 1.0 + step / c
                    d = 1.0 / (d if abs(d) > tiny else tiny)
                    c = c if abs(c) > tiny else tiny
                    value *= d * c
                if abs(d * c - 1.0) < 1e-15:
                    break
            return value

        def incomplete_beta(a, b, x):
            if x <= 0.0:
                return 0.0
            if x >= 1.0:
                return 1.0
            front = math.exp(
                math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
            )
            if x < (a + 1.0) / (a + b + 2.0):
                return front * beta_fraction(a, b, x) / a
            return 1.0 - front * beta_fraction(b, a, 1.0 - x) / b

        out = []
        for value, free in zip(t, df):
            if pd.isna(value) or free <= 0:
                out.append(None)
            else:
                out.append(incomplete_beta(free / 2.0, 0.5, free / (free + value * value)))
        return pd.Series(out, dtype="float64")

    return p_value


def _signed_rank(method: str):
    @F.pandas_udf("double")
    def p_value(w: pd.Series, n: pd.Series, tie_term: pd.Series, doubled: pd.Series) -> pd.Series:
        import math
        from fractions import Fraction

        out = []
        for smaller, pairs, ties, ranks in zip(w, n, tie_term, doubled):
            pairs = int(pairs)
            if pairs == 0:
                out.append(1.0)
            elif method == "exact":  # all sign patterns of the ranks, ties sharing their mean rank (doubled: whole)
                ways = [1]
                for rank in map(int, ranks):
                    grown = ways + [0] * rank
                    for i, count in enumerate(ways):
                        grown[i + rank] += count
                    ways = grown
                out.append(min(1.0, float(Fraction(2 * sum(ways[: int(2 * smaller) + 1]), 2**pairs))))
            else:
                mean = pairs * (pairs + 1) / 4.0
                variance = pairs * (pairs + 1) * (2 * pairs + 1) / 24.0 - ties / 48.0
                z = (smaller - mean) / math.sqrt(variance)
                out.append(math.erfc(abs(z) / math.sqrt(2.0)))
        return pd.Series(out, dtype="float64")

    return p_value


def pair_folds(scores: DataFrame, first: str, second: str) -> DataFrame:
    """Scores of two models side by side by fold; both must have the same folds."""
    side = lambda model, name: scores.filter(F.col("model") == model).select("fold", F.col("score").alias(name))
    paired = side(first, "first").join(side(second, "second"), "fold", "full")
    problem = F.raise_error(F.lit("fold indices of the two models do not match"))
    complete = F.col("first").isNotNull() & F.col("second").isNotNull()
    return paired.select(
        "fold",
        F.when(complete, F.col("first")).otherwise(problem.cast("double")).alias("first"),
        F.when(complete, F.col("second")).otherwise(problem.cast("double")).alias("second"),
    )


def paired_statistics(paired: DataFrame) -> DataFrame:
    """Means, sample deviations, paired t statistic and the signed-rank sums; one row."""
    return _statistics(paired).drop("doubled_ranks")


def _statistics(paired: DataFrame) -> DataFrame:
    """As ``paired_statistics``, with the ranks (doubled: whole numbers) of all nonzero differences."""
    gap = paired.withColumn("d", F.col("first") - F.col("second"))
    basic = gap.agg(
        F.count("*").alias("folds"), F.avg("first").alias("first_mean"), F.stddev_samp("first").alias("first_std"),
        F.avg("second").alias("second_mean"), F.stddev_samp("second").alias("second_std"),
        F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("diff_std"),
        F.count_if(F.col("d") == 0).alias("zero_diffs"),
    )
    t = F.try_divide(F.col("mean_diff"), F.col("diff_std") / F.sqrt(F.col("folds").cast("double")))
    # one row per distinct |difference|: its average rank serves all tied folds
    sizes = gap.filter(F.col("d") != 0).groupBy(F.abs("d").alias("size")).agg(
        F.count("*").alias("ties"), F.count_if(F.col("d") > 0).alias("plus"), F.count_if(F.col("d") < 0).alias("minus")
    )
    before = F.sum("ties").over(Window.partitionBy(F.lit(0)).orderBy("size")) - F.col("ties")
    ranks = sizes.withColumn("rank", before + (F.col("ties") + 1) / 2).agg(
        F.coalesce(F.sum("ties"), F.lit(0)).alias("pairs"),
        F.coalesce(F.sum(F.col("rank") * F.col("plus")), F.lit(0.0)).alias("w_plus"),
        F.coalesce(F.sum(F.col("rank") * F.col("minus")), F.lit(0.0)).alias("w_minus"),
        F.coalesce(F.sum(F.pow("ties", F.lit(3)) - F.col("ties")), F.lit(0.0)).alias("tie_term"),
        # one whole number per fold
        F.flatten(F.collect_list(F.array_repeat((2 * F.col("rank")).cast("int"), F.col("ties").cast("int")))).alias("doubled_ranks"),
    )
    one = lambda name: ranks.select(name).scalar().alias(name)
    return basic.select("*", t.alias("t"), one("pairs"), one("w_plus"), one("w_minus"), one("tie_term"), one("doubled_ranks"))


def paired_compare(scores: DataFrame, first: str, second: str, alpha: float = 0.05, method: str = "exact") -> DataFrame:
    """Paired t test and Wilcoxon signed-rank test of two models' fold scores.

    ``method`` is how the signed-rank p-value comes about, whatever the number of folds: "exact" counts
    all sign patterns (time grows with folds cubed; ties share their mean rank, zeros are left out),
    "normal" approximates.

    ``scores`` has model, fold and score. Only one aggregated row reaches the small p-value helpers.
    """
    if method not in ("exact", "normal"):
        raise ValueError(f"unknown method {method}")
    stats = _statistics(pair_folds(scores, first, second))
    t_p = _t_two_sided()(F.col("t"), (F.col("folds") - 1).cast("double"))
    w_p = _signed_rank(method)(F.least("w_plus", "w_minus"), F.col("pairs"), F.col("tie_term"), F.col("doubled_ranks"))
    tested = stats.withColumns({"paired_ttest_p": t_p, "wilcoxon_p": w_p})
    t_sig, w_sig = F.coalesce(F.col("paired_ttest_p") < alpha, F.lit(False)), F.col("wilcoxon_p") < alpha
    conclusion = (
        F.when(t_sig & w_sig, F.lit("meaningful_difference")).when(t_sig | w_sig, F.lit("tests_disagree"))
        .otherwise(F.lit("no_meaningful_difference"))
    )
    return tested.select(
        F.lit(f"{first}_vs_{second}").alias("comparison"), F.col("folds").alias("cv_folds"),
        "first_mean", "first_std", "second_mean", "second_std", "mean_diff", "t", "paired_ttest_p",
        t_sig.alias("paired_ttest_significant"), F.least("w_plus", "w_minus").alias("w"), "wilcoxon_p", F.lit(method).alias("wilcoxon_method"),
        w_sig.alias("wilcoxon_significant"), (t_sig == w_sig).alias("tests_agree"),
        conclusion.alias("practical_conclusion"),
    )
