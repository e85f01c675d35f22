"""Number helpers with one missing marker: NULL in, NULL out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INFINITY = float("inf")

# Texts that a delimited file means as "missing".
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

FLOATING = (T.DoubleType, T.FloatType)


def number(col: Column) -> Column:
    """Try every value as a double; what is not a number becomes NULL."""
    return col.try_cast("double")


# A whole text that is a number: no suffixes such as 1d or 1f, which a cast would take
NUMBER_PATTERN = r"^\s*[-+]?(?:[0-9]+\.?[0-9]*(?:[eE][-+]?[0-9]+)?|\.[0-9]+(?:[eE][-+]?[0-9]+)?|(?i:inf|infinity|nan))\s*$"


def number_in_text(col: Column) -> Column:
    """As ``number`` for text: only texts that are a number as a whole."""
    return F.when(col.rlike(NUMBER_PATTERN), col.try_cast("double"))


def number_of(df, name: str) -> Column:
    """The column as a double, by the strict pattern where it is text."""
    col = F.col(name)
    return number_in_text(col) if df.schema[name].dataType == T.StringType() else number(col)


def parsed_once(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` with the text columns among ``names`` as doubles (see ``number_in_text``), each text parsed once a row.

    Catalyst moves filters below a projection and would parse a text again wherever its number is used; what a
    generator gives is made before them.
    """
    texts = [c for c in names if df.schema[c].dataType == T.StringType()]
    if not texts:
        return df
    parsed = F.struct(*[number_in_text(F.col(f"`{c}`")).alias(c) for c in texts])
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in texts], F.inline(F.array(parsed)))


def whole(value: Column) -> Column:
    """A double without a fraction as a bigint, else NULL: ``80.0`` is 80, ``80.5`` is missing."""
    return F.when(value == F.floor(value), value.try_cast("bigint"))


def is_infinite(col: Column) -> Column:
    return F.abs(col) == F.lit(INFINITY)


def finite(col: Column) -> Column:
    """NaN and both infinities become NULL."""
    return F.when(~F.isnan(col) & ~is_infinite(col), col)


def clip(col: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound a value and keep missing as missing (bare greatest/least skip NULL)."""
    bounded = col
    if low is not None:
        bounded = F.greatest(bounded, F.lit(float(low)))
    if high is not None:
        bounded = F.least(bounded, F.lit(float(high)))
    return F.when(col.isNotNull(), bounded)


def percent_of(part: Column, whole: Column) -> Column:
    """part / whole in percent, bounded to 0..100. x/0 counts as infinite, 0/0 is missing."""
    return (
        F.when((whole == 0) & (part > 0), F.lit(100.0))
        .when((whole == 0) & (part < 0), F.lit(0.0))
        .when(whole == 0, F.lit(None).cast("double"))
        .otherwise(clip(F.try_divide(part, whole) * 100, 0, 100))
    )


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0 where the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def log_target(col: Column) -> Column:
    """Natural log with a floor of 1e-9, so zero delays stay finite."""
    return F.ln(clip(col, low=1e-9))


def delay_ms(log_seconds: Column) -> Column:
    """Back from log seconds to milliseconds."""
    return F.exp(log_seconds) * 1000


def loss_rate(sent: Column, dropped: Column) -> Column:
    """dropped / (sent + dropped), 0 when no packet was seen."""
    total = sent + dropped
    return F.when(total > 0, dropped / F.when(total > 0, total)).otherwise(F.lit(0.0))
