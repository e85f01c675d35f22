"""Registry of queries and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL where SQL can say the same."""

    def add(build):
        def run(spark, sf_dir):
            from linkgauge.session import configure

            return build(configure(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All floating columns rounded, so that two engines' last bits do not matter."""
    return df.select(*[
        F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        else F.col(f.name) for f in df.schema.fields
    ])


def r(*names: str, digits: int = 6) -> str:
    """SQL select items: the given columns rounded under their own names."""
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)
