"""Writing tables and appending report rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet") -> None:
    """Replace a table; a partitioned write keeps one folder per value."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def append_report(df: DataFrame, path: str) -> None:
    """Append report rows stamped with the time of the run, to the second."""
    stamped = df if "run_timestamp" in df.columns else df.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("run_timestamp"), "*"
    )
    stamped.write.mode("append").parquet(path)
