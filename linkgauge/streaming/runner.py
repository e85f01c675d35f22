"""Running streams to the end of the available input.

Every runner takes ``path``, a folder below which rows and checkpoint are kept: called again with the same
path (after a restart, or when new files came) it goes on where it stopped. Batches write folders of their
own, so a repeated batch replaces its rows. Without a path a fresh one below the shared folder is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkgauge.operators.evaluation import latest_run
from linkgauge.session import scratch_path


def file_stream(
    spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*", fmt: str = "parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.schema(schema).format(fmt).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def run_updates(stream: DataFrame, keys: list[str], name: str = "stream", path: str | None = None) -> DataFrame:
    """Run a keyed aggregate in update mode to the end of the input; the last state per key.

    Every micro-batch writes its changed rows.
    """
    spark = stream.sparkSession
    base = path or scratch_path(spark, name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/_batch={number}")

    query = (
        stream.writeStream.outputMode("update").option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True).foreachBatch(keep).start()
    )
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])
    return latest_run(_batches(spark, schema, f"{base}/rows", "_batch"), keys, "_batch").drop("_batch")


def _batches(spark: SparkSession, schema: T.StructType, folder: str, column: str) -> DataFrame:
    """All rows of the batch folders; Spark skips folders that begin with an underscore, so they are named."""
    pattern = f"{folder}/{column}=*"
    rows = spark.read.schema(T.StructType([f for f in schema.fields if f.name != column])).parquet(pattern)
    number = F.regexp_extract(F.input_file_name(), f"/{column}=([0-9]+)/", 1).cast("int")
    return rows.withColumn(column, number)


def run_append(stream: DataFrame, name: str = "stream", path: str | None = None) -> DataFrame:
    """Run a stream of rows in append mode to the end of the input into a Parquet table.

    Windows and sessions come out when the watermark passes them; those still open are in the state: see
    ``open_state``.
    """
    spark = stream.sparkSession
    base = path or scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/rows")
        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def open_state(spark: SparkSession, path: str) -> DataFrame:
    """What a stateful stream holds after its last batch: key and value structs, read from its checkpoint.

    The stream and its input stay as they are: later rows still join what is open.
    """
    return spark.read.format("statestore").load(f"{path}/checkpoint")


def run_each_batch(stream: DataFrame, decide, schema: str, name: str = "decisions", path: str | None = None) -> DataFrame:
    """Apply a batch function to every micro-batch and keep its rows with the batch number."""
    spark = stream.sparkSession
    base = path or scratch_path(spark, name)

    def keep(batch: DataFrame, number: int) -> None:
        decide(batch).write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(
        keep).start().awaitTermination()
    return _batches(spark, spark.createDataFrame([], schema).schema, f"{base}/rows", "batch")


def inter_arrival_stream(stream: DataFrame, keys: list[str], time: str = "epoch") -> DataFrame:
    """Gap to the previous packet of the same key over all micro-batches, as column ``iat``.

    The state is the latest time of each key. A batch reads and writes the state of the keys it holds, nothing
    else. A packet older than the latest one seen gets 0, a packet without time NULL. The packets of one key in one micro-batch meet in a task; the number of files of a
    batch bounds them.
    """
    columns = stream.columns

    def gaps(key, frames, state):
        import pandas as pd

        frame = pd.concat(list(frames), ignore_index=True).sort_values(time, kind="stable")
        before = frame[time].cummax().shift()
        if state.exists:
            before = before.fillna(state.get[0]).clip(lower=state.get[0])
        frame["iat"] = (frame[time] - before).fillna(0.0).clip(lower=0.0).where(frame[time].notna())
        if frame[time].notna().any():
            latest = float(frame[time].max())
            state.update((max(latest, state.get[0]) if state.exists else latest,))
        yield frame[[*columns, "iat"]]

    schema = T.StructType([*stream.schema.fields, T.StructField("iat", T.DoubleType())])
    return stream.groupBy(*keys).applyInPandasWithState(gaps, schema, "latest double", "append", "NoTimeout")
