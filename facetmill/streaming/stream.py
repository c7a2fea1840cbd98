"""Incremental loads: file streams that remember what they have seen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, path: str, schema: str, format: str = "json", files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def first_occurrences(stream: DataFrame, keys: Sequence[str], time: str | None = None, delay: str | None = None) -> DataFrame:
    """The first row of each key. With a time and a delay, state older than the watermark is dropped."""
    if time and delay:
        return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))
    return stream.dropDuplicates(list(keys))


def load_available(stream: DataFrame, path: str, checkpoint: str, format: str = "parquet") -> StreamingQuery:
    """Appends all that has arrived since the last run, then stops: a run without new files adds nothing."""
    return stream.writeStream.format(format).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def replace_sources(stream: DataFrame, path: str, checkpoint: str, key: str) -> StreamingQuery:
    """Each batch replaces the partitions of the sources that it holds, so a repeated batch changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        batch.withColumn("_source", F.col(key)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_source").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pending(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs without an output yet: a batch that was stopped goes on with these."""
    return inputs.join(done.select(key), key, "left_anti")
