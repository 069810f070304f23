"""Streams of passages: running counts, windows over event time, and the batch transforms for each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lexmill.functions import text
from lexmill.session import new_folder


def passages(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 16, glob: str | None = None) -> DataFrame:
    """Files of a folder as they come, those whose name matches ``glob`` if that is given."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)


def table(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    """The files of a table as they come, be it one file or a folder of files.

    A stream takes a bare path for a folder. A pattern is looked up first, and may name either: the last letter stands in brackets.
    """
    path = path.rstrip("/")
    return passages(spark, f"{path[:-1]}[{path[-1]}]", schema, files_per_trigger)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """The result of an aggregated stream over all that is there now, from the shared folder: each micro-batch replaces it."""
    spark = stream.sparkSession
    at = new_folder(spark, name)

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/result")

    writer = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{at}/checkpoint").foreachBatch(replace)
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/result")


def running_counts(stream: DataFrame, text_col: str = "content") -> DataFrame:
    """(lemma, n) of words of three letters or more so far; run it in update mode."""
    words = stream.select(F.explode(text.tokens(F.col(text_col))).alias("lemma")).filter(F.length("lemma") >= 3)
    return words.groupBy("lemma").agg(F.count("*").alias("n"))


def windowed_counts(stream: DataFrame, time_col: str = "ingested_at", lateness: str = "10 days", window: str = "1 day") -> DataFrame:
    """(start, n_passages, n_chars) of each window of event time; rows later than ``lateness`` are left out."""
    timed = stream.withColumn("_at", F.col(time_col).cast("timestamp")).withWatermark("_at", lateness)
    grouped = timed.groupBy(F.window("_at", window)).agg(F.count("*").alias("n_passages"), F.sum(F.length("content")).alias("n_chars"))
    return grouped.select(F.col("window.start").alias("start"), "n_passages", "n_chars")


def first_deliveries(stream: DataFrame, key_col: str = "textbook_studio_passage_id", time_col: str = "ingested_at", lateness: str = "10 days") -> DataFrame:
    """Rows whose key was not seen within ``lateness`` of event time."""
    timed = stream.withColumn("_at", F.col(time_col).cast("timestamp")).withWatermark("_at", lateness)
    return timed.dropDuplicatesWithinWatermark([key_col]).drop("_at")


def each_batch(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Apply a batch transform to each micro-batch and write it under its number: a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()
