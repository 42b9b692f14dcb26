"""Structured Streaming over event tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources.tables import run_folder

_NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files, or one such file, as a stream, with the files' own schema."""
    schema = spark.read.parquet(path).schema
    path = path.rstrip("/")
    path = f"{path[:-1]}[{path[-1]}]"  # a pattern that fits this name alone: only a pattern may stand for a file
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def counts_by_window(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their values by type and window of event time; rows later than `late` are dropped with their windows' state."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def first_seen(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event id once, within the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else timed.dropDuplicates(["event_id"])


def available(stream: DataFrame, name: str, after: bool = True) -> DataFrame:
    """Runs an appending stream over what its source has now, into a table in the shared folder, and gives that table.

    after: once the source is read, batches without data follow while the watermark moves. Folds by processing time
    would ask for such batches for ever, and need none. The checkpoint lies beside the table, so that a lost
    executor's tasks, state included, start again from there.
    """
    spark = stream.sparkSession
    path = f"{run_folder(spark)}/sparkloom-{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True)
    was = spark.conf.get(_NO_DATA)
    try:
        spark.conf.set(_NO_DATA, str(after).lower())  # a stream keeps the settings that it starts with
        run = writer.start()
    finally:
        spark.conf.set(_NO_DATA, was)
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows") if run.lastProgress else spark.createDataFrame([], stream.schema)
