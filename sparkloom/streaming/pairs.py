"""Starts and their ends by key, with a time limit: as a join of two streams, and exactly over tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.relational import as_of


def _start(rows: DataFrame) -> DataFrame:
    return rows.select("start_id", F.col("key").alias("start_key"), F.col("ts").cast("timestamp").alias("start_ts")).filter("start_ts is not null")


def _end(rows: DataFrame) -> DataFrame:
    return rows.select("end_id", F.col("key").alias("end_key"), F.col("ts").cast("timestamp").alias("end_ts")).filter("end_ts is not null and end_key is not null")


def answered(starts: DataFrame, ends: DataFrame, limit: int, late: int) -> DataFrame:
    """Streams starts(start_id, key, ts) and ends(end_id, key, ts) to (start_id, start_ts, end_id, end_ts): every end of the key not before the start nor more than `limit` seconds after it.

    A start without one comes out with nulls, once the watermark of both streams, `late` seconds behind the slower one's
    latest row, has passed its limit; its state, and that of ends, goes then. Rows behind the watermark are dropped.
    """
    a, b = _start(starts).withWatermark("start_ts", f"{late} seconds"), _end(ends).withWatermark("end_ts", f"{late} seconds")
    within = F.expr(f"end_key = start_key and end_ts >= start_ts and end_ts <= start_ts + interval {limit} seconds")
    return a.join(b, within, "left_outer").select("start_id", "start_ts", "end_id", "end_ts")


def first_answers(found: DataFrame) -> DataFrame:
    """Of rows of `answered` each start's first end; ties by the smaller id. Repeated rows make no difference."""
    first = F.min(F.when(F.col("end_ts").isNotNull(), F.struct("end_ts", "end_id"))).alias("e")
    return found.groupBy("start_id", "start_ts").agg(first).select("start_id", "start_ts", "e.end_id", "e.end_ts")


def paired(starts: DataFrame, ends: DataFrame, limit: int) -> DataFrame:
    """Tables starts(start_id, key, ts) and ends(end_id, key, ts) to each start's first end within `limit` seconds, nulls without one.

    An as-of join against reversed time, so that no key's starts meet all its ends, and a key with many rows is many
    tasks. Equal times count as in time; of ends at one time the smallest id counts. An end may answer several starts.
    Starts without a key have no end; rows without a time are left out; repeated starts come out once each.
    """

    def back(ts: str) -> F.Column:
        return F.timestamp_micros(-F.unix_micros(ts))

    once = _end(ends).groupBy("end_key", "end_ts").agg(F.min("end_id").alias("end_id"))
    right = once.select(F.col("end_key").alias("start_key"), back("end_ts").alias("t"), "end_id", "end_ts")
    found = as_of(_start(starts).withColumn("t", back("start_ts")), right, "start_key", "t", ["end_id", "end_ts"])
    intime = F.unix_micros("end_ts") - F.unix_micros("start_ts") <= limit * 1_000_000
    return found.select("start_id", "start_ts", *(F.when(intime, F.col(c)).alias(c) for c in ("end_id", "end_ts")))


def settled(starts: DataFrame, ends: DataFrame, limit: int, late: int) -> datetime | None:
    """Before this time all starts of the tables have their final rows in a stream: a second before the watermark that both have reached, less the limit. None if one is empty."""
    last = [rows.agg(F.max("ts").alias("t")).first().t for rows in (starts.select(F.col("ts").cast("timestamp_ntz").alias("ts")), ends.select(F.col("ts").cast("timestamp_ntz").alias("ts")))]
    return min(last) - timedelta(seconds=limit + late + 1) if None not in last else None


def left_open(pairs: DataFrame, starts: DataFrame) -> DataFrame:
    """The starts that have no end among `pairs`, an anti join: their ids."""
    return starts.select("start_id").join(pairs.filter("end_id is not null").select("start_id").distinct(), "start_id", "left_anti")
