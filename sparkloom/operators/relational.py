"""Relational operators that Spark has no single call for, composed of DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.sources.tables import materialize


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order. Aggregates on the map side, so a key with very many rows is reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order))))
    return df.groupBy(*keys).agg(best.alias("__row")).select(*keys, "__row.*")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key. Spark cuts each map task's groups to n before the shuffle (window group limit)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def share_of_group(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Adds each row's share of its key's sum, by a join with the sums.

    The sums are written first: with the aggregate in the join's own stage Spark could not split a hot key's partition.
    """
    sums = materialize(df.groupBy(*keys).agg(F.sum(value).alias("__sum")), "sums")
    return df.join(sums, keys).withColumn(name, F.col(value) / F.col("__sum")).drop("__sum")


def _micros(time: str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp"))


def _day(time: str) -> Column:
    return F.floor(_micros(time) / 86_400_000_000).alias("__day")


def gaps(df: DataFrame, key: str, time: str, seconds: int) -> DataFrame:
    """Numbers the sessions of each key: a session ends where more than `seconds` pass without a row. Ties keep one session.

    Rows are sorted by key and day, not by key alone, so that a key with a third of all rows is many tasks; a
    second window over one row for each key and day carries last time and number of sessions over.
    """
    rows = df.withColumn("__day", _day(time)).withColumn("__t", _micros(time))
    own = Window.partitionBy(key, "__day").orderBy("__t")
    rows = rows.withColumn("__new", F.coalesce((F.col("__t") - F.lag("__t").over(own) > seconds * 1_000_000).cast("int"), F.lit(0)))
    days = rows.groupBy(key, "__day").agg(F.min("__t").alias("__first"), F.max("__t").alias("__last"), F.sum("__new").alias("__more"))
    along = Window.partitionBy(key).orderBy("__day")
    opens = F.coalesce((F.col("__first") - F.lag("__last").over(along) > seconds * 1_000_000).cast("int"), F.lit(1))
    days = days.withColumn("__opens", opens)
    before = F.sum(F.col("__opens") + F.col("__more")).over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__more")
    days = days.select(key, "__day", before.alias("__before"))
    rows = rows.withColumn("__within", F.sum("__new").over(own.rangeBetween(Window.unboundedPreceding, 0)))
    match = rows[key].eqNullSafe(days[key]) & rows["__day"].eqNullSafe(days["__day"])
    return rows.join(days, match).select(*(rows[c] for c in df.columns), (F.col("__before") + F.col("__within")).alias("session"))


def elapsed(df: DataFrame, key: str, time: str, tie: str, name: str) -> DataFrame:
    """Adds the seconds since the row before of the same key, by time and then `tie`; null for a key's first row.

    Rows are sorted by key and day; the last time of earlier days, a row for each key and day, is carried over.
    """
    rows = df.withColumn("__day", _day(time)).withColumn("__t", _micros(time))
    before = Window.partitionBy(key).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy(key, "__day").agg(F.max("__t").alias("__last")).select(key, "__day", F.max("__last").over(before).alias("__carried"))
    rows = rows.withColumn("__before", F.lag("__t").over(Window.partitionBy(key, "__day").orderBy("__t", tie)))
    match = rows[key].eqNullSafe(days[key]) & rows["__day"].eqNullSafe(days["__day"])
    seconds = (F.col("__t") - F.coalesce("__before", "__carried")) / 1e6
    return rows.join(days, match).select(*(rows[c] for c in df.columns), seconds.alias(name))


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, columns: list[str]) -> DataFrame:
    """Each left row with the right columns of the last right row of its key at or before its time.

    One union and a running last value within each key and day, in place of a range join; each day's last right
    row, one row for a key and day, is carried over to later days. No task gets a whole key.
    """
    rows = left.withColumn("__left", F.lit(True)).unionByName(right.select(key, time, F.lit(False).alias("__left"), F.struct(*columns).alias("__right")), allowMissingColumns=True).withColumn("__day", _day(time))
    latest_first = F.max_by("__right", F.when(~F.col("__left"), F.col(time))).alias("__own")
    along = Window.partitionBy(key).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy(key, "__day").agg(latest_first).select(key, "__day", F.last("__own", ignorenulls=True).over(along).alias("__carried"))
    own = Window.partitionBy(key, "__day").orderBy(F.col(time), F.col("__left")).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("__found", F.last("__right", ignorenulls=True).over(own)).filter("__left")
    match = found[key].eqNullSafe(days[key]) & found["__day"].eqNullSafe(days["__day"])
    out = found.join(days, match).withColumn("__found", F.coalesce("__found", "__carried"))
    return out.select(*(found[c] for c in left.columns), *(F.col("__found").getField(c).alias(c) for c in columns))


def ordered_text(df: DataFrame, key: str, order: str, text: str, between: str, count: str, name: str, span: int = 1024) -> DataFrame:
    """Per key: the number of rows, and their texts by `order` (ties by text), joined by `between`; null texts are left out, as by concat_ws.

    Ranges of `span` values of `order` are joined first, on the map side where they can be, and then the ranges' texts
    in their order: what one task sorts is a range, and then one text for each range.
    """
    rows = df.select(key, F.floor(F.col(order) / span).alias("__range"), F.struct(F.col(order).alias("o"), F.col(text).alias("t")).alias("__row"))
    parts = rows.groupBy(key, "__range").agg(F.count("*").alias("__n"), F.array_join(F.transform(F.array_sort(F.collect_list("__row")), lambda x: x["t"]), between).alias("t"), F.count("__row.t").alias("__texts"))
    part = F.when(F.col("__texts") > 0, F.struct(F.col("__range").alias("o"), F.col("t")))  # a range of nulls alone adds nothing
    return parts.groupBy(key).agg(F.sum("__n").alias(count), F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), between).alias(name))


def missing(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Rows of left whose key right does not have."""
    return left.join(right.select(on).distinct(), on, "left_anti")
