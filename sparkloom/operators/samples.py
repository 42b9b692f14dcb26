"""Bounded samples of groups, and sets compared by digests: what a group's state holds does not grow with the group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.relational import top_per_group


def counted_sample(df: DataFrame, keys: list[str], order: list[Column], columns: list[str], n: int, name: str = "sample") -> DataFrame:
    """Per key: n_rows, and an array of the first n rows (structs of `columns`) in the given order, ties by the columns themselves.

    Each task keeps n rows of a key before the shuffle (window group limit), and what is gathered into the array is
    those that are left: no task holds a group, however large. Nulls in keys are a key of their own, as in groupBy.
    """
    first = top_per_group(df, keys, [*order, *(F.col(c) for c in columns)], n)
    arrays = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", F.struct(*columns).alias("r")))).alias("__rows"))
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    match = None
    for k in keys:
        same = sizes[k].eqNullSafe(arrays[k])
        match = same if match is None else match & same
    return sizes.join(arrays, match).select(*(sizes[k] for k in keys), "n_rows", F.col("__rows.r").alias(name))


def set_digests(df: DataFrame, keys: list[str], members: list[str]) -> DataFrame:
    """Per key: n_members (different ones) and digest, the same for two keys just where they have the same set of members.

    Members are made different first, on the map side as far as may be; then a key's state is three numbers, whatever the
    size of its set: their count, the xor of a 64-bit hash and the sum of another. Order and repeats make no difference.
    A row with a null member counts with it as a member. Different sets have equal digests with a chance of about 2**-128.
    """
    once = df.select(*keys, *members).distinct()
    value = F.to_json(F.struct(*members), {"ignoreNullFields": "false"})
    hashes = once.select(*keys, F.xxhash64(value).alias("a"), F.xxhash64(F.lit("second"), F.reverse(value)).alias("b"))
    found = hashes.groupBy(*keys).agg(F.count("*").alias("n_members"), F.bit_xor("a").alias("x"), F.sum(F.col("b").cast("decimal(38,0)")).alias("s"))
    return found.select(*keys, "n_members", F.concat_ws(":", "n_members", "x", "s").alias("digest"))


def equal_sets(df: DataFrame, keys: list[str], members: list[str], name: str) -> DataFrame:
    """Per set that occurs: digest, n_members, the number of keys that have it (n_keys), and the first of them, as a struct."""
    return set_digests(df, keys, members).groupBy("digest", "n_members").agg(F.count("*").alias("n_keys"), F.min(F.struct(*keys)).alias(name))


def largest_share(df: DataFrame, keys: list[str], most: float) -> DataFrame:
    """The keys that hold more than `most` of all rows: keys, n_rows, share. At most 1 / most of them; counts are summed on the map side."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    total = counts.agg(F.sum("n_rows")).first()[0] or 0
    return counts.filter(F.col("n_rows") > most * total).select(*keys, "n_rows", (F.col("n_rows") / total if total else F.lit(None).cast("double")).alias("share"))
