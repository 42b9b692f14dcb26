"""Day-split windows and joins with written sums against plain windows; hot keys' partitions are split."""

import datetime
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.operators.relational import as_of, gaps, ordered_text, share_of_group
from sparkloom.sources.tables import discard, drop_run, materialize, run_folder, shared_folder


def rows(n=600):
    rng = random.Random(1)
    start = datetime.datetime(1999, 12, 30)
    return [(rng.choice([1, 1, 1, 2, None]), start + datetime.timedelta(seconds=rng.randrange(0, 6 * 86400, 600)), i) for i in range(n)]


def test_gaps_across_days(spark):
    df = spark.createDataFrame(rows(), "k int, t timestamp_ntz, i int")
    along = Window.partitionBy("k").orderBy("t")
    micros = F.unix_micros(F.col("t").cast("timestamp"))
    want = df.withColumn("new", F.coalesce((micros - F.lag(micros).over(along) > 1800 * 1_000_000).cast("int"), F.lit(1)))
    want = want.withColumn("session", F.sum("new").over(along.rangeBetween(Window.unboundedPreceding, 0))).drop("new")
    assert sorted(map(str, gaps(df, "k", "t", 1800).collect())) == sorted(map(str, want.collect()))
    assert gaps(df.limit(0), "k", "t", 1800).count() == 0


def test_as_of_across_days(spark):
    every = rows()
    left = spark.createDataFrame([r for r in every if r[2] % 3 == 0], "k int, t timestamp_ntz, i int")
    right = spark.createDataFrame([(k, t, i) for k, t, i in {(r[0], r[1]): r for r in every if r[2] % 5 == 0}.values()], "k int, t timestamp_ntz, v int")
    seen = [tuple(r) for r in right.collect()]
    want = []
    for k, t, i in (r for r in every if r[2] % 3 == 0):
        found = [(u, v) for m, u, v in seen if m == k and u <= t]
        want.append((k, t, i, max(found)[1] if found else None))
    assert sorted(map(str, map(tuple, as_of(left, right, "k", "t", ["v"]).collect()))) == sorted(map(str, want))


def test_ordered_text(spark):
    df = spark.createDataFrame([(1, t, None if t == 7 else chr(97 + t % 26)) for t in range(40)] + [(2, 5, None), (3, -1, "z"), (3, -1, "y"), (3, 2, "")], "k int, t long, s string")
    got = {r.k: (r.n, r.s) for r in ordered_text(df, "k", "t", "s", ">", "n", "s", span=4).collect()}
    assert got == {1: (40, ">".join(chr(97 + t % 26) for t in range(40) if t != 7)), 2: (1, ""), 3: (3, "y>z>")}


def test_a_hot_key_is_split(spark, tmp_path):
    """With the sums written first, Spark splits the hot key's partition in the join."""
    spark.range(200_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(F.lit(-1)).alias("k"), F.col("id").cast("double").alias("v"), F.repeat(F.lit("x"), 50).alias("pad")).repartition(8).write.parquet(str(tmp_path / "t"))
    keys = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        out = share_of_group(spark.read.parquet(str(tmp_path / "t")), ["k"], "v", "share")
        assert len(out.collect()) == 200_000
        assert "skewed" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_written_tables(spark, tmp_path, monkeypatch):
    df = materialize(spark.range(5).toDF("id"), "five")
    path = df.inputFiles()[0]
    assert df.count() == 5
    import os
    from urllib.parse import urlparse

    assert os.path.exists(urlparse(path).path)
    discard(df, spark.range(3))
    assert not os.path.exists(urlparse(path).path)

    class Conf:
        def __init__(self, **values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Session:
        pass

    session = Session()
    session.conf = Conf(**{"spark.master": "yarn"})
    with pytest.raises(ValueError):
        shared_folder(session)
    session.conf = Conf(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs://x/y/"})
    assert shared_folder(session) == "hdfs://x/y"


def test_a_run_can_be_dropped(spark, monkeypatch):
    """All that a process has written lies in one folder, which goes at once; later writes make it anew."""
    import os

    from sparkloom.sources import tables

    monkeypatch.setattr(tables, "_RUN", "sparkloom-run-of-a-test")
    kept = [materialize(spark.range(5).toDF("id"), "five") for _ in range(2)]
    folder = run_folder(spark).removeprefix("file://")
    assert len(os.listdir(folder)) == 2 and kept[0].count() == 5
    drop_run(spark)
    assert not os.path.exists(folder)
    assert materialize(spark.range(3).toDF("id"), "three").count() == 3
    drop_run(spark)


def test_elapsed(spark):
    """Gaps over midnight and over days without rows; equal times; a null key."""
    from datetime import datetime, timedelta

    from sparkloom.operators.relational import elapsed

    rng, start = random.Random(12), datetime(2024, 1, 1)
    rows = [(i, rng.choice([1, 1, 2, None]), start + timedelta(seconds=rng.randrange(500_000) // 1000 * 1000)) for i in range(200)]
    want, last = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = (t - last[k]).total_seconds() if k in last else None
        last[k] = t
    df = spark.createDataFrame(rows, "id long, k long, ts timestamp")
    assert {r.id: r.seconds for r in elapsed(df, "k", "ts", "id", "seconds").collect()} == want
    assert elapsed(df.limit(0), "k", "ts", "id", "seconds").count() == 0
