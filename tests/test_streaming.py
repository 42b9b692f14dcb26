from pyspark.sql import functions as F

from sparkloom.streaming.events import counts_by_window, event_stream, first_seen

DIR = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DIR}/events.parquet")
    events.repartitionByRange(4, "ts").write.parquet(str(tmp_path / "in"))
    stream = counts_by_window(event_stream(spark, str(tmp_path / "in"), 4))
    q = stream.writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda df: sorted(map(str, df.select("start", "event_type", "n", F.round("total", 6)).collect()))
    assert key(spark.table("hours")) == key(counts_by_window(events))


def test_first_seen(spark):
    events = spark.read.parquet(f"{DIR}/events.parquet")
    assert first_seen(events.union(events)).count() == events.select("event_id").distinct().count()


def test_first_seen_in_a_stream(spark, tmp_path):
    """Repeated ids in later files are dropped by the watermark's state."""
    events = spark.read.parquet(f"{DIR}/events.parquet")
    for part in ("a", "b"):
        events.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = first_seen(event_stream(spark, str(tmp_path / "in"), 1), late="10000 days")
    q = stream.writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("seen").count() == events.select("event_id").distinct().count()
