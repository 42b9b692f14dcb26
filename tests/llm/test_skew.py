"""A third of all rows behind one key: Spark splits that key's partition in the join back, as the docstrings say."""

import contextlib

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import minhash, secrets, warc

CONF = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "24k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "24k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16",
}


@contextlib.contextmanager
def small_partitions(spark):
    before = {k: spark.conf.get(k, None) for k in CONF}
    try:
        for k, v in CONF.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("hot") / "t")
    text = F.when(F.col("id") % 3 == 0, F.lit("one text that very many rows share, token=abcdefgh")).otherwise(F.concat_ws(" ", *(F.concat(F.lit(f"w{i}x"), "id") for i in range(6))))
    # ids and paths that don't compress, so that many rows are also many bytes
    spark.range(90_000).select(F.pmod(F.xxhash64("id"), F.lit(1 << 60)).alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("path"), text.alias("text")).repartition(8).write.parquet(path)
    return path


def skewed(df):
    n = len(df.collect())
    return n, "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def test_secrets(spark, hot):
    with small_partitions(spark):
        assert skewed(secrets.scan_kept(spark.read.parquet(hot), path="path")) == (90_000, True)


def test_redact(spark, hot):
    with small_partitions(spark):
        assert skewed(secrets.redact(spark.read.parquet(hot))) == (90_000, True)


def test_warc(spark, hot):
    with small_partitions(spark):
        pages = spark.read.parquet(hot).select(F.col("doc_id").alias("page_id"), F.col("path").alias("url"), F.col("text").alias("html"))
        assert skewed(warc.tag(pages)) == (90_000, True)


def test_near_duplicates(spark, hot):
    with small_partitions(spark):
        out = minhash.link(spark.read.parquet(hot))
        assert skewed(out) == (90_000, True)
        assert out.groupBy("component_id").count().agg(F.max("count")).first()[0] == 30_000
