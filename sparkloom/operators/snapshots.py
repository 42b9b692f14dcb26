"""Snapshots of a table by content, their differences, and a manifest that names the current one."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources.tables import materialize


def snapshot(rows: DataFrame, key: str, content: list[str]) -> DataFrame:
    """key, digest: the SHA-256 of a row's content columns, nulls and all. Of rows of one key, the smallest digest counts; rows with a null key are left out."""
    digest = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    return rows.select(F.col(key).alias("key"), digest.alias("digest")).filter("key is not null").groupBy("key").agg(F.min("digest").alias("digest"))


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two snapshots to key, change, other: rows that are the same are left out.

    change: "changed" (the key stays, the content doesn't); of keys that only the new one has, "moved" if its content was
    under keys that are gone (other: the smallest of them), else "added"; of keys that only the old one has, "gone" if its
    content is now under new keys (other: the smallest of them), else "removed". Contents are matched by written
    minima for each digest, so that a content of very many keys is one row there and Spark can split its join.
    """
    both = old.select("key", F.col("digest").alias("was")).join(new.select("key", F.col("digest").alias("now")), "key", "full_outer")
    both = materialize(both.filter("was is null or now is null or was <> now"), "changes")
    left, came = both.filter("now is null"), both.filter("was is null")
    gone = materialize(left.groupBy(F.col("was").alias("digest")).agg(F.min("key").alias("other")), "gone")
    arrived = materialize(came.groupBy(F.col("now").alias("digest")).agg(F.min("key").alias("other")), "arrived")
    changed = both.filter("was is not null and now is not null").select("key", F.lit("changed").alias("change"), F.lit(None).cast(both.schema["key"].dataType).alias("other"))

    def matched(rows: DataFrame, digest: str, against: DataFrame, yes: str, no: str) -> DataFrame:
        found = rows.select("key", F.col(digest).alias("digest")).join(against, "digest", "left")
        return found.select("key", F.when(F.col("other").isNotNull(), yes).otherwise(no).alias("change"), "other")

    return changed.unionByName(matched(came, "now", gone, "moved", "added")).unionByName(matched(left, "was", arrived, "gone", "removed"))


def _identity(found: DataFrame) -> tuple[str, int]:
    """A name that follows from a snapshot's rows alone, whatever their order, and how many there are."""
    row = F.concat_ws(":", F.col("key").cast("string"), "digest")
    r = found.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(row)).alias("x"), F.sum(F.xxhash64(F.reverse(row)).cast("decimal(38,0)")).alias("s")).first()
    return uuid.uuid5(uuid.NAMESPACE_OID, f"{r.n}:{r.x}:{r.s}").hex, r.n


def _hadoop(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where, jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsparkSession.sessionState().newHadoopConf())


def commit(found: DataFrame, folder: str) -> str:
    """Writes a snapshot below `folder`, under a name that its rows give it, and then makes the manifest point to it; returns the name.

    A run that is repeated, or tried again after a failure, writes the same name and manifest. The manifest is replaced by
    one rename: a reader sees the old or the new one, and never one whose snapshot isn't there whole.
    """
    spark = found.sparkSession
    fixed = materialize(found, "snapshot")
    name, n = _identity(fixed)
    fixed.write.mode("overwrite").parquet(f"{folder}/{name}")
    _, _, context = _hadoop(spark, folder)
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs
    beside = f"{folder}/manifest-{uuid.uuid4().hex}"
    out = fs.Path(beside).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(fs.Path(beside))
    out.write(bytearray(json.dumps({"rows": n, "snapshot": name}, sort_keys=True).encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    options[0] = fs.Options.Rename.OVERWRITE
    context.rename(fs.Path(beside), fs.Path(f"{folder}/manifest.json"), options)
    return name


def current(spark: SparkSession, folder: str) -> DataFrame | None:
    """The snapshot that the manifest names, None before the first commit."""
    jvm, where, context = _hadoop(spark, f"{folder}/manifest.json")
    if not context.util().exists(where):
        return None
    line = spark.read.text(f"{folder}/manifest.json").first()
    return spark.read.parquet(f"{folder}/{json.loads(line.value)['snapshot']}")
