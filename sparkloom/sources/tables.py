"""Reading the given tables; intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_RUN = f"sparkloom-run-{uuid.uuid4().hex}"
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The Parquet table, or the named columns of it: selecting here keeps scans narrow."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one, but only for a local master."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors share; the master is {master}")
    if "own" not in _OWN:
        _OWN["own"] = tempfile.mkdtemp(prefix="spark-sparkloom-")
    return _OWN["own"]


def run_folder(spark: SparkSession) -> str:
    """The part of the shared folder that this driver process writes to, and that `drop_run` deletes."""
    return f"{shared_folder(spark)}/{_RUN}"


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def drop_run(spark: SparkSession) -> None:
    """Deletes all that this process has written in the shared folder: for the end of a run, when no result of it will be read again."""
    _delete(spark, run_folder(spark))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the run's folder and reads it again: cuts the lineage, and survives the loss of executors."""
    path = f"{run_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `materialize` wrote and that nothing will read again; others are left alone."""
    for df in tables:
        path = _PATHS.pop(df, None)
        if path:
            _delete(df.sparkSession, path)
