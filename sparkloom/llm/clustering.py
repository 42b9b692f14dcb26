"""Centroid clustering of integer vectors by lookup tables of scalars.

Components become integers, and of a batch of vectors each dimension has few different ones. So a round tabulates, for
each dimension, the squared difference of every value that occurs in the batch to every centroid's component; a
vector's distances are sums of entries gathered from these tables, exact in 64 bits. Tasks sum their vectors by
cluster; what they send is a row for each cluster and dimension, summed on by Spark; the driver gets that sum
(clusters x dimensions numbers) and makes the next centroids. The vectors are written once and read each round.

Defined cases: rows whose vector is null, of another length, or has a null, NaN or infinite component take no part and
have no row in the result; nor do those with a component of LIMIT or more as an integer, whose squared distances would
not fit a long. Repeated rows count each. A null id takes part but starts a centroid only if too few others do. Of
starting vectors with one hash the smaller vector is first; equal vectors may start several centroids, of which the
later stay empty and unmoved. With fewer vectors than clusters each starts one; without any the result is empty. Other
columns do not pass. A sum of distances beyond a long is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches, discard, materialize

DIMENSIONS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, "3"
#: Integers of a vector are below this in magnitude: 64 squares of their differences sum up to less than 2**63.
LIMIT = 1 << 27
#: Vectors whose distances are gathered at once.
_ROWS = 8192


def integers(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component as longs, the largest or smallest of them beyond; null where a component is null, NaN or infinite."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(finite, F.transform(x, lambda v: F.floor(v * scale)))


def _codes(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values that occur, in order, and each row's number among them."""
    low = int(column.min())
    span = int(column.max()) - low + 1
    if span > 4 * len(column) + 65_536:
        return np.unique(column, return_inverse=True)
    at, seen = column - low, np.zeros(span, bool)
    seen[at] = True
    return np.flatnonzero(seen) + low, (np.cumsum(seen) - 1)[at]


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, centroids x vectors: sums of table entries."""
    out = np.zeros((len(centroids), len(vectors)), np.int64)
    for d in range(vectors.shape[1]):
        values, code = _codes(vectors[:, d])
        table = (values[None, :] - centroids[:, d, None]) ** 2
        out += np.take(table, code, axis=1)
    return out


def _batches(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for at in range(0, whole.num_rows, _ROWS):
            batch = whole.slice(at, _ROWS)
            yield batch, batch.column(name).flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, -1)


def _sums(centroids: np.ndarray):
    """A task's vectors summed by cluster: cluster, dimension, sum, count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, n = centroids.shape
        sums, counts = np.zeros((k, n), np.int64), np.zeros(k, np.int64)
        for _, vectors in _batches(batches, "v"):
            cluster = distances(vectors, centroids).argmin(0)
            for c in range(k):
                own = vectors[cluster == c]
                sums[c] += own.sum(0)
                counts[c] += len(own)
        c, d = np.divmod(np.arange(k * n), n)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(d, pa.int32()), pa.array(sums.ravel()), pa.array(counts[c])], names=["c", "d", "total", "n"])

    return run


def _nearest(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, vectors in _batches(batches, "v"):
            found = distances(vectors, centroids)
            cluster = found.argmin(0)  # the first of equal ones
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(found[cluster, np.arange(len(cluster))])], names=["vec_id", "cluster", "distance"])

    return run


def cluster(rows: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """Per kept row of rows(vec_id, embedding): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid."""
    spark = rows.sparkSession
    bound_batches(spark)
    made = rows.filter(F.size("embedding") == dimensions).select(F.col("vec_id").cast("long").alias("vec_id"), integers("embedding", scale).alias("v"))
    made = made.filter(F.col("v").isNotNull() & F.forall("v", lambda x: (x < LIMIT) & (x > -LIMIT))).withColumn("v", F.col("v").cast("array<int>"))
    made = materialize(made, "vectors")
    first = made.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v").limit(k).collect()
    centroids = np.array([r.v for r in first], np.int64).reshape(len(first), dimensions)
    for _ in range(rounds if len(first) else 0):
        new = centroids.copy()
        parts = made.mapInArrow(_sums(centroids), "c int, d int, total long, n long")
        for r in parts.groupBy("c", "d").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"), F.sum("n").alias("n")).collect():
            if r.n:
                new[r.c, r.d] = int(r.total) // r.n
        if np.array_equal(new, centroids):
            break  # further rounds would change nothing
        centroids = new
    if not len(first):
        discard(made)
        nothing = [F.lit(None).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"), ("centroid", "array<long>"))]
        return spark.range(0).select(F.col("id").alias("vec_id"), *nothing)
    found = materialize(made.mapInArrow(_nearest(centroids), "vec_id long, cluster int, distance long"), "nearest")
    discard(made)
    inertia = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()}

    def fit(x: int) -> int | None:
        return x if x < 1 << 63 else None

    def of_cluster(values: list, kind: str) -> Column:
        return F.element_at(F.array(*(F.lit(x).cast(kind) for x in values)), F.col("cluster") + 1)

    own = [fit(inertia.get(c, 0)) for c in range(len(centroids))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    arrays = [F.array(*(F.lit(x).cast("long") for x in c)) for c in centroids.tolist()]
    return found.select(
        "vec_id", "cluster", "distance", of_cluster(own, "long").alias("cluster_inertia"), F.lit(fit(sum(inertia.values()))).cast("long").alias("inertia"),
        of_cluster(digests, "string").alias("centroid_sha256"), F.element_at(F.array(*arrays), F.col("cluster") + 1).alias("centroid"),
    )


def op11_clustering(spark, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("centroid")
