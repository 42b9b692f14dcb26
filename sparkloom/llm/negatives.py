"""Hard-negative mining: exact inner products in residue arithmetic, then the best rows of a window of scores.

Components are integers. A block of rows is multiplied with a block of anchors modulo several small primes, each as a
float32 matrix product: residues are at most (p - 1) / 2 in magnitude, and WIDTH of their products stay below 2**24, so
every product is exact. Chinese remaindering (mixed radix, in 64-bit integers) gives the signed score; the number of
primes follows from the largest norm of all rows, by which no score can be larger. A first pass over the rows keeps each
anchor's best rows of its own label, a second one, for each of these positives, the best rows of other labels whose
score lies in the positive's window.

Anchors are met in blocks of bounded size, each against all rows, in one Spark job a pass: a block goes to the tasks
with the function (about ANCHOR_NUMBERS components, however large the table), and a task keeps for each anchor of the
block only the first few rows that it has seen. What tasks keep is merged by a window over (anchor, positive), of a few
rows from each task. A block's result is written before the next one begins.

Defined cases: a row with a null id, label or vector, or with a null, NaN or infinite component takes no part, nor does
one whose integer components' squares sum up to LIMIT or more: scores would not fit a long. A vector shorter than
another counts as if zeros followed. Repeated rows count each, and a repeated anchor is several anchors; rows with the
anchor's own id are neither its positives nor its negatives. Ties go to the smaller id. An anchor without positives, or
a positive without negatives in its window, gives no rows; neither does an empty table. Other columns do not pass.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .clustering import integers
from .shared import bound_batches, discard, materialize, shared_folder

SCALE, POSITIVES, NEGATIVES, ANCHORS, RELABELLED, LABELS = 256, 5, 10, 100, 7, 10
#: A negative's score lies between these per cents of the positive's.
LOW, HIGH = 30, 90
#: Squares of a vector's integers sum up to less; ten times any score then fits 64 bits.
LIMIT = float(1 << 59)
#: Columns of a matrix product: WIDTH * 510**2 < 2**24.
WIDTH = 64
#: Numbers in a block of anchors, about: 8 MB.
ANCHOR_NUMBERS = 1 << 20
#: Rows and anchors that are multiplied at once.
_ROWS, _SOME = 4096, 256
_LEAST = np.iinfo(np.int64).min


def primes(bound: int) -> list[int]:
    """The largest primes below 1024, as many as make a product of more than twice the bound."""
    found, p = [], 1021
    while math.prod(found) <= 2 * bound + 1:
        if all(p % d for d in range(3, 32, 2)):
            found.append(p)
        p -= 2
    return found


def residues(matrix: np.ndarray, p: int) -> np.ndarray:
    """Modulo p, between -(p - 1) / 2 and (p - 1) / 2."""
    half = (p - 1) // 2
    return ((matrix + half) % p - half).astype(np.float32)


def _product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b.T modulo p, of residues: WIDTH columns at a time."""
    total = None
    for at in range(0, max(a.shape[1], 1), WIDTH):
        part = a[:, at : at + WIDTH] @ b[:, at : at + WIDTH].T
        total = part if total is None else np.remainder(total, p) + np.remainder(part, p)
    return np.remainder(total, p)


def signed(parts: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """The integers of least magnitude with these residues: mixed radix digits of both signs. Wrapped sums are right, as the result fits."""
    total, radix = np.zeros(parts[0].shape, np.int64), 1
    for r, p in zip(parts, moduli, strict=True):
        half = (p - 1) // 2
        digit = ((r.astype(np.int64) - total % p) * pow(radix % p, -1, p) + half) % p - half
        total = total + digit * np.int64((radix + (1 << 63)) % (1 << 64) - (1 << 63))
        radix *= p
    return total


class Scores:
    """of(a, b): exact inner products of a block of rows with some of the anchors; residues are made once."""

    def __init__(self, anchors: np.ndarray, moduli: list[int]):
        self.moduli, self.anchors = moduli, [residues(anchors, p) for p in moduli]

    def rows(self, matrix: np.ndarray) -> list[np.ndarray]:
        return [residues(matrix, p) for p in self.moduli]

    def of(self, anchors: np.ndarray | slice, rows: list[np.ndarray]) -> np.ndarray:
        return signed([_product(a[anchors], r, p) for a, r, p in zip(self.anchors, rows, self.moduli, strict=True)], self.moduli)


class First:
    """For each of n keys the first k (score, id) met, higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k, self.count = k, np.zeros(n, np.int64)
        self.score, self.id = np.full((n, k), _LEAST), np.zeros((n, k), np.int64)

    def _held(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero(np.arange(self.k) < self.count[keys, None])

    def add(self, keys: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """scores[i, j], where allowed, for keys[i] (all different) and ids[j]."""
        allowed = allowed & (scores >= self.score[keys, -1:])  # below the k-th so far there is no place
        crowd = np.flatnonzero(allowed.sum(1) > 4 * self.k)
        if len(crowd):  # of many, all below the k-th go at once
            some = np.where(allowed[crowd], scores[crowd], _LEAST)
            allowed[crowd] &= scores[crowd] >= np.partition(some, -self.k, axis=1)[:, -self.k, None]
        i, j = np.nonzero(allowed)
        if not len(i):
            return
        a, b = self._held(keys)
        key, score, id_ = np.append(a, i), np.append(self.score[keys[a], b], scores[i, j]), np.append(self.id[keys[a], b], ids[j])
        order = np.lexsort((id_, -score, key))
        key, score, id_ = key[order], score[order], id_[order]
        place = np.arange(len(key)) - np.searchsorted(key, key, "left")
        keep = place < self.k
        self.score[keys[key[keep]], place[keep]], self.id[keys[key[keep]], place[keep]] = score[keep], id_[keep]
        self.count[keys] = np.bincount(key[keep], minlength=len(keys))

    def batch(self, name: str) -> pa.RecordBatch:
        a, b = self._held(np.arange(len(self.count)))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(self.id[a, b]), pa.array(self.score[a, b])], names=[name, "id", "score"])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows, zeros behind shorter ones."""
    sizes = column.value_lengths().to_numpy()
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for whole in batches:
        for at in range(0, whole.num_rows, _ROWS):
            batch = whole.slice(at, _ROWS)
            yield batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), _matrix(batch.column("v"), width)


def _positives(ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, moduli: list[int], k: int):
    """Of a task's rows: for each anchor (its number) the first k of its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, best = Scores(anchors, moduli), First(len(ids), k)
        for row_ids, row_labels, matrix in _blocks(batches, anchors.shape[1]):
            for label in np.unique(row_labels):
                mine, own = np.flatnonzero(row_labels == label), np.flatnonzero(labels == label)
                rows = scores.rows(matrix[mine]) if len(own) else []
                for at in range(0, len(own), _SOME):
                    some = own[at : at + _SOME]
                    best.add(some, scores.of(some, rows), row_ids[mine], ids[some, None] != row_ids[None, mine])
        yield best.batch("anchor")

    return run


def _negatives(ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, moduli: list[int], k: int, owner: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Of a task's rows: for each positive (its number; owner: its anchor, ascending) the first k of other labels with low <= score <= high."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, best = Scores(anchors, moduli), First(len(owner), k)
        for row_ids, row_labels, matrix in _blocks(batches, anchors.shape[1]):
            rows = scores.rows(matrix)
            for at in range(0, len(ids), _SOME):
                a, b = np.searchsorted(owner, [at, at + _SOME])
                if a == b:
                    continue
                found = scores.of(slice(at, at + _SOME), rows)
                other = (labels[at : at + _SOME, None] != row_labels[None, :]) & (ids[at : at + _SOME, None] != row_ids[None, :])
                turn = np.arange(a, b) - np.searchsorted(owner, owner[a:b], "left")
                for j in range(int(turn.max()) + 1):  # each anchor's j-th positive
                    windows = np.flatnonzero(turn == j) + a
                    mine = found[owner[windows] - at]
                    best.add(windows, mine, row_ids, other[owner[windows] - at] & (mine >= low[windows, None]) & (mine <= high[windows, None]))
        yield best.batch("positive")

    return run


def _merged(found: DataFrame, key: str, k: int) -> DataFrame:
    best = Window.partitionBy(key).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, anchors: int = ANCHORS, scale: int = SCALE, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Of rows(vec_id, embedding, label): anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Anchors are the ids divisible by `anchors`."""
    spark = rows.sparkSession
    bound_batches(spark)
    made = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), integers("embedding", scale).alias("v")).dropna()
    made = made.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).filter(F.col("norm") < LIMIT)
    made = materialize(made.withColumn("v", F.col("v").cast("array<int>")), "vectors")
    most = made.agg(F.max("norm").alias("norm"), F.max(F.size("v")).alias("width"), F.count_if(F.col("vec_id") % anchors == 0).alias("n")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not most.n:
        discard(made)
        return spark.createDataFrame([], schema)
    width = max(most.width, 1)
    moduli = primes(math.ceil(most.norm * (1 + 1e-9)))
    blocks = -(-most.n * width // ANCHOR_NUMBERS)
    asked = made.filter(F.col("vec_id") % anchors == 0).repartition(blocks).withColumn("block", F.spark_partition_id())
    asked = materialize(asked, "anchors")
    path = f"{shared_folder(spark)}/sparkloom-negatives-{uuid.uuid4().hex}"
    for number in range(blocks):
        block = asked.filter(F.col("block") == number).select("vec_id", "label", "v").toArrow().combine_chunks()
        if not block.num_rows:
            continue
        ids, labels = block.column("vec_id").to_numpy(), block.column("label").to_numpy()
        of = ids, labels, _matrix(block.column("v").combine_chunks(), width), moduli
        found = made.mapInArrow(_positives(*of, positives), "anchor long, id long, score long")
        best = _merged(found, "anchor", positives).toArrow().sort_by([("anchor", "ascending"), ("rank", "ascending")])  # a few rows for each anchor of the block
        owner, positive, score = (best.column(n).to_numpy() for n in ("anchor", "id", "score"))
        lowest, highest = ((-(-score.astype(object) * x // 100) if up else score.astype(object) * x // 100).astype(np.int64) for x, up in ((low, True), (high, False)))
        found = made.mapInArrow(_negatives(*of, negatives, owner, lowest, highest), "positive long, id long, score long")
        _merged(found, "positive", negatives).mapInArrow(_named(ids[owner], positive, score), schema).write.mode("append").parquet(path)
    discard(made, asked)
    return spark.read.schema(schema).parquet(path)


def _named(anchor: np.ndarray, positive: np.ndarray, score: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("positive").to_numpy()
            columns = [pa.array(anchor[at]), pa.array(positive[at]), b.column("rank"), b.column("id"), pa.array(score[at]), b.column("score")]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return run


def op13_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return mine(rows.withColumn("label", F.when(F.col("vec_id") % RELABELLED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))))
