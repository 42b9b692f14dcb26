"""Quality grades by ordinal cumulative-link regression: hashed-text weights shared by all grades, ordered thresholds.

P(grade <= j) is the logistic function of threshold[j] - score(text), with one score for all grades, so the
expected grade and the probability of the top grade both follow from it. The score is linear in hashed words
(A-Z as a-z, ASCII punctuation at their ends apart), hashed shapes of words and punctuation, and repeats of
the word before. Weights are fitted by Adagrad with an L1 penalty on a sample of at most about PER_GRADE
rated documents of each grade, drawn by a hash of the id; the sample's ids are so few that they are broadcast, and
each gives one text, so that the driver gets no more rows than ids.
Every document is then graded over its whole text.

Defined cases: a null text counts as empty and gets the score of no words; ratings without grade, and rated
documents without text, teach nothing; of several ratings of one id the lowest counts, of several texts the one with
the smallest hash; without any rating
every document gets the top grade; repeated rows are graded each; other columns are ignored by `learn` and
kept by `grade`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches, mix, span_hashes, steps, trimmed, utf8, word_bounds

BUCKETS = 1 << 16
PER_GRADE = 4000
RATE, L1, PASSES = 0.3, 1e-4, 25
#: Buckets in fewer of the sample's documents get no weight: rare words say nothing about other texts.
LEAST_DOCUMENTS = 12
#: Least probability of the top grade for a document to be kept.
CUTOFF = 0.6
#: Ratings are graded 0 (toxic), 1 (of low quality), 2 (good).
GRADES = 3

#: Rows of the sample that are counted at once.
_ROWS = 64

#: Classes of bytes for shapes: upper, lower or beyond ASCII, digit, and each punctuation mark for itself.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 65, 97, 97, 48


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each row: buckets and values of its hashed features, of length 1 together."""
    starts, ends, first = word_bounds(data, offsets)
    n = len(starts)
    lo, hi = trimmed(data, starts, ends)
    words = span_hashes(data, lo, hi, fold=True)
    # a shape is the word's classes of bytes without runs
    kind = _CLASS[data]
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[starts] = True
    inside = np.repeat(np.arange(n), ends - starts)
    byte = np.arange(len(inside)) + np.repeat(starts - np.append(0, np.cumsum(ends - starts)[:-1]), ends - starts)
    byte = byte[new[byte]]
    squeezed = kind[byte]
    cuts = np.searchsorted(byte, np.append(starts, len(data)))
    shapes = span_hashes(squeezed, cuts[:-1], cuts[1:], fold=False) ^ np.uint64(0x5851F42D4C957F2D)
    tails = span_hashes(data, hi, ends, fold=False) ^ np.uint64(0x14057B7EF767814F)
    again = np.zeros(n, bool)
    again[1:] = words[1:] == words[:-1]
    again[first[:-1][first[:-1] < n]] = False
    repeats = mix(np.where(again, np.uint64(11), np.uint64(13)))
    every = np.stack([words, shapes, tails, repeats])
    every = (mix(every) & np.uint64(BUCKETS - 1)).astype(np.int64)
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
        if a == b:
            out.append((np.zeros(0, np.int64), np.zeros(0)))
            continue
        at, count = np.unique(every[:, a:b], return_counts=True)
        v = np.log1p(count)
        out.append((at, v / np.sqrt((v * v).sum())))
    return out


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one less than there are grades

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > j) for each j."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))


def slopes(theta: np.ndarray, y: int, s: float) -> tuple[float, float]:
    """Of -log P(grade y | score s): the derivatives by the thresholds above and below the grade. That by the score is minus their sum."""
    up = 1 / (1 + np.exp(-np.clip(theta[y] - s, -30, 30))) if y < GRADES - 1 else 1.0
    down = 1 / (1 + np.exp(-np.clip(theta[y - 1] - s, -30, 30))) if y else 0.0
    p = max(up - down, 1e-9)
    return -up * (1 - up) / p, down * (1 - down) / p


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], sizes: dict[int, int] | None = None) -> Model:
    """rows: buckets, values, grade. sizes: how many documents have each grade outside the sample, by which grades weigh."""
    w, gw = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6)
    theta, gt = np.linspace(-1, 1, GRADES - 1), np.full(GRADES - 1, 1e-6)
    if not rows:
        return Model(w, np.full(GRADES - 1, -30.0))
    size = np.bincount([r[2] for r in rows], minlength=GRADES)
    whole = np.array([(sizes or {}).get(g, size[g]) for g in range(GRADES)])
    weigh = whole / whole.sum() * len(rows) / np.maximum(size, 1)
    held = np.zeros(BUCKETS, np.int64)
    for i in range(0, len(rows), _ROWS):
        held += np.bincount(np.concatenate([at for at, _, _ in rows[i : i + _ROWS]]), minlength=BUCKETS)
    common = held >= min(LEAST_DOCUMENTS, len(rows) // 100 + 1)
    # one flat array of each, of the types that came: thousands of small wide ones took the driver some 170 MB more, which it then kept
    grades, ends = [y for _, _, y in rows], [0, *np.cumsum([np.count_nonzero(common[at]) for at, _, _ in rows]).tolist()]
    places, values = np.empty(ends[-1], rows[0][0].dtype), np.empty(ends[-1], rows[0][1].dtype)
    for i, (at, v, _) in enumerate(rows):
        places[ends[i] : ends[i + 1]], values[ends[i] : ends[i + 1]] = at[common[at]], v[common[at]]
    order = np.random.default_rng(11)
    for _ in range(PASSES):
        for i in order.permutation(len(rows)).tolist():
            at, v, y = places[ends[i] : ends[i + 1]].astype(np.int64), values[ends[i] : ends[i + 1]].astype(float), grades[i]
            du, dd = (x * weigh[y] for x in slopes(theta, y, float(w[at] @ v)))
            if y < GRADES - 1:
                gt[y] += du * du
                theta[y] -= RATE * du / np.sqrt(gt[y])
            if y:
                gt[y - 1] += dd * dd
                theta[y - 1] -= RATE * dd / np.sqrt(gt[y - 1])
            theta = np.maximum.accumulate(theta)
            g = -(du + dd) * v
            gw[at] += g * g
            step = RATE / np.sqrt(gw[at])
            new = w[at] - step * g
            w[at] = np.sign(new) * np.maximum(np.abs(new) - step * L1, 0)
    return Model(w, theta)


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column(2))
        for a, b in steps(offsets):
            found = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([x.astype(np.int32) for x, _ in found], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32()))], names=["key", "y", "at", "v"])


def graded(labels: DataFrame) -> DataFrame:
    """labels(doc_id, quality, toxic) as one grade (0 to 2) for each id."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade")).filter("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def learn(docs: DataFrame, ratings: DataFrame) -> Model:
    """Fits a model to docs(doc_id, text) with ratings(doc_id, grade)."""
    bound_batches(docs.sparkSession)
    sizes = {r.grade: r.n for r in ratings.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for g, n in sizes.items():
        share = F.when(F.col("grade") == g, F.lit(min(1.0, PER_GRADE / n))).otherwise(share)
    drawn = ratings.filter(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 20)) < share * (1 << 20))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text is not null").join(F.broadcast(drawn), "doc_id")  # about GRADES * PER_GRADE ids at most
    rows = rows.groupBy("doc_id", "grade").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    sample = rows.select(F.xxhash64("doc_id", "text").alias("key"), F.col("grade").cast("long").alias("y"), "text").mapInArrow(_prepare, "key long, y long, at array<int>, v array<float>").toArrow()
    rows = _views(sample)
    del sample
    model = fit(rows, sizes)
    del rows
    pa.default_memory_pool().release_unused()  # else the driver holds the sample's memory for all that follows
    return model


def _views(sample: pa.Table) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Of (key, y, at, v), in the order of the keys: at, v, y, which lie in the table as it came."""
    found = []
    for batch in sample.to_batches():
        keys, grades = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        cuts = np.append(0, np.cumsum(batch.column(2).value_lengths().to_numpy())).tolist()
        at, v = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
        found += [(keys[i], at[cuts[i] : cuts[i + 1]], v[cuts[i] : cuts[i + 1]], grades[i]) for i in range(len(keys))]
    found.sort(key=lambda row: row[0])
    return [row[1:] for row in found]


def grade(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The columns of docs, then expected_grade (0 to 2) and top_probability (of the top grade)."""
    bound_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("expected_grade", "top_probability")]
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(len(keep)))
            for a, b in steps(offsets):
                found = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                tails = model.tails(np.array([model.weights[at] @ v for at, v in found]))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(tails.sum(axis=1)), pa.array(tails[:, -1])], names=[*keep, "expected_grade", "top_probability"])

    return rows.mapInArrow(run, rows.drop("__text").schema.add("expected_grade", "double").add("top_probability", "double"))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learn(docs, graded(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return grade(docs, model).select("doc_id", "expected_grade", "top_probability", (F.col("top_probability") >= CUTOFF).alias("selected"))
