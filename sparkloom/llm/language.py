"""Language identification: multinomial logistic regression on TF-IDF of hashed character n-grams.

Document frequencies come from every learnable document, as one array per task summed by bucket. Weights are
learned by follow-the-regularised-leader with elastic-net penalties on a sample of at most about PER_LANGUAGE
ids of each language (a hash of the id decides; a language with fewer ids gives all, however often one of them
repeats; rows of one id teach once, so that the driver gets no more rows than ids), and a temperature is fitted on the part of the sample that the weights have not seen. Model and frequencies have a fixed size per
language (64 kB of weights, and a sample's rows), so that the driver is bound by the number of languages, which is
taken to be hundreds at most; they go to the executors with the function. Predictions read whole texts and nothing but texts.

Defined cases: a text that is null or has no letter is `und` with score 0; without anything to learn from, all
are; rows with a null lang or text teach nothing; a null id is not learned from and not held out; repeated rows count
each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mix

BUCKETS, ORDERS = 1 << 14, 3
PER_LANGUAGE = 1000
#: Of FTRL: learning rate, its offset, L1 and L2 penalties, passes.
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 0.02, 0.1, 3
_STEP = 1 << 18


def gram_counts(text: str) -> np.ndarray:
    """How often each bucket's n-grams (1 to ORDERS characters, lower case, white space as one blank) occur, over the whole text."""
    x = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(x), _STEP):  # bounds the arrays for very long texts; portions overlap by ORDERS - 1
        part = x[at : at + _STEP + ORDERS - 1].astype(np.uint64)
        own = min(_STEP, len(x) - at)
        h = np.zeros(len(part), np.uint64)
        for n in range(ORDERS):
            h = (h[: len(part) - n] + part[n:] + np.uint64(n + 1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            grams = mix(h[:own])
            total += np.bincount((grams & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
    return total


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = gram_counts(text)
    at = np.flatnonzero(counts)
    v = (1 + np.log(counts[at])) * idf[at]
    norm = np.sqrt((v * v).sum())
    return at, (v / norm if norm else v).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], languages: list[str], idf: np.ndarray) -> Model:
    """rows: buckets, values, the language's number. The last bucket's row of weights is the bias. Every fifth row calibrates."""
    z, n = np.zeros((BUCKETS + 1, len(languages))), np.zeros((BUCKETS + 1, len(languages)))
    train, held = [r for i, r in enumerate(rows) if i % 5], rows[::5]
    order = np.random.default_rng(7)

    def weights(z, n):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(PASSES):
        for i in order.permutation(len(train)):
            at, v, y = train[i]
            at, v = np.append(at, BUCKETS), np.append(v, 1.0)
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            s = v @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = v[:, None] * p
            more = ni + g * g
            z[at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / ALPHA * w
            n[at] = more
    model = Model(languages, weights(z, n).astype(np.float32), idf)
    if held:
        s, y = np.array([v @ model.weights[at] + model.weights[BUCKETS] for at, v, _ in held]), np.array([r[2] for r in held])

        def loss(t):
            x = s / t
            x -= x.max(axis=1, keepdims=True)
            return -(x[np.arange(len(y)), y] - np.log(np.exp(x).sum(axis=1))).mean()

        model.temperature = float(min(np.geomspace(0.05, 20, 200), key=loss))
    return model


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for t in batch.column(0).to_pylist():
            total += gram_counts(t) > 0
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Fits a model on rows with a text and a language."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).filter("text is not null and lang is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages, total = sorted(sizes), sum(sizes.values())
    df = np.zeros(BUCKETS)
    for r in rows.select("text").mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        df[r.bucket] = r.n
    idf = np.log((1 + total) / (1 + df)) + 1
    if not languages:
        return Model([], np.zeros((BUCKETS + 1, 0), np.float32), idf)
    share, ids = F.lit(0.0), {r.lang: r.n for r in rows.select("lang", "key").distinct().groupBy("lang").agg(F.count("key").alias("n")).collect()}
    for name, n in ids.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, PER_LANGUAGE / max(n, 1)))).otherwise(share)
    drawn = rows.filter(F.pmod(F.xxhash64("key", F.lit("language")), F.lit(1 << 20)) < share * (1 << 20))
    first = F.min_by(F.struct("text", "lang"), F.struct(F.xxhash64("text", "lang"), "lang", "text")).alias("row")
    drawn = drawn.groupBy("key").agg(first).select("key", "row.text", "row.lang")
    number = {x: i for i, x in enumerate(languages)}

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t, idf) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([number[x] for x in batch.column(2).to_pylist()], pa.int64()), pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float32()))], names=["key", "y", "at", "v"])

    sample = drawn.select(F.xxhash64("key").alias("key"), "text", "lang").mapInArrow(prepare, "key long, y long, at array<int>, v array<float>").toArrow().sort_by("key")
    at, v, y = sample.column("at").combine_chunks(), sample.column("v").combine_chunks(), sample.column("y").to_pylist()
    return fit([(at[i].values.to_numpy().astype(np.int64), v[i].values.to_numpy(), y[i]) for i in range(len(y))], languages, idf)


def predict(docs: DataFrame, model: Model, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """The columns of docs without `drop`, then lang_pred and score."""
    keep = [c for c in docs.columns if c not in {*drop, "lang_pred", "score"}]
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.when(F.col(text).rlike(r"\p{L}"), F.col(text).cast("string")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*model.languages, "und"]
        for batch in batches:
            best, score = [], []
            for t in batch.column(len(keep)).to_pylist():
                if t is None or not model.languages:
                    best.append(-1)
                    score.append(0.0)
                    continue
                at, v = features(t, model.idf)
                s = (v @ model.weights[at] + model.weights[BUCKETS]).astype(np.float64) / model.temperature
                p = np.exp(s - s.max())
                best.append(int(p.argmax()))
                score.append(float(1 / p.sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([names[i] for i in best], pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    return rows.mapInArrow(run, rows.drop("__text").schema.add("lang_pred", "string").add("score", "double"))


def op4_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    model = learn(docs.filter(~held & F.col("doc_id").isNotNull()))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model, drop=("text",))
