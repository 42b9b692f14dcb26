"""Exact substring removal: Rabin-Karp hashes of every window of `window` words, counted over the corpus.

Plan. Documents are dealt to parts of bounded size by a hash of id and text. Rows that repeat id and text so often
that they would fill a part become one row with a number of copies, and are as many again in the result. Each part sends every distinct
window hash once to the bucket of its high bits, as sorted packed arrays, so that a passage repeated a
million times inside a part costs one entry. A bucket returns to each part the hashes that other parts
hold too. The part, whose shuffled text is reused, marks windows that are returned or repeat inside the
part and merges them into maximal intervals of words. No group holds more than one part or one bucket.

Defined cases: a null text has no words; a document shorter than the window keeps everything; repeated rows
are documents of their own, hence each other's copies; a null id is allowed; other columns are ignored.
Windows are compared by 64-bit hashes: for n windows the expected number of chance matches is n*n / 2**65.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, span_hashes, steps, utf8, window_hashes, word_bounds

#: Bytes of text in a part: grows with the square root of the corpus between these bounds, so that packed arrays stay long.
PART_BYTES = (8 << 20, 128 << 20)


def _windows(table: pa.Table, size: int):
    """For each run of rows: first row, text bytes, word starts, ends, first words, hashes of windows, their first words."""
    data, offsets = utf8(table.column("text"))
    for a, b in steps(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = word_bounds(part, at)
        hashes = window_hashes(span_hashes(part, starts, ends, fold=False, twice=True), size)
        left = np.repeat(first[1:], np.diff(first)) - np.arange(len(starts))
        begins = np.flatnonzero(left >= size)
        yield a, part, starts, ends, first, hashes[begins], begins


def _pack(hashes: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte planes apart: the shuffle's compressor then removes the empty high planes."""
    return np.diff(hashes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def _send(buckets: int, size: int):
    width = np.uint64(-(-(1 << 64) // buckets) if buckets > 1 else (1 << 64) - 1)

    def send(table: pa.Table) -> pa.Table:
        found = [x[5] for x in _windows(table, size)]
        hashes = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        cuts = np.searchsorted(hashes, np.arange(1, buckets, dtype=np.uint64) * width) if buckets > 1 else np.zeros(0, int)
        rows = [(i, x) for i, x in enumerate(np.split(hashes, cuts)) if len(x)]
        part = table.column("part")[0].as_py()
        return pa.table({"bucket": pa.array([i for i, _ in rows], pa.int64()), "part": pa.array([part] * len(rows), pa.int64()), "hashes": pa.array([_pack(x) for _, x in rows], pa.binary())})

    return send


def _count(table: pa.Table) -> pa.Table:
    """Of one bucket: for each part its hashes that another part holds too."""
    parts, blobs = table.column("part").to_pylist(), [_unpack(x) for x in table.column("hashes").to_pylist()]
    every = np.concatenate(blobs)
    every.sort()
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    back = [(p, x) for p, b in zip(parts, blobs, strict=True) if len(x := b[np.isin(b, twice, assume_unique=True)])]
    return pa.table({"part": pa.array([p for p, _ in back], pa.int64()), "hashes": pa.array([_pack(x) for _, x in back], pa.binary())})


def _intervals(covered: np.ndarray, lo: int, hi: int) -> list[dict]:
    edge = np.flatnonzero(np.diff(covered[lo:hi].view(np.int8), prepend=0, append=0))
    return [{"start": int(s), "end": int(e)} for s, e in edge.reshape(-1, 2)]


def _remove(size: int):
    def remove(docs: pa.Table, back: pa.Table) -> pa.Table:
        shared = np.sort(np.concatenate([np.zeros(0, np.uint64), *map(_unpack, back.column("hashes").to_pylist())]))
        own = np.concatenate([np.zeros(0, np.uint64), *(x[5] for x in _windows(docs, size))])
        own.sort()
        repeated = np.union1d(shared, own[1:][own[1:] == own[:-1]])
        del own, shared
        texts, spans, words, removed, copies = [], [], [], [], docs.column("copies").to_numpy()
        for a, data, starts, ends, first, hashes, begins in _windows(docs, size):
            row = a + np.searchsorted(first, begins, "right") - 1
            hit = begins[np.isin(hashes, repeated) | (copies[row] > 1)]
            edge = np.zeros(len(starts) + 1, np.int32)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + size, -1)
            covered = np.cumsum(edge[:-1]) > 0
            keep = np.flatnonzero(~covered)
            lengths = ends[keep] - starts[keep] + 1
            out = np.zeros(len(keep) + 1, np.int64)
            np.cumsum(lengths, out=out[1:])
            at = np.repeat(starts[keep] - out[:-1], lengths) + np.arange(out[-1])
            joined = data[np.minimum(at, max(len(data) - 1, 0))] if len(data) else data
            joined[out[1:] - 1] = 0x20
            joined = joined.tobytes()
            cut = out[np.searchsorted(keep, first)]
            for d in range(len(first) - 1):
                texts.append(joined[cut[d] : max(cut[d + 1] - 1, cut[d])])
                lo, hi = first[d], first[d + 1]
                n = int(covered[lo:hi].sum())
                words.append(int(hi - lo))
                removed.append(n)
                spans.append(_intervals(covered, lo, hi) if n else [])
        return pa.table({
            "doc_id": docs.column("doc_id"), "copies": docs.column("copies"), "kept_text": pa.array(texts, pa.binary()).cast(pa.string()), "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        })

    return remove


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, kept_text (kept words joined by one space), n_words, n_removed, removed (intervals of words, end exclusive)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    keys = docs.groupBy("key").agg(F.sum(F.octet_length("text")).alias("bytes"))
    found = keys.agg(F.sum("bytes").alias("total"), F.max("bytes").alias("most")).first()
    total = found.total or 0
    size = min(max(PART_BYTES[0], 256 * math.isqrt(total)), PART_BYTES[1])
    parts = max(1, -(-total // size))
    docs = _collapsed(docs, keys, size) if (found.most or 0) > size else docs.withColumn("copies", F.lit(1).cast("long"))
    docs = docs.select("doc_id", "text", "copies", F.pmod("key", F.lit(parts)).alias("part"))
    sent = docs.groupBy("part").applyInArrow(_send(parts, window), "bucket long, part long, hashes binary")
    back = sent.groupBy("bucket").applyInArrow(_count, "part long, hashes binary")
    schema = "doc_id long, copies long, kept_text string, n_words long, n_removed long, removed array<struct<start: long, end: long>>"
    out = docs.groupBy("part").cogroup(back.groupBy("part")).applyInArrow(_remove(window), schema)
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")


def _collapsed(docs: DataFrame, keys: DataFrame, size: int) -> DataFrame:
    """docs in which rows of equal id and text are one where they have more than `size` bytes together. There are at most as many such keys as parts."""
    hot = materialize(keys.filter(F.col("bytes") > size).select("key"), "hot")
    one = docs.join(hot, "key", "left_semi").groupBy("key", "doc_id", "text").agg(F.count("*").alias("copies"))
    return docs.join(hot, "key", "left_anti").withColumn("copies", F.lit(1).cast("long")).unionByName(one)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
