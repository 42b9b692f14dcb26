"""Context-triggered piecewise hashing of whole texts, compared by edit distance.

A rolling hash of the last seven bytes ends a chunk wherever it hits the block size's residue, so an edit
changes the chunks that it touches and no others. A chunk gives one of 64 letters. A fingerprint is
"block:letters:letters", the second letters at twice the block size. The block size is the largest of
3 * 2**k that still gives at least half of LETTERS; both lines of letters are complete, never cut short:
what lies beyond LETTERS - 1 chunks is folded into the last letter, so that every byte counts.

Two fingerprints are compared where block sizes agree or differ by a factor of two; the likeness is
1 - (insertions, deletions and substitutions) / longer line, from a bit-parallel distance over many pairs at once.

Neighbours in descending id order come without moving texts twice. Keys (id, the text's first PREFIX characters)
and sizes are sorted by Spark in ranges, and each of its tasks cuts its run of keys wherever RANGE_BYTES of text are
reached, so that ranges are even whatever the ids are and one id with very many rows is cut too. The driver gets the
cuts: one key for each range, of which there are at most about MOST_RANGES, as ranges grow with larger corpora. A
row's range is a binary search among them. The document at a cut is also a guest at the end of the range before it.

Defined cases: a null text counts as empty; two empty texts are alike (1), an empty and another are not (0);
rows of one id follow each other by text; null ids come after all others, by text; a table of one row is its own
next document; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches, discard, materialize, mix, powers

LETTERS = 64
_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_WINDOW, _FIRST = 7, 3
#: Bytes of text for each range of ids, and how many ranges there may be before they get longer.
RANGE_BYTES, MOST_RANGES = 8 << 20, 20_000
#: Characters of a text that go into its key.
PREFIX = 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = mix(np.arange(1, 257, dtype=np.uint64))


def _rolling(data: np.ndarray) -> np.ndarray:
    """A hash of the seven bytes that end at each position (fewer at the start), as uint32."""
    x = (_VALUES[data] >> np.uint64(32)).astype(np.uint32)
    h = x.copy()
    for k in range(1, _WINDOW):
        h[k:] += x[:-k] * np.uint32(pow(0x01000193, k, 1 << 32))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return h


def _line(sums: np.ndarray, ends: np.ndarray) -> bytes:
    ends = ends if len(ends) < LETTERS else np.append(ends[: LETTERS - 1], ends[-1])
    starts = np.append(0, ends[:-1])
    h = mix((sums[ends] - sums[starts]) * powers(_INVERSE, len(sums))[starts] + (ends - starts).astype(np.uint64))
    return _ALPHABET[(h >> np.uint64(58)).astype(np.intp)].tobytes()


def fingerprint(text: bytes) -> str:
    data = np.frombuffer(text, np.uint8)
    n = len(data)
    if not n:
        return f"{_FIRST}::"
    rolling = _rolling(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[data] * powers(_BASE, n), out=sums[1:])
    block = _FIRST
    while block * LETTERS < n:
        block *= 2

    def ends(size: int) -> np.ndarray:
        at = np.flatnonzero(rolling % np.uint32(size) == size - 1) + 1
        return at if len(at) and at[-1] == n else np.append(at, n)

    found = ends(block)
    while block > _FIRST and len(found) < LETTERS // 2:
        block //= 2
        found = ends(block)
    return f"{block}:{_line(sums, found).decode()}:{_line(sums, ends(2 * block)).decode()}"


def _distances(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Edit distances of pairs of lines of at most 64 letters: Myers' bit vectors, one letter of all b at a time."""
    n = len(a)
    m, k = np.array([len(x) for x in a], np.uint64), np.array([len(x) for x in b])
    x = np.frombuffer(b"".join(s.ljust(LETTERS, b"\0") for s in a), np.uint8).reshape(n, LETTERS)
    y = np.frombuffer(b"".join(s.ljust(LETTERS, b"\1") for s in b), np.uint8).reshape(n, LETTERS)
    one = np.uint64(1)
    pv, mv, score = np.full(n, 2**64 - 1, np.uint64), np.zeros(n, np.uint64), m.astype(np.int64)
    top = one << np.maximum(m, one) - one
    for j in range(int(k.max(initial=0))):
        eq = np.packbits(x == y[:, j : j + 1], axis=1, bitorder="little").view(np.uint64).ravel()
        xv, xh = eq | mv, (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        live = j < k
        score += live & ((ph & top) != 0)
        score -= live & ((mh & top) != 0)
        ph, mh = (ph << one) | one, mh << one
        pv, mv = mh | ~(xv | ph), ph & xv
    return np.where(m == 0, k, score)


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """Of fingerprints, pair by pair: 0 to 1; 0 where block sizes are not compatible."""
    where, a, b = [], [], []
    for i, (p, q) in enumerate(zip(left, right, strict=True)):
        (s, p1, p2), (t, q1, q2) = p.split(":"), q.split(":")
        s, t = int(s), int(t)
        lines = [(p1, q1), (p2, q2)] if s == t else [(p1, q2)] if s == 2 * t else [(p2, q1)] if t == 2 * s else []
        for x, y in lines:
            where.append(i)
            a.append(x.encode())
            b.append(y.encode())
    out = np.zeros(len(left))
    if where:
        longer = np.maximum([len(x) for x in a], [len(x) for x in b])
        np.maximum.at(out, where, np.where(longer == 0, 1.0, 1 - _distances(a, b) / np.maximum(longer, 1)))
    return np.where(np.array(left, object) == np.array(right, object), 1.0, out)


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as much of the following text's start."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by range, own documents in order, then the guest: each own document with the one after it."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    last = None

    def made(rows: list[tuple]) -> pa.RecordBatch:
        near, after = likeness([r[3] for r in rows], [r[4] for r in rows]), likeness([r[3] for r in rows], [r[5] for r in rows])
        columns = [[r[i] for r in rows] for i in range(5)] + [near, after]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    for batch in batches:
        out = []
        for span, guest, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            print_ = None
            if last is not None and last[0] == span and not last[1]:
                print_ = fingerprint(text.encode())
                new = edited(last[3], text).encode()
                out.append((last[2], len(last[3]), hashlib.sha256(new).hexdigest(), last[4], fingerprint(new), print_))
            last = (span, guest, doc, text, None if guest else print_ or fingerprint(text.encode()))
            if len(out) >= 2000:
                yield made(out)
                out = []
        yield made(out)


def _order() -> list[F.Column]:
    return [F.desc_nulls_last("doc_id"), F.col("prefix")]


def _cut(size: int):
    """Of keys in order, with sizes: the first key of each run of about `size` bytes, the task's first one included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room, last = 0, None
        for batch in batches:
            at = []
            for i, key in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if room <= 0 and key[:2] != last:  # equal keys stay together
                    at.append(i)
                    room = size
                room -= key[2]
                last = key[:2]
            cut = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(cut.columns[:2], names=["doc_id", "prefix"])

    return run


def _bounds(docs: DataFrame) -> list[tuple[int | None, str]]:
    """The first key of each range, in order."""
    keys = docs.select("doc_id", "prefix", F.octet_length("text").cast("long").alias("size"))
    keys = materialize(keys, "keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    size = max(RANGE_BYTES, total // MOST_RANGES)
    dealt = keys.repartitionByRange(max(1, min(-(-total // size), MOST_RANGES)), *_order()).sortWithinPartitions(*_order())
    # at most two keys for each range of `size` bytes: a task's first one, and those within it
    found = dealt.mapInArrow(_cut(size), "doc_id long, prefix string").collect()
    discard(keys)
    return sorted({(r.doc_id, r.prefix) for r in found}, key=_key)


def _key(x: tuple[int | None, str]) -> tuple:
    return (x[0] is None, -(x[0] or 0), x[1].encode())


def _span(bounds: list[tuple[int | None, str]]):
    """The number of the range that a key is in, and whether the key is that range's first."""
    keys = [_key(b) for b in bounds]
    ids = -np.array([b[0] for b in bounds if b[0] is not None], np.int64).astype(np.float64)  # only narrows the search
    nulls = sum(b[0] is not None for b in bounds)

    @F.pandas_udf("span int, head boolean")
    def span(missing: pd.Series, doc_id: pd.Series, prefix: pd.Series) -> pd.DataFrame:
        missing, doc_id = missing.to_numpy(bool), doc_id.to_numpy(np.int64)
        rough = -doc_id.astype(np.float64)
        lo = np.where(missing, nulls, np.searchsorted(ids, rough, "left"))
        hi = np.where(missing, len(keys), np.searchsorted(ids, rough, "right"))
        spans, heads = lo - 1, np.zeros(len(lo), bool)
        for i in np.flatnonzero(hi > lo).tolist():  # an id at a cut: by the whole key
            key = _key((None if missing[i] else int(doc_id[i]), prefix.iloc[i]))
            at = bisect_right(keys, key, lo[i], hi[i]) - 1
            spans[i], heads[i] = at, at >= 0 and keys[at] == key
        return pd.DataFrame({"span": spans.astype(np.int32), "head": heads})

    return span


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_chars, fingerprint, and those of its edited text, with the likeness to that and to the next document."""
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("prefix", F.substring("text", 1, PREFIX))
    bounds = _bounds(docs)
    n = max(len(bounds), 1)
    found = docs.withColumn("at", _span(bounds)(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), "prefix"))
    own, guest = F.struct(F.col("at.span").alias("at"), F.lit(0).alias("guest")), F.struct(F.pmod(F.col("at.span") - 1, F.lit(n)).alias("at"), F.lit(1).alias("guest"))
    rows = found.select(F.explode(F.when(F.col("at.head"), F.array(own, guest)).otherwise(F.array(own))).alias("p"), "doc_id", "text").select("p.at", "p.guest", "doc_id", "text")
    rows = rows.repartition(n, "at").sortWithinPartitions("at", "guest", F.desc_nulls_last("doc_id"), "text")
    return rows.mapInArrow(_pairs, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
