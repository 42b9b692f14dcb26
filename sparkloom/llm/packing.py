"""Best-fit packing of documents into sequences of a fixed number of tokens.

Documents are turned into pieces: the ids of the whole text and one separator, cut only where they exceed a sequence
(the first piece is then the shorter one, all others are full). How many pieces there are of each length is a table of
at most `capacity` rows, whatever the corpus, and pieces of one length are alike to a packing. So the packing itself is
made for those counts: pieces above a third of the capacity are matched, the longest first, each with the longest that
still fits, at most two to a sequence; shorter ones, from the longest down, go where they leave the smallest gap. It
comes out as runs of equal sequences, and a piece's place follows from its rank among the pieces of its length. Ranks
are numbered within the task that made the pieces and shifted by a running sum over tasks: no task ever holds all
pieces of a length, and token ids are never shuffled for it.

Defined cases: a null text is an empty one, its ids the separator alone; a null id is kept; repeated rows are packed
each; other columns do not pass; an empty table gives an empty one. A text of any length is encoded in steps of bounded
size, save that a run without any space or line feed is one step; all its ids (4 bytes each) are held at once.
Which of several pieces of one length gets which place depends on the order in which Spark reads the rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .segments import STEP, Encoder
from .shared import bound_batches, materialize, steps, utf8

CAPACITY, SEPARATOR = 2048, 0

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"
_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One for each Python worker: tasks that follow in it find its table filled."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _ranks(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Each length's number among equal ones, after those `seen`, which grows by them."""
    order = np.argsort(lengths, kind="stable")
    sorted_ = lengths[order]
    first = np.searchsorted(sorted_, sorted_, "left")
    ranks = np.empty(len(lengths), np.int64)
    ranks[order] = np.arange(len(lengths)) - first + seen[sorted_]
    seen += np.bincount(lengths, minlength=len(seen))
    return ranks


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, ids: bool = True) -> DataFrame:
    """The pieces of docs(doc_id, text): doc_id, piece, start, length, ids_crc32, part, rank and, if asked for, ids.

    part is the task, rank the number among its pieces of that length: they hold only in a written table.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = _encoder(vocabulary), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in steps(offsets, STEP):
                flat, ends = encoder.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                flat = np.insert(flat, ends[1:], SEPARATOR).astype("<u4")
                ends = ends + np.arange(len(ends))
                total = np.diff(ends)
                n = -(-total // capacity)
                row = np.repeat(np.arange(b - a), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                stop = total[row] - (n[row] - 1 - piece) * capacity
                start = np.where(piece == 0, 0, stop - capacity)
                lo, length, raw = ends[row] + start, stop - start, memoryview(flat).cast("B")
                crc = [zlib.crc32(raw[4 * x : 4 * (x + m)]) for x, m in zip(lo.tolist(), length.tolist(), strict=True)]
                columns = [batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(row), part, np.int32)), pa.array(_ranks(length, seen))]
                if ids:
                    columns.append(pa.ListArray.from_arrays(np.append(lo, ends[-1]).astype(np.int32), pa.array(flat.view("<i4"))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", *["ids"] * ids])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, _PIECES + ", ids array<int>" * ids)


def plan(counts: np.ndarray) -> np.ndarray:
    """Runs of places for counts[length] pieces of each length: rows (length, first rank, pieces a sequence, first sequence, offset).

    Of a run, the piece of rank r lies in sequence first + (r - first rank) // q, at offset + (r - first rank) % q * length.
    The work grows with the number of lengths, not with the counts.
    """
    capacity = len(counts) - 1
    left, rank = [int(x) for x in counts], [0] * (capacity + 1)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by gap: runs of sequences (first, how many)
    made, large = 0, capacity // 3 + 1

    def put(length: int, pieces: int, q: int, first: int, offset: int) -> None:
        runs.append((length, rank[length], q, first, offset))
        rank[length] += pieces
        left[length] -= pieces

    def fill(length: int, first: int, m: int, gap: int) -> None:
        """Puts what there is and fits of a length into m sequences with that gap."""
        q = gap // length
        whole, rest = divmod(min(left[length], m * q), q)
        put(length, whole * q + rest, q, first, capacity - gap)
        for f, n, g in ((first, whole, gap - q * length), (first + whole, min(rest, 1), gap - rest * length), (first + whole + min(rest, 1), m - whole - min(rest, 1), gap)):
            if n:
                gaps[g].append((f, n))

    for a in range(capacity, large - 1, -1):
        while left[a]:
            b = min(a, capacity - a)
            while b >= large and left[b] < 1 + (b == a):
                b -= 1
            if b < large:
                m, gap = left[a], capacity - a
                put(a, m, 1, made, 0)
            elif b == a:
                m, gap = left[a] // 2, capacity - 2 * a
                put(a, 2 * m, 2, made, 0)
            else:
                m, gap = min(left[a], left[b]), capacity - a - b
                put(a, m, 1, made, 0)
                put(b, m, 1, made, a)
            gaps[gap].append((made, m))
            made += m
    for s in range(large - 1, 0, -1):
        for g in range(s, capacity + 1):
            while left[s] and gaps[g]:
                fill(s, *gaps[g].pop(), g)
            if not left[s]:
                break
        if left[s]:
            m = -(-left[s] // (capacity // s))
            fill(s, made, m, capacity)
            made += m
    return np.array(runs, np.int64).reshape(-1, 5)


def _placed(runs: np.ndarray):
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    key = runs[:, 0] << 44 | runs[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(n).to_numpy() for n in ("length", "rank"))
            _, first_rank, q, first, offset = runs[np.searchsorted(key, length << 44 | rank, "right") - 1].T
            at = rank - first_rank
            kept = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(first + at // q), pa.array(offset + at % q * length)], names=[*kept, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, ids: bool = True) -> DataFrame:
    """Per piece of docs(doc_id, text): doc_id, piece, start, length, ids_crc32, ids if asked for, sequence_id, offset."""
    made = materialize(pieces(docs, vocabulary, capacity, ids), "pieces")
    counts = materialize(made.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    totals = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row for each length at most
        totals[r.length] = r.n
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = made.join(before, ["part", "length"]).select(*(c for c in made.columns if c not in ("part", "rank")), (F.col("rank") + F.col("before")).alias("rank"))
    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(_placed(plan(totals)), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed ids: sequence_id, ids (array of at most the capacity), doc_ids of its pieces in order."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("rows"))
    return rows.select("sequence_id", F.flatten("rows.ids").alias("ids"), F.col("rows.doc_id").alias("doc_ids"))


def op12_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), ids=False)
