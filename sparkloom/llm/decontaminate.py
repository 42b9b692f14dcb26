"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words over the whole corpus, as one array per task summed by bucket.
2. Passages longer than PIECE words are cut into pieces of that length, WIDTH apart, so that any WIDTH words of
   a passage lie in one piece whole. A randomised SVD of the pieces' TF-IDF, in blocks of about BLOCK_ITEMS:
   Spark multiplies the pieces' matrix and its transpose with a narrow random matrix, POWER times, summing by
   bucket; the driver orthonormalises, each time, a matrix of the block's buckets by its rank, LATENT at most, a
   third of a block's pieces: words that pieces have together share dimensions. Pieces' latent vectors are brought back
   to length 1, which makes up for the energy that the space has lost of a piece.
3. One pass over the documents per PASS_BLOCKS blocks: windows of WIDTH words, STRIDE apart, are projected into the block's
   latent space and compared with its pieces by cosine. By Cauchy-Schwarz a window whose share of weight on
   the block's words is below COSINE squared cannot reach COSINE; it is left out before it is projected.
   Beside it, every run of SEED words that a passage and a document share (all of a shorter passage) makes a candidate:
   verbatim passages don't depend on a cosine, in which rarer words around a short one would outweigh it.
4. A candidate is decided on the words around the window: their longest common subsequence with the whole passage
   must cover STRONG of it, or WEAK of it together with its answer (given, or else the passage's ANSWER
   heaviest words) for at least half. Candidates around which too few of the passage's words occur at all, in
   whatever order, cannot reach WEAK and are left out first, all of a step at once.

Documents are never shuffled: blocks are applied one after the other to rows that flow through. What goes to
the executors is PASS_BLOCKS blocks at a time, whose size is bounded by BLOCK_ITEMS and BLOCK_BYTES.

Defined cases: a null or empty text is clean; passages without words are never found; an empty benchmark
leaves every document clean; repeated rows are judged each; repeated passages are all listed; other columns pass.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches, materialize, mix, span_hashes, steps, trimmed, utf8, window_hashes, word_bounds

BUCKETS = 1 << 17
RANK, LATENT, POWER = 192, 64, 2
SEED = 8
WIDTH, STRIDE, COSINE = 32, 8, 0.35
PIECE = 2 * WIDTH
STRONG, WEAK, ANSWER = 0.75, 0.5, 6
BLOCK_ITEMS, BLOCK_BYTES, PASS_BLOCKS = RANK, 4 << 20, 4


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, A-Z as a-z and without punctuation at their ends; each row's first word. Words of punctuation alone are left out."""
    starts, ends, first = word_bounds(data, offsets)
    lo, hi = trimmed(data, starts, ends)
    real = hi > lo
    before = np.append(0, np.cumsum(real))
    return span_hashes(data, lo[real], hi[real], fold=True, twice=True), before[first]


def _bucket(words: np.ndarray) -> np.ndarray:
    return (words & np.uint64(BUCKETS - 1)).astype(np.int64)


def _of_texts(texts: list[str]) -> list[np.ndarray]:
    words, first = _words(*utf8(pa.array(texts, pa.string())))
    return np.split(words, first[1:-1]) if texts else []


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, rows = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        data, offsets = utf8(batch.column(0))
        rows += batch.num_rows
        for a, b in steps(offsets):
            words, first = _words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            wide = np.int32 if (b - a) * BUCKETS < 2**31 else np.int64  # narrow numbers sort faster
            key = np.repeat(np.arange(b - a, dtype=wide) * wide(BUCKETS), np.diff(first))
            key |= _bucket(words).astype(wide)
            key.sort()
            new = np.ones(len(key), bool)
            np.not_equal(key[1:], key[:-1], out=new[1:])
            total += np.bincount(key[new] & wide(BUCKETS - 1), minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], rows))], names=["bucket", "n"])


def inverse_frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """A weight for each bucket, from all documents; BUCKETS numbers, whatever their number."""
    found = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    at, n = found.column("bucket").to_numpy(), found.column("n").to_numpy()
    df = np.zeros(BUCKETS)
    df[at[at >= 0]] = n[at >= 0]
    return (np.log((1 + n[at < 0].sum()) / (1 + df)) + 0.05).astype(np.float32)


def _matrix(items: DataFrame, idf: np.ndarray) -> DataFrame:
    """(row, piece, at, v): TF-IDF of each piece of each passage, of length 1; none for a passage without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, words in zip(batch.column(0).to_pylist(), _of_texts(batch.column(1).to_pylist()), strict=True):
                at, v = [], []
                for a in range(0, max(len(words) - PIECE, 0) + WIDTH, WIDTH) if len(words) else ():
                    b, n = np.unique(_bucket(words[a : a + PIECE]), return_counts=True)
                    x = n * idf[b]
                    at.append(b)
                    v.append(x / max(np.sqrt((x * x).sum()), 1e-9))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(at), pa.int64()), pa.array(range(len(at)), pa.int64()), pa.array(at, pa.list_(pa.int64())), pa.array(v, pa.list_(pa.float64()))],
                    names=["row", "piece", "at", "v"],
                )

    return items.select("row", "text").mapInArrow(run, "row long, piece long, at array<long>, v array<double>")


def _gaussian(buckets: np.ndarray, rank: int) -> np.ndarray:
    """Rows of the random matrix: the same for a bucket wherever they are made."""
    seed = mix(buckets.astype(np.uint64)[:, None] * np.uint64(4096) + np.arange(rank, dtype=np.uint64))
    u = ((seed >> np.uint64(32)).astype(float) + 0.5) / 2**32
    v = ((seed & np.uint64(2**32 - 1)).astype(float) + 0.5) / 2**32
    return np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)


def latent_space(matrix: DataFrame, rank: int = RANK, power: int = POWER) -> tuple[np.ndarray, np.ndarray]:
    """Randomised SVD of the rows (any number, at, v): (buckets that occur, ascending; their rows of an orthonormal basis of the leading right singular vectors)."""
    buckets, basis = np.zeros(0, np.int64), None

    def multiply(buckets, basis):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(rank))
            for batch in batches:
                for at, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    if not at:
                        continue
                    rows = _gaussian(np.array(at), rank) if basis is None else basis[np.searchsorted(buckets, at)]
                    y = np.array(v) @ rows
                    for b, x in zip(at, v, strict=True):
                        total[b] += x * y
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tolist() for x in total.values()], pa.list_(pa.float64()))], names=["bucket", "z"])

        return run

    for _ in range(1 + power):
        parts = matrix.mapInArrow(multiply(buckets, basis), "bucket long, z array<double>")
        # a bucket has a part from each task that holds rows of the matrix, of which there are no more than rows
        total = F.aggregate(F.collect_list("z"), F.array_repeat(F.lit(0.0), rank), lambda x, y: F.zip_with(x, y, lambda p, q: p + q))
        found = parts.groupBy("bucket").agg(total.alias("z")).toArrow().combine_chunks()
        order = np.argsort(found.column("bucket").to_numpy())
        buckets = found.column("bucket").to_numpy()[order]
        z = pa.concat_arrays(found.column("z").chunks).flatten().to_numpy() if len(order) else np.zeros(0)
        sketch = z.reshape(len(order), rank)[order]
        basis = np.linalg.svd(sketch, full_matrices=False)[0] if len(buckets) else sketch
        rank_now = basis.shape[1]
        if rank_now < rank:
            basis = np.pad(basis, ((0, 0), (0, rank - rank_now)))
    return buckets, basis


class Step:
    """What all blocks need of a step's rows: buckets of words with their weights; windows of WIDTH words, STRIDE apart, which do not cross rows; hashes of runs."""

    def __init__(self, words: np.ndarray, first: np.ndarray, idf: np.ndarray):
        self.words, self.first, self.bucket = words, first, _bucket(words)
        self.weight = idf[self.bucket]
        self.energy = self.weight.astype(float) ** 2
        starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
            if b > a:
                s = np.arange(a, max(b - WIDTH, a) + STRIDE, STRIDE)
                s[-1] = max(b - WIDTH, a)
                starts.append(s)
                ends.append(np.minimum(s + WIDTH, b))
        self.starts, self.ends = np.concatenate(starts), np.concatenate(ends)
        whole = np.append(0, np.cumsum(self.energy))
        self.total = whole[self.ends] - whole[self.starts]
        self.runs: dict[int, np.ndarray] = {}

    def run_hashes(self, size: int) -> np.ndarray:
        if size not in self.runs:
            self.runs[size] = window_hashes(self.words, size)
        return self.runs[size]


class Block:
    """What a task needs to find one block's pieces: their passages' words and answers; their latent vectors; the space; the weights.

    pieces: (row of the passage, at, v); items: (row, item_id, text, answer).
    """

    def __init__(self, pieces: list[tuple[int, list[int], list[float]]], items: list[tuple[int, int, str, str | None]], buckets: np.ndarray, basis: np.ndarray, idf: np.ndarray):
        words = _of_texts([t or "" for _, _, t, _ in items])
        answers = _of_texts([a or "" for *_, a in items])
        self.rows, self.ids, self.words = [r for r, *_ in items], [i for _, i, _, _ in items], words
        self.answers = [a if len(a) else w[np.argsort(-idf[_bucket(w)], kind="stable")[:ANSWER]] for a, w in zip(answers, words, strict=True)]
        self.idf = idf
        self.row = np.zeros(BUCKETS, np.int32)  # 0: no word of the block
        self.row[buckets] = np.arange(1, len(buckets) + 1)
        self.basis = np.vstack([np.zeros((1, basis.shape[1])), basis]).astype(np.float32)
        place = {r: j for j, r in enumerate(self.rows)}
        self.item = np.array([place[r] for r, _, _ in pieces])
        self.lengths = np.array([len(w) for w in words], np.int64)
        vectors = np.array([np.array(v) @ self.basis[self.row[at]] for _, at, v in pieces], np.float32)
        self.vectors = vectors / np.maximum(np.sqrt((vectors * vectors).sum(1, keepdims=True)), 1e-6)
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # by length: hashes, ascending; passages; a sieve of the hashes
        for size in {min(SEED, len(w)) for w in words if len(w)}:
            own = [(window_hashes(w, size), j) for j, w in enumerate(words) if min(SEED, len(w)) == size]
            hashes, of = np.concatenate([h for h, _ in own]), np.concatenate([np.full(len(h), j) for h, j in own])
            order = np.argsort(hashes, kind="stable")
            sieve = np.zeros(1 << 20, bool)
            sieve[hashes >> np.uint64(44)] = True
            self.seeds[size] = hashes[order], of[order], sieve

    @cached_property
    def counts(self) -> np.ndarray:
        """How many words of each passage lie in each bucket of the block; made in the task, so that it isn't sent."""
        return np.stack([np.bincount(self.row[_bucket(w)], minlength=len(self.basis)) for w in self.words]).astype(np.int32)

    def shared_runs(self, step: Step) -> Iterator[tuple[int, int, int]]:
        """As candidates: runs of words that a passage has as well. Of a passage's runs in a row less than STRIDE apart the first stands for all."""
        last: dict[tuple[int, int], int] = {}
        first = step.first
        for size, (hashes, of, sieve) in self.seeds.items():
            found = step.run_hashes(size)
            some = np.flatnonzero(sieve[found >> np.uint64(44)])
            lo, hi = np.searchsorted(hashes, found[some], "left"), np.searchsorted(hashes, found[some], "right")
            row = np.searchsorted(first, some, "right") - 1
            for k in np.flatnonzero((hi > lo) & (some + size <= first[row + 1])).tolist():
                s, d = int(some[k]), int(row[k])
                for j in np.unique(of[lo[k] : hi[k]]).tolist():
                    if s - last.get((d, j), -STRIDE) >= STRIDE:
                        last[d, j] = s
                        yield s, s + size, j

    def _near(self, step: Step, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of windows, their ends, passages: each passage that has a piece near the window, once. row: of the step's words, as in self.row."""
        starts, ends, total = step.starts, step.ends, step.total
        own = np.append(0, np.cumsum(np.where(row > 0, step.energy, 0)))
        hot = np.flatnonzero(own[ends] - own[starts] >= COSINE**2 * total)
        found = [(np.zeros(0, np.int64),) * 3]
        for k in range(0, len(hot), 512):
            s, e, norm = starts[hot[k : k + 512]], ends[hot[k : k + 512]], np.sqrt(total[hot[k : k + 512]])
            at = s[:, None] + np.arange(WIDTH)
            inside = at < e[:, None]
            at = np.minimum(at, len(row) - 1)
            vectors = np.einsum("nw,nwk->nk", np.where(inside, step.weight[at], 0), self.basis[row[at]], optimize=True)
            i, j = np.divmod(np.flatnonzero(vectors @ self.vectors.T >= COSINE * norm[:, None]), len(self.item))
            j = self.item[j]
            if len(self.ids) < len(self.item):  # passages of several pieces
                i, j = np.divmod(np.unique(i * len(self.ids) + j), len(self.ids))
            found.append((s[i], e[i], j))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def candidates(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(start of the window, its end, passage), by word number; windows do not cross rows."""
        step = Step(words, first, self.idf)
        yield from zip(*(x.tolist() for x in self._near(step, self.row[step.bucket])), strict=True)

    def _around(self, first: np.ndarray, s: np.ndarray, e: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of candidates: the row, the first word and the end of the words on which they are decided."""
        d = np.searchsorted(first, s, "right") - 1
        return d, np.maximum(first[d], s - self.lengths[j]), np.minimum(first[d + 1], e + self.lengths[j])

    def present(self, row: np.ndarray, lo: np.ndarray, hi: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words of passage j occur among the words from lo to hi, by buckets: no less than their longest common subsequence."""
        hits = np.flatnonzero(row)
        at = row[hits]
        order = np.argsort(at.astype(np.uint16) if len(self.basis) <= 1 << 16 else at, kind="stable")  # of 16 bits by radix
        before = np.full(len(hits), -1)  # where the bucket occurred last
        same = at[order[1:]] == at[order[:-1]]
        before[order[1:][same]] = hits[order[:-1][same]]
        a, b = np.searchsorted(hits, lo), np.searchsorted(hits, hi)
        out = self.counts[j, 0].astype(np.int64)  # words in other blocks' pieces only, which may all be there
        ends = np.cumsum(b - a)
        k = 0
        while k < len(j):  # some 4 MB of words at a time, or one candidate
            m = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + (1 << 17), "right")))
            n = b[k:m] - a[k:m]
            of = np.repeat(np.arange(k, m), n)
            place = np.arange(len(of)) + np.repeat(a[k:m] - (np.cumsum(n) - n), n)
            once = before[place] < lo[of]
            of, place = of[once], place[once]
            out[k:m] += np.bincount(of - k, weights=self.counts[j[of], at[place]], minlength=m - k).astype(np.int64)
            k = m
        return out

    def find(self, step: Step) -> list[dict[int, float]]:
        """Of each row: passages found, with the share of the passage that the longest common subsequence covers."""
        words, first = step.words, step.first
        out: list[dict[int, float]] = [{} for _ in range(len(first) - 1)]
        masks: dict[int, dict[int, int]] = {}
        row = self.row[step.bucket]
        runs = np.array(list(self.shared_runs(step)), np.int64).reshape(-1, 3).T
        s, e, j = (np.append(x, y) for x, y in zip(runs, self._near(step, row), strict=True))
        some = self.lengths[j] > 0
        s, e, j = s[some], e[some], j[some]
        d, lo, hi = self._around(first, s, e, j)
        some = np.flatnonzero(self.present(row, lo, hi, j) / self.lengths[j] >= WEAK)
        for d, lo, hi, j in zip(*(x[some].tolist() for x in (d, lo, hi, j)), strict=True):
            passage = self.words[j]
            if out[d].get(j, 0) >= 1:
                continue
            around = words[lo:hi].tolist()
            if j not in masks:
                masks[j] = {}
                for i, w in enumerate(passage.tolist()):
                    masks[j][w] = masks[j].get(w, 0) | 1 << i
            share = _common(masks[j], len(passage), around) / len(passage)
            if share >= STRONG or (share >= WEAK and 2 * len(set(self.answers[j].tolist()) & set(around)) >= len(set(self.answers[j].tolist()))):
                out[d][j] = max(share, out[d].get(j, 0))
        return out


def _common(mask: dict[int, int], size: int, other: list[int]) -> int:
    """Length of the longest common subsequence, bits of the passage in parallel."""
    full = (1 << size) - 1
    v = full
    for w in other:
        if w in mask:
            u = v & mask[w]
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def _apply(docs: DataFrame, blocks: list[Block], keep: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(keep)
        for batch in batches:
            data, offsets = utf8(batch.column(n))
            for a, b in steps(offsets):
                part = batch.slice(a, b - a)
                words, first = _words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ids, best, rows = (part.column(n + k).to_pylist() for k in (1, 2, 3))
                step = Step(words, first, blocks[0].idf) if blocks else None
                for block in blocks:
                    for d, new in enumerate(block.find(step)):
                        for j, share in new.items():
                            best[d] = max(best[d], share)
                            if block.rows[j] not in rows[d]:  # not yet found by another block's piece
                                rows[d].append(block.rows[j])
                                ids[d].append(block.ids[j])
                arrays = [pa.array([sorted(x) for x in ids], pa.list_(pa.int64())), pa.array(best, pa.float64()), pa.array(rows, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*part.columns[: n + 1], *arrays], names=[*keep, "__text", "item_ids", "overlap", "__rows"])

    return docs.mapInArrow(run, docs.schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", drop: tuple[str, ...] = (), idf: np.ndarray | None = None) -> DataFrame:
    """The columns of docs without `drop`, then contaminated, item_ids (of the passages found, ascending) and overlap (the best share).

    benchmark has item_id and text, and may have answer.
    """
    bound_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in {*drop, "contaminated", "item_ids", "overlap"}]
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"), F.array().cast("array<long>").alias("item_ids"), F.lit(0.0).alias("overlap"), F.array().cast("array<long>").alias("__rows"))
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select(F.monotonically_increasing_id().alias("row"), F.col("item_id").cast("long").alias("item"), F.col("text").cast("string").alias("text"), answer.alias("answer")).filter("text is not null and item is not null")
    items = materialize(items, "passages")  # fixes the rows' numbers, by which they are dealt
    if idf is None and not items.isEmpty():
        idf = inverse_frequencies(docs, text)
    pieces = materialize(_matrix(items, idf), "pieces")
    size = pieces.agg(F.count("*").alias("n"), F.sum(F.size("at")).alias("words")).first()
    blocks = max(-(-size.n // BLOCK_ITEMS), -(-16 * (size.words or 0) // BLOCK_BYTES))
    for a in range(0, blocks, PASS_BLOCKS):
        now = []
        for k in range(a, min(a + PASS_BLOCKS, blocks)):
            part = pieces.filter(F.pmod(F.xxhash64("row", "piece"), F.lit(blocks)) == k)
            found = sorted(tuple(r) for r in part.select("row", "at", "v").collect())  # a block, of bounded size
            if found:
                whole = items.join(F.broadcast(part.select("row").distinct()), "row", "left_semi").select("row", "item", "text", "answer").collect()
                now.append(Block(found, [tuple(r) for r in whole], *latent_space(part.select("row", "at", "v"), rank=min(LATENT, len(found))), idf))
        rows = _apply(rows, now, keep)
    return rows.select(*(F.col(f"`{c}`") for c in keep), (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "overlap")


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), drop=("text",))
