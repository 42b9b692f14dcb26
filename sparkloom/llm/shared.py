"""Helpers that the operators share: intermediate tables and array kernels over UTF-8 text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from sparkloom.sources.tables import discard, materialize  # noqa: F401
from sparkloom.sources.tables import run_folder as shared_folder  # noqa: F401

#: Text handed to one numpy step, in bytes: keeps temporary arrays within some 12 MB. A longer document is a step of its own.
STEP_BYTES = 1 << 18

#: Rows that Spark hands to a Python worker at once, in bytes. Spark's own bound of 64 MB is held several times
#: over, by the JVM and by the worker, for each core. Buffers of a batch of this size fit the chunks that the JVM's
#: pool keeps and uses again; larger ones are allocated one by one outside its heap, which leaves gaps that add up.
BATCH_BYTES = 1 << 20

#: Rows that a scan of Parquet decodes at once. Spark's own 4,096 texts are one array of 16 to 32 MB a task, for which
#: the JVM has to find room in one piece, and so takes a larger heap.
READ_ROWS = 512


def bound_batches(spark: SparkSession) -> None:
    """Sets the session's bounds on Arrow batches to BATCH_BYTES and on those of scans to READ_ROWS where it has none of its own. A longer row is a batch by itself."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(most))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Cuts rows into runs [a, b) of about `most` bytes, one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: Odd base of the polynomial hash of bytes, modulo 2**64, and its inverse.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def powers(base: int, n: int, cache: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    """base**0 to base**(n-1) modulo 2**64."""
    have = cache.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = cache[base] = np.multiply.accumulate(have)
    return have[:n]


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (a run without 0x20 and 0x09-0x0D, within one row), and of each row its first word's number, with the total at the end."""
    n = len(data)
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_LETTER = np.ones(256, bool)  # bytes of words: all but ASCII punctuation
_LETTER[[b for b in range(33, 127) if not chr(b).isalnum()]] = False


def trimmed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words without ASCII punctuation at their ends; a word of punctuation alone is empty, at its end."""
    lo, hi = starts.copy(), ends.copy()
    odd = np.flatnonzero(~(_LETTER[data[starts]] & _LETTER[data[ends - 1]]))  # most words have nothing to lose
    for _ in range(4):  # and most of the others few marks
        odd = odd[lo[odd] < hi[odd]]
        left, right = ~_LETTER[data[lo[odd]]], ~_LETTER[data[hi[odd] - 1]]
        lo[odd[left]] += 1
        right &= lo[odd] < hi[odd]
        hi[odd[right]] -= 1
        odd = odd[left | right]
        if not len(odd):
            break
    else:
        at = np.append(np.flatnonzero(_LETTER[data]), len(data))
        lo[odd] = np.minimum(at[np.searchsorted(at, lo[odd])], hi[odd])
        odd = odd[lo[odd] < hi[odd]]
        hi[odd] = at[np.searchsorted(at, hi[odd]) - 1] + 1
    none = lo >= hi
    lo[none] = hi[none] = ends[none]
    return lo, hi


#: Bytes from which on a span gets a second hash: a polynomial modulo 2**64 has structured collisions (Thue-Morse words), from some 500 letters on.
_LONG_SPAN = 64


def _multilinear(letters: np.ndarray) -> np.uint64:
    """The sum of each byte's number times a number of its place: no base, so no structure that its powers share."""
    places = mix(np.arange(1, len(letters) + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    return (letters * places).sum(dtype=np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool, twice: bool = False) -> np.ndarray:
    """A 64-bit hash of each span of bytes; fold: A-Z count as a-z; twice: long spans get the second hash as well."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _BYTES)[data] * powers(_BASE, n), out=sums[1:])
    h = sums[ends]
    h -= sums[starts]
    h *= powers(_INVERSE, n + 1)[starts]
    h += (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    for i in np.flatnonzero(ends - starts >= _LONG_SPAN).tolist() if twice else ():
        h[i] ^= mix(_multilinear((_FOLDED if fold else _BYTES)[data[starts[i] : ends[i]]])[None])[0]
    return mix(h)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp: the hash of each run of `size` word hashes, from a running polynomial sum modulo 2**64."""
    n = len(words)
    if n < size:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * powers(_BASE, n), out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * powers(_INVERSE, n - size + 1))
