"""Token ids of a byte-level byte-pair vocabulary, a segment of text at a time.

The library's pre-tokeniser never lets a token run from a character that is no white space into white space that
follows, and looks ahead only within a run of white space. So a text may be cut wherever such a run begins, and the
ids of the parts, each encoded by the library itself, are the text's. A table keyed by a segment's own bytes (up to
24 of them, exact, not a hash of them) keeps ids that the library gave; whole arrays of segments are looked up at once.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

from .shared import mix

#: Bytes of text that are cut and looked up at once; a longer text goes in several such steps.
STEP = 1 << 20
#: Slots of a task's table, 32 bytes each, and the share of them beyond which it starts anew.
SLOTS, FULL = 1 << 21, 0.6
#: Slots that a key may lie in.
PROBES = 8
#: Longer segments that are kept, up to so many bytes each.
LONG_KEPT, LONG_BYTES = 50_000, 256

_KEY = 24
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def cuts(data: np.ndarray) -> np.ndarray:
    """Where a segment may begin: at a space or line feed behind an ASCII sign or a letter of two bytes.

    Behind anything else there is no cut, for some three-byte characters are white space: the segment is only longer.
    The second byte of a two-byte character begins with C3 or more before it; of white space only C2 does.
    """
    if len(data) < 2:
        return np.zeros(0, np.int64)
    before = data[:-1]
    solid = (before > 0x20) & (before < 0x7F)
    solid[1:] |= (data[:-2] >= 0xC3) & (data[:-2] <= 0xDF)
    white = (data[1:] == 0x20) | (data[1:] == 0x0A)
    return np.flatnonzero(solid & white) + 1


def _keys(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first 24 bytes of each segment as three numbers; data has 24 bytes to spare at its end."""
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    return np.stack([words[starts + 8 * i] & _MASKS[np.clip(sizes - 8 * i, 0, 8)] for i in range(3)], 1)


class Table:
    """Open addressing over rows of (three key words, place): place holds size, number of ids and where they start."""

    def __init__(self) -> None:
        self.rows, self.used = np.zeros((SLOTS, 4), np.uint64), 0
        self.ids, self.end = np.zeros(1 << 16, np.int32), 0

    def keep(self, ids: np.ndarray) -> int:
        """Appends ids; where they start."""
        at = self.end
        while at + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.int32)])
        self.ids[at : at + len(ids)] = ids
        self.end += len(ids)
        return at

    @staticmethod
    def slots(keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        h = mix(keys[:, 0] + mix(keys[:, 1] + mix(keys[:, 2] + sizes.astype(np.uint64))))
        return (h & np.uint64(SLOTS - 1)).astype(np.int64)

    def find(self, keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The place of each key, 0 where it isn't known."""
        out, slot, open_ = np.zeros(len(keys), np.uint64), self.slots(keys, sizes), np.arange(len(keys))
        for _ in range(PROBES):
            row = self.rows[slot]
            key = keys[open_] if len(open_) < len(keys) else keys
            hit = (row[:, 0] == key[:, 0]) & (row[:, 1] == key[:, 1]) & (row[:, 2] == key[:, 2]) & ((row[:, 3] & np.uint64(31)) == sizes[open_].astype(np.uint64))
            out[open_[hit]] = row[hit, 3]
            on = np.flatnonzero(~hit & (row[:, 3] != 0))
            if not len(on):
                break
            open_, slot = open_[on], (slot[on] + 1) & (SLOTS - 1)
        return out

    def put(self, keys: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> None:
        """Of different keys that aren't known. One that finds no slot within PROBES is not kept."""
        slot = self.slots(keys, sizes)
        for _ in range(PROBES):
            free = self.rows[slot, 3] == 0
            first = np.zeros(len(slot), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            now = np.flatnonzero(free & first)
            self.rows[slot[now], :3], self.rows[slot[now], 3] = keys[now], places[now]
            self.used += len(now)
            rest = np.setdiff1d(np.arange(len(slot)), now, assume_unique=True)
            if not len(rest):
                return
            keys, places, slot = keys[rest], places[rest], (slot[rest] + 1) & (SLOTS - 1)


class Encoder:
    """Ids as the library gives them without special tokens, padding or truncation, from the file at `path`."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core: the library's threads for all of them cost twice the time
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.table, self.long = Table(), {}

    def _by_library(self, segments: list[bytes]) -> list[list[int]]:
        """Without the places of tokens in the text, which the library would work out besides."""
        return [e.ids for e in self.library.encode_batch_fast([s.decode() for s in segments], add_special_tokens=False)]

    def _learn(self, raw: bytes, keys: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Places of short segments that the table lacks, which then has them."""
        number: dict[bytes, int] = {}
        back = np.array([number.setdefault(raw[a : a + n], len(number)) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)])
        first = np.empty(len(number), np.int64)
        first[back[::-1]] = np.arange(len(back))[::-1]
        ids = self._by_library(list(number))
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        at = self.table.keep(np.fromiter(chain.from_iterable(ids), np.int32, counts.sum())) + np.append(0, np.cumsum(counts)[:-1])
        places = sizes[first].astype(np.uint64) | counts.astype(np.uint64) << np.uint64(5) | at.astype(np.uint64) << np.uint64(16)
        self.table.put(keys[first], sizes[first], places)
        return places[back]

    def _long(self, raw: bytes, starts: list[int], sizes: list[int]) -> list[np.ndarray]:
        segments = [raw[a : a + n] for a, n in zip(starts, sizes, strict=True)]
        new = list(dict.fromkeys(s for s in segments if s not in self.long))
        found = {s: np.array(x, np.int32) for s, x in zip(new, self._by_library(new), strict=True)}
        out = [found[s] if s in found else self.long[s] for s in segments]
        if len(self.long) + len(new) > LONG_KEPT:
            self.long.clear()
        self.long.update((s, x) for s, x in found.items() if len(s) <= LONG_BYTES)
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of rows of UTF-8: (ids, offsets of the rows in them)."""
        begins = np.zeros(len(data) + 1, bool)
        begins[cuts(data)] = begins[offsets] = True
        places = np.flatnonzero(begins)
        flat, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        a = 0
        while a < len(places) - 1:  # runs of segments of about STEP bytes, one at least
            b = min(max(a + 1, int(np.searchsorted(places, places[a] + STEP, "right")) - 1), len(places) - 1)
            ids, n = self._segments(data[places[a] : places[b]], places[a : b + 1] - places[a])
            flat.append(ids)
            counts.append(n)
            a = b
        ends = np.append(0, np.cumsum(np.concatenate(counts)))
        return np.concatenate(flat), ends[np.searchsorted(places, offsets)]

    def _segments(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments between bounds, one after another, and each one's number of ids."""
        if self.table.used > FULL * SLOTS:
            self.table = Table()
        starts, sizes = bounds[:-1], np.diff(bounds)
        raw = data.tobytes()
        padded = np.frombuffer(raw + bytes(_KEY), np.uint8)
        short = np.flatnonzero(sizes <= _KEY)
        keys = _keys(padded, starts[short], sizes[short])
        found = self.table.find(keys, sizes[short])
        new = np.flatnonzero(found == 0)
        if len(new):
            found[new] = self._learn(raw, keys[new], starts[short[new]], sizes[short[new]])
        n, at, known = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), self.table.ids[: self.table.end]
        n[short], at[short] = (found >> np.uint64(5)).astype(np.int64) & 2047, (found >> np.uint64(16)).astype(np.int64)
        if len(short) < len(starts):
            rest = np.flatnonzero(sizes > _KEY)
            ids = self._long(raw, starts[rest].tolist(), sizes[rest].tolist())
            n[rest] = [len(x) for x in ids]
            at[rest] = len(known) + np.append(0, np.cumsum(n[rest])[:-1])
            known = np.concatenate([known, *ids])
        ends = np.cumsum(n)
        return known[np.repeat(at - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], n
