"""Byte-pair encoding and decoding by batched numpy merge rounds.

The distinct words of a batch lie as symbols in one flat array. A round looks up the rank of every pair of
neighbours by binary search over the sorted pair keys, finds each word's lowest rank, and merges all of that
word's pairs of that rank, from the left. Rounds end when no pair has a rank. A word of more than LONG bytes, in
which nearly every pair of rules would cost a round, takes its pairs from a heap by rank and place instead: the same ids.

The vocabulary file of a public tokenizer is a parameter. It is read on the driver, whose arrays (one row per
merge rule, a few hundred kB, bounded by the file) go to the executors with the function.

A text longer than PIECE characters is encoded in pieces that end at white space, which no word holds.

Defined cases: a null text counts as empty and has no ids; repeated rows are encoded each; other columns pass, but
for those named like a result.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bound_batches

#: White space as the vocabulary's normaliser has it (the Unicode property White_Space).
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Words kept with their ids by a task, about 400 bytes each; beyond it the table starts anew.
CACHE_WORDS = 150_000
#: Rows turned into ids at once.
_ROWS = 512
#: Bytes of a word beyond which a heap takes the place of rounds; it is not kept with its ids.
LONG = 256
#: Characters of a text that are turned into words at once.
PIECE = 1 << 20


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself where printable in Latin-1, else the next from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Arrays of one word-level BPE file (lower case, words ended by a suffix)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, letters = whole["model"], _byte_letters()
        self.ids = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in whole["added_tokens"]}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for token, i in [*self.ids.items(), *self.special.items()]:
            self.tokens[i] = token
        self.base = np.array([[self.ids[x], self.ids[x + suffix]] for x in letters], np.int64)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        keys = np.array([(self.ids[a] << 32) | self.ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([self.ids[a + b] if a + b in self.ids else self.ids[a.removesuffix(suffix) + b] for a, b in pairs], np.int64)


_NONE = np.int32(2**31 - 1)


def merge_words(v: Vocabulary, words: list[bytes]) -> list[bytes]:
    """The ids of each word (non-empty UTF-8), as the bytes of an int32 array."""
    data, lengths = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], np.int64)
    word = np.repeat(np.arange(len(words)), lengths)
    last = np.zeros(len(data), np.int64)
    last[np.cumsum(lengths) - 1] = 1
    symbols = v.base[data, last]
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbols):
        key = (symbols[:-1] << 32) | symbols[1:]
        at = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
        rank = np.where((v.keys[at] == key) & (word[:-1] == word[1:]), v.ranks[at], _NONE)
        rank = np.append(rank, _NONE)
        begins = np.flatnonzero(np.diff(word, prepend=-1))
        least = np.minimum.reduceat(rank, begins)
        sizes = np.diff(np.append(begins, len(word)))
        least = np.repeat(least, sizes)
        open_ = least != _NONE
        done.append((word[~open_], symbols[~open_]))
        symbols, word, rank, least = symbols[open_], word[open_], rank[open_], least[open_]
        if not len(symbols):
            break
        hit = rank == least
        # of a run of overlapping pairs (a a a), every second one counts, from the left
        run = np.flatnonzero(hit & ~np.append(False, hit[:-1]))
        since = np.arange(len(hit)) - np.repeat(np.append(0, run), np.diff(np.append(np.append(0, run), len(hit))))
        hit &= since % 2 == 0
        place = np.flatnonzero(hit)
        symbols[place] = v.made[rank[place]]
        keep = np.ones(len(symbols), bool)
        keep[place + 1] = False
        symbols, word = symbols[keep], word[keep]
    word, symbols = np.concatenate([x[0] for x in done]), np.concatenate([x[1] for x in done])
    order = np.argsort(word, kind="stable")
    ids, cuts = symbols[order].astype(np.int32).tobytes(), [0, *(4 * np.cumsum(np.bincount(word, minlength=len(words)))).tolist()]
    return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def merge_long(v: Vocabulary, rules: dict[int, int], word: bytes) -> bytes:
    """The ids of one long word, as the bytes of an int32 array. rules: the rank of each pair's key."""
    n = len(word)
    last = np.zeros(n, np.int64)
    last[-1] = 1
    symbols = array("i", v.base[np.frombuffer(word, np.uint8), last].astype(np.int32).tobytes())
    before, after = array("q", range(-1, n - 1)), array("q", range(1, n + 1))

    def rank(i: int) -> int:
        return rules.get((symbols[i] << 32) | symbols[after[i]], -1)

    heap = [r << 40 | i for i in range(n - 1) if (r := rank(i)) >= 0]
    heapq.heapify(heap)
    while heap:
        r, i = divmod(heapq.heappop(heap), 1 << 40)
        j = after[i]
        if symbols[i] < 0 or j >= n or rank(i) != r:  # one of the two has been merged since
            continue
        symbols[i], symbols[j] = v.made[r], -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
        for x in (before[i], i):
            if x >= 0 and after[x] < n and (new := rank(x)) >= 0:
                heapq.heappush(heap, new << 40 | x)
    return np.array([x for x in symbols if x >= 0], np.int32).tobytes()


class Encoder:
    """encode(texts) gives arrays of ids, decode(ids) the text; keeps the ids of words it has met, up to CACHE_WORDS."""

    def __init__(self, v: Vocabulary):
        self.v, self.cache, self.rules = v, {}, {}
        self.word = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
        self.space = regex.compile(f"[{_SPACE}]")
        self.special = regex.compile("|".join(map(regex.escape, sorted(v.special, key=len, reverse=True)))) if v.special else None

    def words(self, text: str) -> list[str]:
        """Of a text between special tokens. White space only separates; a final sigma is lowered like any other."""
        text = text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.word.findall(text.lower())

    def pieces(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > PIECE:
            m = self.space.search(text, at + PIECE)
            end = m.end() if m else len(text)
            yield text[at:end]
            at = end
        yield text[at:]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = [None if len(t) > PIECE else t for t in texts]
        some = iter(self._encode([t for t in out if t is not None]))
        return [np.concatenate([self._encode([p])[0] for p in self.pieces(t)]) if o is None else next(some) for o, t in zip(out, texts, strict=True)]

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        rows = []
        for t in texts:
            if self.special is None or not self.special.search(t):
                rows.append(self.words(t))
                continue
            row, at = [], 0
            for m in self.special.finditer(t):
                row += [*self.words(t[at : m.start()]), self.v.special[m.group()]]
                at = m.end()
            rows.append(row + self.words(t[at:]))
        met = set().union(*rows)
        if len(self.cache) + len(met) > CACHE_WORDS:
            self.cache.clear()
        new = [w for w in met if w not in self.cache]
        self.cache.update((w, np.int32(w).tobytes()) for w in new if not isinstance(w, str))
        plain = [w for w in new if isinstance(w, str)]
        bytes_ = [w.encode() for w in plain]
        long = [(w, b) for w, b in zip(plain, bytes_, strict=True) if len(b) > LONG]
        short = [(w, b) for w, b in zip(plain, bytes_, strict=True) if len(b) <= LONG]
        if short:
            self.cache.update(zip([w for w, _ in short], merge_words(self.v, [b for _, b in short]), strict=True))
        if long and not self.rules:
            self.rules = dict(zip(self.v.keys.tolist(), self.v.ranks.tolist(), strict=True))
        self.cache.update((w, merge_long(self.v, self.rules, b)) for w, b in long)
        found = [np.frombuffer(b"".join(map(self.cache.__getitem__, r)), np.int32) for r in rows]
        for w, _ in long:
            del self.cache[w]
        return found

    def decode(self, ids: np.ndarray) -> str:
        """The file has no decoder: tokens joined by one space, special ones included."""
        return " ".join(map(self.v.tokens.__getitem__, ids.tolist()))


def encode(docs: DataFrame, vocabulary: str, text: str = "text", decoded: bool = True, drop: tuple[str, ...] = ()) -> DataFrame:
    """The columns of docs without `drop`, then n_tokens, ids (array<int>) and, if asked for, the decoded text."""
    bound_batches(docs.sparkSession)
    v = Vocabulary(vocabulary)
    keep = [c for c in docs.columns if c not in {*drop, "n_tokens", "ids", "decoded"}]
    plain = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(v)
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                ids = e.encode([t or "" for t in batch.column(len(keep)).to_pylist()])
                n = np.array([len(x) for x in ids], np.int64)
                columns = [*batch.columns[: len(keep)], pa.array(n), pa.ListArray.from_arrays(np.append(0, np.cumsum(n)).astype(np.int32), pa.array(np.concatenate(ids)))]
                if decoded:
                    columns.append(pa.array([e.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_tokens", "ids", *["decoded"] * decoded])

    schema = plain.drop("__text").schema.add("n_tokens", "long").add("ids", T.ArrayType(T.IntegerType()))
    return plain.mapInArrow(run, schema.add("decoded", "string") if decoded else schema)


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode(docs, public_tokenizers.path("word_bpe_49k.json"), drop=("text",))
    return out.select("doc_id", "n_tokens", F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
