import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import packing, segments
from sparkloom.llm.shared import utf8

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = [
    "", " ", "\n", "  \n x", "a  b \n\n c\t d  ", "x<|endoftext|> y <|endoftext|><|endoftext|>", "it's we'll 's 'tis don't", "naïve café façon", "日本語 テキスト 123", "a  b  c　 d\u0085 e\x1c f", "\x00\x00 \x00a b\x00",
    "!!! ???...  ---", "\U0001f600 \U0001f468‍\U0001f469 x", "é " * 30, "w" * 23 + " " + "w" * 24 + " " + "w" * 25, "a" * 3000, "1234567 12a34b", "x   y", "tab\tand\r\nline", " lead", "trail ",
]


def encoded(texts):
    import pyarrow as pa

    ids, ends = segments.Encoder(PATH).encode(*utf8(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]


@pytest.mark.parametrize("step, slots", [(1 << 20, 1 << 21), (64, 1 << 21), (1 << 20, 64)])
def test_ids_like_the_library(monkeypatch, step, slots):
    """Whatever the size of a step, and with a table that overflows."""
    monkeypatch.setattr(segments, "STEP", step)
    monkeypatch.setattr(segments, "SLOTS", slots)
    t, rng = Tokenizer.from_file(PATH), random.Random(5)
    letters = "abcdeéßñ' .,! \n\t    \x1c0123日  xyz"
    texts = [*HARD, *("".join(rng.choices(letters, k=rng.randrange(120))) for _ in range(600)), *HARD, "".join(rng.choices(letters, k=5000))]
    for s, ids in zip(texts, encoded(texts), strict=True):
        assert ids == t.encode(s, add_special_tokens=False).ids, repr(s)


def check_plan(counts):
    """Every piece gets a place, places don't overlap, sequences have no holes, and none holds three large ones."""
    capacity, taken = len(counts) - 1, {}
    runs = packing.plan(counts)
    for length in np.flatnonzero(counts):
        own = runs[runs[:, 0] == length]
        own = own[np.argsort(own[:, 1])]
        for i, (_, r0, q, first, offset) in enumerate(own):
            r1 = own[i + 1, 1] if i + 1 < len(own) else counts[length]
            for r in range(r0, r1):
                taken.setdefault(first + (r - r0) // q, []).append((offset + (r - r0) % q * length, int(length)))
    assert sum(map(len, taken.values())) == counts.sum()
    for places in taken.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity and sum(3 * n > capacity for _, n in places) <= 2
    assert sorted(taken) == list(range(len(taken)))
    return len(taken)


def slow_best_fit(counts):
    """A piece at a time: large ones matched, the longest with the longest that fits; then each where it leaves least."""
    capacity = len(counts) - 1
    items = sorted((n for n in range(capacity + 1) for _ in range(counts[n])), reverse=True)
    large, gaps = [x for x in items if 3 * x > capacity], []
    while large:
        a = large.pop(0)
        b = next((x for x in large if a + x <= capacity), 0)
        if b:
            large.remove(b)
        gaps.append(capacity - a - b)
    for x in (x for x in items if 3 * x <= capacity):
        fit = min((g for g in gaps if g >= x), default=None)
        if fit is None:
            gaps.append(capacity - x)
        else:
            gaps.remove(fit)
            gaps.append(fit - x)
    return len(gaps)


def test_plan_like_a_slow_one():
    rng = np.random.default_rng(4)
    for capacity in (1, 2, 3, 7, 30, 64):
        for _ in range(40):
            counts = rng.integers(0, 6, capacity + 1) * (rng.random(capacity + 1) < rng.random())
            counts[0] = 0
            assert check_plan(counts) == slow_best_fit(counts)


def test_plan_of_very_many():
    """The work depends on the lengths alone."""
    counts = np.full(2049, 10**10)
    counts[0] = 0
    runs = packing.plan(counts)
    assert len(runs) < 50_000
    total = int(np.arange(2049) @ counts)
    assert int(runs[:, 3].max()) * 2048 < total * 1.2


def test_no_needless_sequences():
    rng = np.random.default_rng(8)
    counts = np.bincount(np.clip(rng.lognormal(5, 1.2, 20_000).astype(int), 1, 2048), minlength=2049)
    assert check_plan(counts) <= -(-int(np.arange(2049) @ counts) // 2048) + 1


def check_rows(rows, texts, capacity):
    t = Tokenizer.from_file(PATH)
    want, at = Counter(), {}
    for doc, text in texts:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        cut = [x for x in range(len(ids), 0, -capacity)][::-1]
        for i, stop in enumerate(cut):
            start = max(0, stop - capacity)
            want[doc, i, start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes())] += 1
    for r in rows:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    for places in at.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))] and sum(n for _, n in places) <= capacity


def test_pack(spark):
    texts = [(i, "word " * (i % 90)) for i in range(300)] + [(7, None), (7, None), (None, ""), (9, "x y " * 500), (10, "one"), (10, "one")]
    docs = spark.createDataFrame([(d, t, 1, "z") for d, t in texts], "doc_id long, text string, piece int, rank string").repartition(5)
    out = packing.pack(docs, PATH, 40)
    check_rows(out.collect(), texts, 40)
    whole = packing.sequences(out).collect()
    assert sum(len(r.ids) for r in whole) == out.agg({"length": "sum"}).first()[0] and max(len(r.ids) for r in whole) <= 40
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_given_documents(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    rows = packing.op12_packing(spark, path).collect()
    check_rows(rows, [(r.doc_id, r.text) for r in docs.collect()], 2048)
    assert len({r.sequence_id for r in rows}) <= -(-sum(r.length for r in rows) // 2048) + 1


def test_a_long_text():
    """In steps: 20 MB of text take about the memory of its ids."""
    import tracemalloc

    import pyarrow as pa

    data, offsets = utf8(pa.array(["some words that repeat, over and over\n" * 500_000]))
    e = segments.Encoder(PATH)
    tracemalloc.start()
    ids, _ = e.encode(data, offsets)
    assert tracemalloc.get_traced_memory()[1] < 14 * len(data)
    assert len(ids) % 500_000 == 0


def test_new_segments_take_one_core():
    """A task has one core; the library's threads for all of them took as much again. In a process of its own, as the library may have been set up in this one."""
    import os
    import subprocess
    import sys

    code = f"""
import sys, time
sys.path[:0] = {sys.path!r}
import pyarrow as pa
from sparkloom.llm import segments
from sparkloom.llm.shared import utf8
e, texts = segments.Encoder({PATH!r}), utf8(pa.array([" ".join(f"w{{i}}x{{i * 7919}}" for i in range(60_000))]))
a, b = time.process_time(), time.thread_time()
e.encode(*texts)
print((time.process_time() - a) / (time.thread_time() - b))
"""
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, check=True)
    assert float(done.stdout) < 1.3
