import hashlib
import random

import numpy as np

from sparkloom.llm import fingerprints as fp


def slow(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distances():
    rng = random.Random(1)
    a = [bytes(rng.choice(b"abcd") for _ in range(rng.choice([0, 1, 5, 40, 63, 64]))) for _ in range(300)]
    b = [bytes(rng.choice(b"abcd") for _ in range(rng.choice([0, 1, 5, 40, 63, 64]))) for _ in range(300)]
    assert fp._distances(a, b).tolist() == [slow(x, y) for x, y in zip(a, b)]


def test_likeness():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    near, far, small = [], [], []
    for n in (30, 300, 3000):
        for _ in range(20):
            a, b = " ".join(word() for _ in range(n)), " ".join(word() for _ in range(n))
            near.append((a, fp.edited(a, b)))
            far.append((a, b))
            small.append((a, a[: len(a) // 2] + "!" + a[len(a) // 2 :]))
    score = lambda x: fp.likeness([fp.fingerprint(p.encode()) for p, _ in x], [fp.fingerprint(q.encode()) for _, q in x])
    assert np.mean(score(small)) > 0.9 and 0.35 < np.mean(score(near)) < 0.8 and np.mean(score(far)) < 0.3 and score(near).min() > 0.2
    assert fp.likeness(["3::", "3::", "3:A:B"], ["3::", "3:A:B", "96:A:B"]).tolist() == [1, 0, 0]


M32, M64 = (1 << 32) - 1, (1 << 64) - 1


def mixed(h):
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = ((h ^ (h >> shift)) * by) & M64
    return h ^ (h >> 31)


def slow_print(data):
    """A fingerprint byte by byte with Python's integers."""
    value = [mixed(b + 1) for b in data]
    block = 3
    while block * 64 < len(data):
        block *= 2

    def letters(size):
        chunks, now = [], []
        for i, v in enumerate(value):
            now.append(v)
            roll = sum((value[i - k] >> 32) * pow(0x01000193, k) for k in range(min(7, i + 1))) & M32
            roll = ((roll ^ (roll >> 15)) * 0x2C1B3C6D) & M32
            if (roll ^ (roll >> 13)) % size == size - 1:
                chunks.append(now)
                now = []
        chunks += [now] if now else []
        if len(chunks) > 64:
            chunks[63:] = [sum(chunks[63:], [])]
        return "".join(chr(fp._ALPHABET[mixed((sum(v * pow(fp._BASE, k, 1 << 64) for k, v in enumerate(c)) + len(c)) & M64) >> 58]) for c in chunks), len(chunks)

    if not data:
        return "3::"
    while block > 3 and letters(block)[1] < 32:
        block //= 2
    return f"{block}:{letters(block)[0]}:{letters(2 * block)[0]}"


def slow_likeness(p, q):
    if p == q:
        return 1.0
    (s, p1, p2), (t, q1, q2) = p.split(":"), q.split(":")
    lines = [(p1, q1), (p2, q2)] if s == t else [(p1, q2)] if int(s) == 2 * int(t) else [(p2, q1)] if int(t) == 2 * int(s) else []
    return max([1 - slow(x, y) / max(len(x), len(y)) if x or y else 1.0 for x, y in lines], default=0.0)


def test_fingerprint_against_brute_force():
    rng = random.Random(7)
    texts = [b"", b"a", b"ab" * 40, bytes(range(256)) * 3] + [" ".join(rng.choice(["the", "of", "é日", "x" * 9, "Word,"]) + str(rng.randrange(50)) for _ in range(n)).encode() for n in (3, 20, 60, 200, 500, 900)]
    texts += [t[: len(t) // 2] + t[len(t) // 3 :] for t in texts]
    prints = [slow_print(t) for t in texts]
    assert [fp.fingerprint(t) for t in texts] == prints
    pairs = [(p, q) for p in prints for q in prints]
    got = fp.likeness([p for p, _ in pairs], [q for _, q in pairs])
    assert np.allclose(got, [slow_likeness(p, q) for p, q in pairs])


def test_a_very_long_text_and_far_ids(spark):
    far = 2**62
    long = "".join(chr(97 + i * i % 23) for i in range(3_000_000))
    rows = [(far, "a"), (far + 1, long), (-far, "b"), (far - 1, "a b"), (None, "c")]
    got = {r.doc_id: r for r in fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = [far + 1, far, far - 1, -far, None, far + 1]
    text = dict(rows)
    for a, b in zip(order, order[1:]):
        e = fp.edited(text[a], text[b])
        assert got[a].edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and got[a].n_chars == len(text[a])
        assert got[a].near_edited == fp.likeness([fp.fingerprint(text[a].encode())], [fp.fingerprint(e.encode())])[0]


def test_ranges_of_one_id_are_cut(spark, monkeypatch):
    """Null ids, and rows of one id, spread over ranges by their texts."""
    monkeypatch.setattr(fp, "RANGE_BYTES", 200)
    rows = [(None, f"{i:03d} text") for i in range(200)] + [(5, f"{i:03d} other") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bounds = fp._bounds(docs.withColumn("prefix", fp.F.substring("text", 1, fp.PREFIX)))
    assert sum(b[0] is None for b in bounds) > 5 and sum(b[0] == 5 for b in bounds) > 5
    got = sorted((str(r.doc_id), r.edited_sha256) for r in fp.fingerprints(docs).collect())
    order = sorted(rows, key=lambda r: (r[0] is None, r[1]))
    assert got == sorted((str(d), hashlib.sha256(fp.edited(t, order[(i + 1) % 400][1]).encode()).hexdigest()) for i, (d, t) in enumerate(order))


def test_neighbours(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i * 7 % 50, "".join(rng.choice("ab é日\n") for _ in range(rng.randrange(300)))) for i in range(50)]
    rows += [(3, rows[0][1]), (3, "z"), (None, None), (None, "q"), (60, None), (49, "")]
    for some in (rows, rows[:1], [], [(None, "a")], [(1, "a"), (1, "a")]):
        for size in (1 << 30, 400):
            monkeypatch.setattr(fp, "RANGE_BYTES", size)
            got = fp.fingerprints(spark.createDataFrame([(d, t, 0) for d, t in some], "doc_id long, text string, span int")).collect()
            order = sorted([(d, t or "") for d, t in some], key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
            want = []
            for i, (d, t) in enumerate(order):
                e = fp.edited(t, order[(i + 1) % len(order)][1])
                want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), fp.fingerprint(t.encode())))
            assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint) for r in got), key=str) == sorted(want, key=str)
            assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
