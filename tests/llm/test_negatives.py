import math
import random

import numpy as np
import pytest

from sparkloom.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, rank string"


def slow(rows, anchors, k=5, m=10):
    kept = [(i, lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept = [r for r in kept if sum(x * x for x in r[2]) < 1 << 59]
    out = []
    for i, lab, v in kept:
        if i % anchors:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in kept if j != i)  # noqa: B905
        for p, j, _ in [x for x in scored if x[2] == lab][:k]:
            found = [(n, s) for s, n, other in scored if other != lab and 30 * -p <= 100 * -s <= 90 * -p][:m]
            out += [(i, j, at + 1, n, -p, -s) for at, (n, s) in enumerate(found)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)


def got(df):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


@pytest.mark.parametrize("numbers, block", [(1 << 20, 4096), (60, 7)])
def test_like_a_slow_one(spark, monkeypatch, numbers, block):
    """In one block of anchors and in several, of rows as well."""
    monkeypatch.setattr(negatives, "ANCHOR_NUMBERS", numbers)
    monkeypatch.setattr(negatives, "_ROWS", block)
    monkeypatch.setattr(negatives, "_SOME", max(2, block // 4))
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.0, -0.25, 0.0, 0.3, 0.31, 1.0, 1.5]) for _ in range(6)], rng.randrange(3)) for i in range(150)]
    rows += [(i, [0.3, 1.0], 1) for i in range(3)] + [(10, [1.0] * 6, 0), (10, [1.0] * 6, 1), (20, [1.0] * 6, 2), (20, [1.0] * 6, 2)]
    rows += [(None, [1.0] * 6, 0), (160, None, 1), (170, [1.0] * 6, None), (180, [1.0] * 5 + [None], 1), (190, [math.nan] * 6, 1), (200, [math.inf] * 6, 1), (210, [3e38] * 6, 1), (220, [], 1), (230, [-1.0] * 9, 2), (240, [1e6] * 6, 2), (250, [-9e5] * 6, 1), (251, [9e5] * 6, 1)]
    assert got(negatives.mine(frame(spark, rows), anchors=10)) == slow(rows, 10)


def test_empty(spark):
    rows = [(1, [1.0], 0), (3, [1.0], 1)]
    assert negatives.mine(frame(spark, rows), anchors=10).count() == 0  # no anchor
    assert negatives.mine(frame(spark, rows).limit(0)).count() == 0
    assert negatives.mine(frame(spark, [(10, [1.0], 0), (3, [1.0], 1)]), anchors=10).count() == 0  # no positive


@pytest.mark.parametrize("most, width", [(3, 64), (256, 64), (2**20, 64), (2**26, 64), (2**22, 300), (5, 1)])
def test_scores_are_exact(most, width):
    rng = np.random.default_rng(most)
    a, b = rng.integers(-most, most + 1, (20, width)), rng.integers(-most, most + 1, (30, width))
    b[0], a[0] = most, -most
    norms = max((x * x).sum() for x in np.concatenate([a, b]))
    s = negatives.Scores(a, negatives.primes(int(norms)))
    assert np.array_equal(s.of(slice(None), s.rows(b)), a @ b.T)
    assert all(all(p % q for q in range(2, p)) and negatives.WIDTH * ((p - 1) // 2) ** 2 < 1 << 24 for p in s.moduli)
