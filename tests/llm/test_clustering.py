import hashlib
import math

import numpy as np
import pytest

from sparkloom.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string"


def slow(rows, k, rounds, seed, dimensions):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v):
            v = [math.floor(1024 * float(np.float32(x))) for x in v]
            if max(map(abs, v)) < clustering.LIMIT:
                kept.append((vec_id, v))
    digest = lambda i: (i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "")
    cs = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min(range(len(cs)), key=lambda i: (far(v, cs[i]), i))
    for _ in range(rounds):
        at = [near(v) for _, v in kept]
        own = [[v for (_, v), a in zip(kept, at, strict=True) if a == c] for c in range(len(cs))]
        cs = [[sum(x) // len(o) for x in zip(*o, strict=True)] if o else c for o, c in zip(own, cs, strict=True)]
    out = [(i, near(v), far(v, cs[near(v)])) for i, v in kept]
    inertia = [sum(d for _, c, d in out if c == k) for k in range(len(cs))]
    return sorted([(str(i), c, d, inertia[c], sum(inertia), hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest(), cs[c]) for i, c, d in out])


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(3)


def got(df):
    return sorted([(str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256, r.centroid) for r in df.collect()])


@pytest.mark.parametrize("rounds", [0, 1, 10])
def test_like_a_slow_one(spark, rounds):
    rng = np.random.default_rng(rounds)
    rows = [(i, rng.normal(rng.integers(0, 3), 0.2, 5).round(2).tolist()) for i in range(120)] + [(i, [0.5] * 5) for i in range(40)]
    rows += [(None, [1.0] * 5), (500, [0.1] * 4), (501, None), (502, [0.1] * 4 + [None]), (503, [0.1] * 4 + [math.nan]), (504, [math.inf] * 5), (505, [0.1] * 6), (506, []), (507, [1e30] * 5), (508, [-3e5] * 5), (509, [131000.0, -131000.0, 0.0, 7.5, -0.001])]
    assert got(clustering.cluster(frame(spark, rows), 8, rounds, "3", 5)) == slow(rows, 8, rounds, "3", 5)


def test_few_and_none(spark):
    rows = [(1, [0.25, 0.5]), (1, [0.25, 0.5]), (2, [0.25, 0.5])]
    assert got(clustering.cluster(frame(spark, rows), 8, 4, "3", 2)) == slow(rows, 8, 4, "3", 2)
    assert {r[1] for r in slow(rows, 8, 4, "3", 2)} == {0}
    nothing = clustering.cluster(frame(spark, rows).limit(0), dimensions=2)
    assert nothing.count() == 0 and nothing.columns == clustering.cluster(frame(spark, rows), dimensions=2).columns


def test_tables_against_differences():
    """Narrow and wide ranges of values, distances as of plain differences."""
    rng = np.random.default_rng(1)
    for most in (5, 1000, clustering.LIMIT - 1):
        v, c = rng.integers(-most, most, (500, 64)), rng.integers(-most, most, (8, 64))
        assert np.array_equal(clustering.distances(v, c), ((v[None] - c[:, None]) ** 2).sum(2))
