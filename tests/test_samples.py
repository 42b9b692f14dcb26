import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sparkloom.operators.samples import counted_sample, equal_sets, largest_share, set_digests


def rows_of(seed, n=500):
    rng = random.Random(seed)
    return [(rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([None, 1, 2, 3]), i % 97, rng.choice(["x", "y", None])) for i in range(n)]


def test_counted_sample(spark):
    rows = rows_of(1)
    df = spark.createDataFrame(rows, "k string, j int, v int, t string").repartition(5)
    found = counted_sample(df, ["k", "j"], [F.desc("v")], ["v", "t"], 3)
    want = defaultdict(list)
    for k, j, v, t in rows:
        want[k, j].append((-v, v, (t is not None, t)))
    got = {(r.k, r.j): (r.n_rows, [tuple(x) for x in r["sample"]]) for r in found.collect()}
    assert got == {k: (len(x), [(v, t) for _, v, (_, t) in sorted(x)[:3]]) for k, x in want.items()}
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()
    assert counted_sample(df.limit(0), ["k"], [F.col("v")], ["v"], 2).count() == 0


def test_sets(spark):
    rows = rows_of(2, 60) + [("z", 9, 1, "x"), ("z", 9, 1, "x"), ("w", 9, 1, "x")]
    df = spark.createDataFrame(rows, "k string, j int, v int, t string").repartition(4)
    sets = defaultdict(set)
    for k, j, v, t in rows:
        sets[k, j].add((v % 3, t))
    small = df.withColumn("v", F.col("v") % 3)
    got = {(r.k, r.j): (r.n_members, r.digest) for r in set_digests(small, ["k", "j"], ["v", "t"]).collect()}
    assert {k: n for k, (n, _) in got.items()} == {k: len(s) for k, s in sets.items()}
    for a in sets:
        for b in sets:
            assert (sets[a] == sets[b]) == (got[a][1] == got[b][1])
    n = Counter(frozenset(s) for s in sets.values())
    assert sorted((r.n_members, r.n_keys) for r in equal_sets(small, ["k", "j"], ["v", "t"], "first").collect()) == sorted((len(s), c) for s, c in n.items())


def test_largest_share(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 3 + [(None,)], "k string")
    assert {(r.k, r.n_rows, round(r.share, 3)) for r in largest_share(df, ["k"], 0.3).collect()} == {("a", 6, 0.6)}
    assert largest_share(df, ["k"], 0.29).count() == 2 and largest_share(df.limit(0), ["k"], 0.1).count() == 0
