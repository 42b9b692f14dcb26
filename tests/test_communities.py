import hashlib
import random
from collections import defaultdict

import pytest

from sparkloom.operators.communities import communities, modularity


def slow(edges, rounds):
    w, degree = defaultdict(int), defaultdict(int)
    for a, b, n in edges:
        if a is not None and b is not None and a != b:
            w[a, b] += n
            w[b, a] += n
            degree[a] += n
            degree[b] += n
    total, at, still = sum(degree.values()), {x: x for x in degree}, 0
    for r in range(rounds):
        mass, members, new = defaultdict(int), defaultdict(int), dict(at)
        for x, c in at.items():
            mass[c] += degree[x]
            members[c] += 1
        for x, own in at.items():
            if (hashlib.md5(str(x).encode()).hexdigest()[0] >= "8") != (r % 2 == 1):
                continue
            seen = defaultdict(int, {own: 0})
            for (a, b), n in w.items():
                if a == x:
                    seen[at[b]] += n
            fits = [c for c in seen if c == own or members[own] > 1 or members[c] > 1 or c < own]
            new[x] = min(fits, key=lambda c: (-(total * seen[c] - degree[x] * (mass[c] - degree[x] * (c == own))), c != own, c))
        still = still + 1 if new == at else 0
        at = new
        if still == 2:
            break
    return at


def got(df):
    rows = df.collect()
    assert len({r.node for r in rows}) == len(rows)
    return {r.node: r.community for r in rows}


@pytest.mark.parametrize("seed, rounds", [(1, 0), (2, 2), (3, 7)])
def test_like_a_slow_one(spark, seed, rounds):
    rng = random.Random(seed)
    edges = [(rng.randrange(30), rng.randrange(30), rng.randrange(1, 4)) for _ in range(60)] + [(7, 7, 5), (None, 3, 1), (4, None, 1), (40, 41, 1), (41, 40, 1)]
    assert got(communities(spark.createDataFrame(edges, "src int, dst int, weight int"), rounds)) == slow(edges, rounds)


def test_planted_groups(spark):
    """Four dense groups of 12 with a few edges between them come out as they are."""
    rng = random.Random(5)
    edges = [(f"n{g}_{a}", f"n{g}_{b}", 1) for g in range(4) for a in range(12) for b in range(a) if rng.random() < 0.7]
    edges += [(f"n{g}_{rng.randrange(12)}", f"n{(g + 1) % 4}_{rng.randrange(12)}", 1) for g in range(4)]
    df = spark.createDataFrame(edges, "src string, dst string, weight int")
    found = communities(df, 12)
    groups = defaultdict(set)
    for node, c in got(found).items():
        groups[c].add(node.split("_")[0])
    assert len(groups) == 4 and all(len(x) == 1 for x in groups.values())
    assert modularity(df, found) > 0.6 > modularity(df, communities(df, 0))


def test_a_hub(spark):
    """A node with a third of all edges: its links reach the tasks as partial sums."""
    edges = spark.range(3000).selectExpr("if(id % 3 = 0, 0, id) as src", "id + 1 as dst")
    at = got(communities(edges, 4))
    assert at == slow([(r.src, r.dst, 1) for r in edges.collect()], 4)


def test_empty(spark):
    assert communities(spark.createDataFrame([], "src int, dst int")).count() == 0
    assert communities(spark.createDataFrame([(1, 1), (None, 2)], "src int, dst int")).count() == 0


def test_rounds_move_numbers(spark, monkeypatch):
    """What a round writes holds no names: its rows keep their size, however long the names are."""
    from sparkloom.operators import communities as c

    kept, keep = {}, c.materialize

    def note(df, name):
        kept[name] = dict(df.dtypes)
        return keep(df, name)

    monkeypatch.setattr(c, "materialize", note)
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}", 1) for _ in range(80)]
    assert got(communities(spark.createDataFrame(edges, "src string, dst string, weight int"), 4)) == slow(edges, 4)
    assert all("string" not in kept[name].values() for name in ("links", "seen", "moves", "state"))
