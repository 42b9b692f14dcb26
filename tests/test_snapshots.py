import json
import os
import random

from sparkloom.operators.snapshots import commit, current, difference, snapshot

SCHEMA = "path string, text string, n int, other int"


def slow(old, new):
    out = []
    for k in old.keys() | new.keys():
        a, b = old.get(k), new.get(k)
        if a == b:
            continue
        if a is not None and b is not None:
            out.append((k, "changed", None))
        elif a is None:
            before = [x for x, c in old.items() if c == b and x not in new]
            out.append((k, "moved", min(before)) if before else (k, "added", None))
        else:
            after = [x for x, c in new.items() if c == a and x not in old]
            out.append((k, "gone", min(after)) if after else (k, "removed", None))
    return sorted(map(str, out))


def frame(spark, rows):
    return snapshot(spark.createDataFrame([(k, *c, 1) for k, c in rows.items()], SCHEMA).repartition(3), "path", ["text", "n"])


def test_difference(spark):
    rng = random.Random(1)
    old = {f"p{i}": (rng.choice(["", None, "a", "b", f"t{i}"]), rng.choice([None, 1])) for i in range(60)}
    new = {}
    for k, c in old.items():
        kind = rng.randrange(6)
        if kind < 4:
            new[k if kind < 3 else f"{k}x"] = c if kind != 2 else (f"{c[0]}!", c[1])
    new |= {"q1": ("fresh", 1), "q2": ("", None)}
    got = difference(frame(spark, old), frame(spark, new))
    assert sorted(str(tuple(r)) for r in got.collect()) == slow(old, new)
    assert {r.change for r in got.collect()} == {"changed", "moved", "added", "gone", "removed"}
    assert difference(frame(spark, old), frame(spark, old)).count() == 0
    nothing = frame(spark, old).limit(0)
    assert {r.change for r in difference(nothing, frame(spark, old)).collect()} == {"added"} and {r.change for r in difference(frame(spark, old), nothing).collect()} == {"removed"}


def test_rows_of_one_key(spark):
    rows = spark.createDataFrame([("a", "x", 1, 1), ("a", "y", 1, 1), (None, "z", 1, 1), ("a", "x", 1, 2)], SCHEMA)
    assert snapshot(rows, "path", ["text", "n"]).count() == 1
    assert snapshot(rows, "path", ["text", "n"]).first() == snapshot(rows.repartition(2, "text"), "path", ["text", "n"]).first()


def test_manifest(spark, tmp_path):
    folder = str(tmp_path / "s")
    os.makedirs(folder)
    assert current(spark, folder) is None
    first = commit(frame(spark, {"a": ("x", 1), "b": ("y", 2)}), folder)
    line = open(f"{folder}/manifest.json").read()
    assert commit(frame(spark, {"b": ("y", 2), "a": ("x", 1)}), folder) == first and open(f"{folder}/manifest.json").read() == line
    second = commit(frame(spark, {"a": ("x", 1), "b": ("z", 2)}), folder)
    assert second != first and json.loads(open(f"{folder}/manifest.json").read()) == {"rows": 2, "snapshot": second}
    assert [r.change for r in difference(spark.read.parquet(f"{folder}/{first}"), current(spark, folder)).collect()] == ["changed"]
    assert sorted(f for f in os.listdir(folder) if not f.startswith(".")) == sorted([first, second, "manifest.json"])
