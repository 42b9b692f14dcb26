import random
import re
from collections import Counter

from sparkloom.llm.substring_dedup import remove_repeats


def brute(rows, size):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + size]) for w in docs for i in range(len(w) - size + 1))
    out = []
    for (d, _), w in zip(rows, docs):
        cut = {j for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}
        out.append((d, " ".join(x for j, x in enumerate(w) if j not in cut), len(w), len(cut)))
    return sorted(out, key=str)


def check(spark, rows, size=5):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, part string")
    got = [(r.doc_id, r.kept_text, r.n_words, r.n_removed) for r in remove_repeats(df, size).collect()]
    assert sorted(got, key=str) == brute(rows, size)


def test_against_brute_force(spark):
    rng = random.Random(1)
    words = "alpha beta gamma é ß 東京 a b c".split()
    base = [rng.choice(words) + str(rng.randrange(9)) for _ in range(40)]
    rows = [(i, " ".join([f"u{i}"] * rng.randrange(3) + base[(s := rng.randrange(30)) : s + rng.randrange(20)] + [f"w{i}_{j}" for j in range(rng.randrange(9))])) for i in range(80)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (None, "x y"), (103, "a " * 50), (104, " a b c d e f g"), (7, rows[7][1]), (105, "q\x1cz " * 3)]
    check(spark, rows)


def test_empty_and_short(spark):
    check(spark, [])
    check(spark, [(1, "one two"), (2, "one two")])


def test_a_row_repeated_beyond_a_part(spark, monkeypatch):
    """Equal rows that would fill a part are one row with copies; the result has them all."""
    from sparkloom.llm import substring_dedup as sd

    monkeypatch.setattr(sd, "PART_BYTES", (300, 300))
    asked, collapse = [], sd._collapsed
    monkeypatch.setattr(sd, "_collapsed", lambda *a: asked.append(1) or collapse(*a))
    check(spark, [(7, "a b c d e f g h i j")] * 40 + [(None, "k l m n o p q")] * 60 + [(8, "x " * 400 + "y"), (9, "b c d e f"), (10, "one two"), (None, None)] + [(11, "z z")] * 150)
    assert asked


def test_a_very_long_text(spark):
    text = " ".join(f"w{i * i % 99991}" for i in range(200_000))
    check(spark, [(1, text), (2, text[1000:5000]), (3, "x" * 2_000_000)], size=35)
