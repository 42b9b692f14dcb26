import random

import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import language

WORDS = {"en": "the of and to in that is was for with".split(), "de": "der die und zu das ist nicht für über".split(), "fr": "le la de et les des une que pour être".split()}


def rows(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS[w]) + rng.choice(["", "", "x", "a"]) for _ in range(rng.randrange(4, 60))), w, "s") for i in range(n) for w in [rng.choice(sorted(WORDS))]]


def test_held_out(spark):
    df = spark.createDataFrame(rows(400, 1), "doc_id long, text string, lang string, score string")
    model = language.learn(df.filter("doc_id % 4 <> 2"))
    got = language.predict(df.filter("doc_id % 4 = 2"), model).collect()
    right = np.array([r.lang == r.lang_pred for r in got])
    assert right.mean() > 0.95 and abs(np.mean([r.score for r in got]) - right.mean()) < 0.1 and all(0 <= r.score <= 1 for r in got)
    assert (model.weights == 0).mean() > 0.5


def test_odd_rows(spark):
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "12 !!", "de"), (None, "the of", "en"), (1003, "the of and", None), (1003, "the of and", None), (1004, "the " * 200_000, "en")]
    df = spark.createDataFrame([r[:3] for r in rows(100, 2)] + odd, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.predict(df, language.learn(df)).filter("doc_id >= 1000").collect()}
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred == got[1004].lang_pred == "en"
    none = language.learn(df.limit(0))
    assert language.predict(df, none).filter("lang_pred <> 'und'").count() == 0 and language.predict(df.limit(0), none).count() == 0


def test_portions(monkeypatch):
    text = "".join(chr(97 + i % 23) for i in range(5000))
    whole = language.gram_counts(text)
    monkeypatch.setattr(language, "_STEP", 97)
    assert (language.gram_counts(text) == whole).all() and whole.sum() == 3 * 5002 - 3


def test_fit_against_a_plain_loop(monkeypatch):
    """FTRL-proximal with both penalties, coordinate by coordinate, and the temperature by trying."""
    monkeypatch.setattr(language, "PASSES", 2)
    rng, n, k = random.Random(3), 50, 3
    data = [(np.array(sorted(rng.sample(range(30), 4))), np.array([rng.random() for _ in range(4)]), rng.randrange(k)) for _ in range(n)]
    model = language.fit(data, ["a", "b", "c"], np.ones(language.BUCKETS))
    train, held = [r for i, r in enumerate(data) if i % 5], data[::5]
    z, q = {}, {}

    def weight(key):
        s = z.get(key, 0.0)
        if abs(s) <= language.L1:
            return 0.0
        return -(s - (language.L1 if s > 0 else -language.L1)) / ((language.BETA + q.get(key, 0.0) ** 0.5) / language.ALPHA + language.L2)

    def probabilities(at, v, t=1.0):
        s = [sum(weight((b, c)) * x for b, x in zip([*at.tolist(), language.BUCKETS], [*v, 1.0])) / t for c in range(k)]
        e = np.exp(np.array(s) - max(s))
        return e / e.sum()

    order = np.random.default_rng(7)
    for _ in range(2):
        for i in order.permutation(len(train)):
            at, v, y = train[i]
            p = probabilities(at, v)
            new = []
            for b, x in zip([*at.tolist(), language.BUCKETS], [*v, 1.0]):
                for c in range(k):
                    g, w = (p[c] - (c == y)) * x, weight((b, c))
                    q0 = q.get((b, c), 0.0)
                    new.append(((b, c), g - ((q0 + g * g) ** 0.5 - q0**0.5) / language.ALPHA * w, g * g))
            for key, dz, dq in new:
                z[key], q[key] = z.get(key, 0.0) + dz, q.get(key, 0.0) + dq
    want = [[weight((b, c)) for c in range(k)] for b in [*range(30), language.BUCKETS]]
    assert np.allclose(model.weights[[*range(30), language.BUCKETS]], want, atol=1e-5)
    loss = {t: -np.mean([np.log(probabilities(at, v, t)[y]) for at, v, y in held]) for t in np.geomspace(0.05, 20, 200)}
    assert loss[min(loss, key=lambda t: abs(t - model.temperature))] <= min(loss.values()) + 1e-6


def test_grams_against_brute_force():
    """Bucket by bucket, every n-gram of the padded lower-case text is counted once."""
    grams = {}
    for text in ("The  Cat\nsat", "é日本", "aaaa", ""):
        padded = " " + " ".join(text.lower().split()) + " "
        every = [padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1)]
        assert language.gram_counts(text).sum() == len(every)
        for g in set(every):  # a gram alone fills the same bucket as in any text
            x = np.array([ord(c) for c in g], np.uint64)
            h = np.uint64(0)
            for m, c in enumerate(x):
                h = (h + c + np.uint64(m + 1)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            grams[g] = int(language.mix(np.array([h]))[0] & np.uint64(language.BUCKETS - 1))
        want = np.bincount([grams[g] for g in every], minlength=language.BUCKETS)
        assert (language.gram_counts(text) == want).all()


def test_a_repeated_id_teaches_once(spark, monkeypatch):
    sizes, fit = [], language.fit
    monkeypatch.setattr(language, "fit", lambda rows, *a: sizes.append(len(rows)) or fit(rows, *a))
    df = spark.createDataFrame([r[:3] for r in rows(60, 5)], "doc_id long, text string, lang string")
    many = spark.range(3000).selectExpr("5L doc_id", "concat('the of ', id % 50) text", "'en' lang")
    language.learn(df.union(many))
    assert sizes[0] <= 60


def test_a_repeated_id_does_not_starve_its_language(spark, monkeypatch):
    """One id makes nearly all rows of a language: its other ids teach all the same."""
    from pyspark.sql import functions as F

    from sparkloom.llm import language

    monkeypatch.setattr(language, "PER_LANGUAGE", 100)
    rows = spark.range(5000).select(F.when(F.col("id") < 60, F.col("id")).otherwise(F.lit(999)).alias("doc_id"), F.lit("bonjour le monde").alias("text"), F.lit("fr").alias("lang"))
    rows = rows.unionByName(spark.range(40).select((F.col("id") + 2000).alias("doc_id"), F.lit("hello the world").alias("text"), F.lit("en").alias("lang")))
    taught = []
    monkeypatch.setattr(language, "fit", lambda sample, languages, idf: taught.extend(languages[y] for *_, y in sample) or "model")
    assert language.learn(rows) == "model" and (taught.count("fr"), taught.count("en")) == (61, 40)
