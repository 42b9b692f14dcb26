import hashlib
import random
import re

from sparkloom.llm import secrets


def brute(text):
    text, out = text or "", []
    for rank, (kind, pattern, group, least) in enumerate(secrets.RULES):
        for m in re.finditer(pattern, text, re.ASCII):
            if len(m.group(group)) >= least:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


TEXTS = [
    None, "", "x", "é\U0001f600 token = 'abcdefgh' password:short", "TOKEN=token: abcdefghij", "token=secret=abcdefgh", "api_key\"  :  \"A+/_.=-1", "AKIA" + "Z" * 12, "AKIA" + "Z" * 11, "xAKIAAKIA" + "0" * 12,
    "a" * 31, "a" * 32 + "g" + "0f" * 20, "secret=" + "ab" * 20, "ghp_" + "a" * 36, "-----BEGIN RSA PRIVATE KEY-----", "\n".join(["passwd='12345678'"] * 300), "ſecret=abcdefghijk", "token\n=abcdefghij", "token=abcdefgh", "token=abcdefgh", "apikey=password=12345678 api_key=9",
]


def test_like_python(spark):
    rng = random.Random(4)
    parts = ["token", "=", ":", " ", "'", '"', "secret", "abcdefgh", "AKIA", "ABCDEF0123456789", "deadbeef" * 4, "\n", "é", "Password"]
    texts = TEXTS + ["".join(rng.choice(parts) for _ in range(30)) for _ in range(150)]
    df = spark.createDataFrame([(i, t, "b") for i, t in enumerate(texts)], "path long, text string, blob string")
    found, new = secrets.scan(df)
    got = {r.path: (r.blob, [tuple(x) for x in r.findings]) for r in found.collect()}
    for i, t in enumerate(texts):
        assert got[i] == (hashlib.sha256((t or "").encode()).hexdigest(), brute(t)), t
    assert new.count() == len({t or "" for t in texts})
    clean = {r.path: r.text for r in secrets.redact(df).collect()}
    for i, t in enumerate(texts):
        spans, out, at = [x[::2][:2] for x in brute(t)], "", 0
        merged = []
        for s, e in spans:
            if merged and s < merged[-1][1]:
                merged[-1][1] = max(e, merged[-1][1])
            else:
                merged.append([s, e])
        for s, e in merged:
            out, at = out + t[at:s] + ("[SECRET]" if s > at or s == 0 else ""), e
        assert clean[i] == (None if t is None else out + t[at:]), t


def test_ledger(spark, tmp_path):
    a = spark.createDataFrame([("p", "token=abcdefgh"), ("q", "none")], "path string, text string")
    _, new = secrets.scan(a)
    new.write.parquet(str(tmp_path / "l"))
    ledger = spark.read.parquet(str(tmp_path / "l"))
    b = spark.createDataFrame([("r", "token=abcdefgh"), ("s", "AKIA" + "0" * 16), (None, None)], "path string, text string")
    found, more = secrets.scan(b, ledger=ledger)
    assert more.count() == 2 and {r.path: len(r.findings) for r in found.collect()} == {"r": 1, "s": 1, None: 0}
    assert secrets.scan(b, ledger=ledger, rules=secrets.RULES[:1])[1].count() == 3
    assert secrets.scan(a.limit(0))[0].count() == 0


def test_kept_ledger(spark, tmp_path):
    """With a kept ledger, scan_kept and redact scan a blob once for a rule version, and find the same when nothing is left to scan."""
    rows = [(1, "token=abcdefgh"), (2, "token=abcdefgh"), (None, "AKIA" + "0" * 16), (4, None), (4, "")]
    docs, ledger = spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "ledger")

    def scan():
        return sorted(map(str, secrets.scan_kept(docs, path="doc_id", ledger=ledger).collect()))

    first = scan()
    assert secrets.kept_ledger(spark, ledger).count() == 3 and len(first) == 5 and sum("assign" in r for r in first) == 2
    assert scan() == first
    clean = sorted((str(r.doc_id), str(r.text)) for r in secrets.redact(docs, ledger=ledger).collect())
    assert clean == [("1", "[SECRET]"), ("2", "[SECRET]"), ("4", ""), ("4", "None"), ("None", "[SECRET]")]
    assert secrets.kept_ledger(spark, ledger).count() == 3  # nothing was scanned again
    secrets.redact(docs.unionByName(spark.createDataFrame([(9, "new")], "doc_id long, text string")), ledger=ledger).count()
    assert secrets.kept_ledger(spark, ledger).count() == 4
    secrets.kept_ledger(spark, ledger).limit(2).write.parquet(str(tmp_path / "twice"))  # a scan at the same time
    spark.read.parquet(str(tmp_path / "twice")).write.mode("append").parquet(ledger)
    assert scan() == first
    assert secrets.scan(docs, path="doc_id", ledger=secrets.kept_ledger(spark, ledger))[0].count() == 5
    secrets.scan_kept(docs, path="doc_id", ledger=ledger, rules=secrets.RULES[:2]).count()
    assert secrets.kept_ledger(spark, ledger).count() == 9  # another rule version: all three blobs anew


def test_query_scans_in_each_run(spark, tmp_path):
    """The query's ledger is its run's own: what an earlier run found does not stand in for a scan."""
    spark.createDataFrame([(1, "token=abcdefgh"), (1, "token=abcdefgh"), (None, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    first = sorted(map(str, secrets.op5_secrets(spark, str(tmp_path)).collect()))
    assert len(first) == 3 and sum("n_assign=1" in r for r in first) == 2
    assert sorted(map(str, secrets.op5_secrets(spark, str(tmp_path)).collect())) == first


def test_increments_scan_only_what_is_left(spark, tmp_path, monkeypatch):
    """Blobs that parts share are scanned in the first of them alone; the findings are those of one scan."""
    rows = [(i, ["token=abcdefgh", "AKIA" + "0" * 16, f"secret: value{i:04d}", None][i % 4]) for i in range(60)] + [(None, "token=abcdefgh"), (3, "token=abcdefgh")]
    docs, ledger = spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "ledger")
    scanned, plain = [], secrets.scan_blobs
    monkeypatch.setattr(secrets, "scan_blobs", lambda blobs, rules: scanned.append(blobs.count()) or plain(blobs, rules))
    got = sorted(map(str, secrets.scan_increments(docs, path="doc_id", parts=3, ledger=ledger).collect()))
    monkeypatch.undo()
    assert got == sorted(map(str, secrets.scan(docs, path="doc_id")[0].collect()))
    blobs = len({t or "" for _, t in rows})
    assert sum(scanned) == blobs == secrets.kept_ledger(spark, ledger).count() and all(scanned)


def test_versions_of_a_path(spark):
    df = spark.createDataFrame([("p", 1, "token=abcdefgh"), ("p", 2, "none"), ("q", None, "token=abcdefgh")], "path string, v int, text string")
    found, new = secrets.scan(df, version="v")
    assert {(r.path, r.version): len(r.findings) for r in found.collect()} == {("p", 1): 1, ("p", 2): 0, ("q", None): 1} and new.count() == 2


def test_clashing_columns_and_a_long_text(spark):
    long = ("x " * 200_000) + "token=abcdefgh " + ("y " * 200_000)
    df = spark.createDataFrame([("token=abcdefgh", 5, "f", "b", "d", "r", 14), (long, 6, "f", "b", "d", "r", len(long)), (None, 7, "f", "b", "d", "r", None)], "text string, doc_id long, findings string, blob string, `a.b` string, row string, n_chars long")
    out = {r.doc_id: r for r in secrets.redact(df).collect()}
    assert secrets.redact(df).columns == df.columns
    assert out[5].text == "[SECRET]" and out[5].n_chars == 8 and tuple(out[5][2:6]) == ("f", "b", "d", "r")
    assert out[6].text == long.replace("token=abcdefgh", "[SECRET]") and out[6].n_chars == len(out[6].text) and out[7].text is None and out[7].n_chars is None
