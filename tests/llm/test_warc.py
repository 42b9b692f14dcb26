import base64
import hashlib
from collections import defaultdict

from sparkloom.llm import warc

V = "WARC/1.1\r\n"


def pages(spark):
    rows = [(1, "u1", "<p>é</p>"), (0, "u0", "<p>é</p>"), (2, None, None), (3, "u\r\n3", ""), (4, "u4", V + "x" + V * 3 + "é" * 9), (5, "u", "日本" * 300_000), (6, "u", "\r\n\r\n"), (6, "u", "\r\n\r\n"), (None, "n", "q"), (None, "n", "<p>é</p>")]
    return rows, spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload_digest string")


def test_round_trip(spark, tmp_path):
    rows, df = pages(spark)
    warc.write_archives(df, f"{tmp_path}/a")
    got = warc.read_archives(spark, f"{tmp_path}/a").collect()
    first = defaultdict(list)
    for p, _, h in rows:
        first[h or ""].append(p)
    want = []
    for p, _, h in rows:
        ids = [x for x in first[h or ""] if x is not None]
        least = min(ids) if ids else None
        again = least is not None and p != least
        b = (h or "").encode()
        want.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", least if again else None))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:1] + tuple(r)[2:6]) for r in got)
    assert {r.page_id: r.n_chunks for r in got}[5] > 1
    chunks = defaultdict(dict)
    for r in warc.read_chunks(spark, f"{tmp_path}/a").collect():
        chunks[r.page_id][r.chunk_no] = bytes(r.chunk)
    assert all(len(c) <= warc.CHUNK for x in chunks.values() for c in x.values())
    for p in (0, 4, 5):
        assert b"".join(x for _, x in sorted(chunks[p].items())).decode() == next(h for q, _, h in rows if q == p)


def test_threshold_and_empty(spark, tmp_path):
    rows, df = pages(spark)
    warc.write_archives(df, f"{tmp_path}/b", least=5)
    assert {r.page_id: r.record_type for r in warc.read_archives(spark, f"{tmp_path}/b").collect()}[3] == "response"
    warc.write_archives(df.limit(0), f"{tmp_path}/c")
    assert warc.read_archives(spark, f"{tmp_path}/c").count() == 0
