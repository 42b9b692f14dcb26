import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkloom.streaming.events import available, event_stream
from sparkloom.streaming.pairs import answered, first_answers, left_open, paired, settled

SCHEMA = "id long, key long, ts timestamp, kind string"
START = datetime(2024, 3, 1)


def rows_of(seed):
    rng, rows = random.Random(seed), []
    for i in range(300):
        rows.append((i, rng.choice([1, 1, 1, 2, 3, None]), START + timedelta(seconds=rng.randrange(30_000)), rng.choice(["a", "b"])))
    rows += [(400, 7, START, "a"), (401, 7, START + timedelta(seconds=600), "b"), (402, 8, START, "a"), (403, 8, START + timedelta(seconds=600, microseconds=1), "b"), (404, 9, START, "b"), (405, 9, START, "a"), (404, 9, START, "b"), (398, 9, START, "b")]
    rows.sort(key=lambda r: r[2] + timedelta(seconds=rng.randrange(1500)))
    for _ in range(30):
        i = rng.randrange(300)
        rows.insert(i + 2, rows[i])
    return rows


def slow(rows, limit):
    out = set()
    for i, key, ts, kind in rows:
        if kind == "a":
            ends = [(t, j) for j, k, t, x in rows if x == "b" and k == key and key is not None and 0 <= (t - ts).total_seconds() <= limit]
            out.add((i, ts, *(min(ends)[::-1] if ends else (None, None))))
    return out


def sides(df):
    return df.filter("kind = 'a'").select(F.col("id").alias("start_id"), "key", "ts"), df.filter("kind = 'b'").select(F.col("id").alias("end_id"), "key", "ts")


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs(spark, tmp_path, seed):
    """Late and repeated rows in files of arrival: a slow version, the batch and the stream agree, unmatched starts included."""
    rows, limit, late = rows_of(seed), 600, 3600
    for i in range(0, len(rows), 80):
        spark.createDataFrame(rows[i : i + 80], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    starts, ends = sides(spark.read.parquet(str(tmp_path / "in")))
    want = slow(rows, limit)
    got = paired(starts, ends, limit)
    assert {tuple(r) for r in got.collect()} == want and got.count() == starts.count()
    assert {r.start_id for r in left_open(got, starts).collect()} == {r[0] for r in want if r[2] is None}
    stream = available(answered(*sides(event_stream(spark, str(tmp_path / "in"))), limit, late), "pairs")
    until = settled(starts, ends, limit, late)
    streamed = {tuple(r) for r in first_answers(stream).collect() if r.start_ts < until}
    assert streamed == {r for r in want if r[1] < until} and any(r[2] is None for r in streamed)


def test_empty(spark):
    starts, ends = sides(spark.createDataFrame(rows_of(1), SCHEMA))
    assert paired(starts.limit(0), ends, 5).count() == 0 and settled(starts.limit(0), ends, 5, 5) is None
    assert paired(starts, ends.limit(0), 5).filter("end_id is not null").count() == 0
