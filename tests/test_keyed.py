import random
from datetime import datetime, timedelta

import pytest

from sparkloom.streaming.events import available, event_stream
from sparkloom.streaming.keyed import assembled_turns, closed_sessions

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
TURNS = "conv_id long, turn long, role string, text string"
START = datetime(2024, 1, 1)


def plain(df):
    return sorted(map(str, df.collect()))


def files(spark, rows, schema, path, n):
    """n files, each a run of the rows."""
    step = -(-len(rows) // n)
    for i in range(0, len(rows), step):
        spark.createDataFrame(rows[i : i + step], schema).coalesce(1).write.mode("append").parquet(path)


def slow_sessions(rows, gap, late):
    rows = {r[0]: r for r in rows if None not in r[:3]}.values()
    now = max(r[1] for r in rows) - timedelta(seconds=late)
    now, out, by = now.replace(microsecond=now.microsecond // 1000 * 1000), [], {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        own = by.setdefault(r[2], [])
        if own and (r[1] - own[-1][-1][1]).total_seconds() <= gap:
            own[-1].append(r)
        else:
            own.append([r])
    for user, own in by.items():
        for s in own:
            if s[-1][1] + timedelta(seconds=gap) <= now:
                out.append((user, s[0][1], s[-1][1], len(s), sum(round(r[4] * 100) for r in s if r[4] in (0.1, 2.25)) / 100, s[0][3], s[-1][3]))
    return sorted(map(str, out))


def events(seed, n=400):
    rng, rows = random.Random(seed), []
    for i in range(n):
        at = START + timedelta(seconds=rng.randrange(40_000), microseconds=rng.choice([0, 1, 999_999]))
        rows.append((i, at, rng.choice([1, 1, 1, 2, 3, 4]), rng.choice(["view", "click", None]), rng.choice([None, 0.1, 2.25, float("nan"), 1e300]), "{}"))
    rows.sort(key=lambda r: r[1] + timedelta(seconds=rng.randrange(3000)))  # up to 50 minutes late
    rows += [(None, START, 1, "view", 1.0, ""), (9001, None, 1, "view", 1.0, ""), (9002, START, None, "view", 1.0, "")]
    for _ in range(60):  # repeated, near the first time or in the same file
        i = rng.randrange(n)
        rows.insert(i + rng.randrange(4), rows[i])
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_sessions(spark, tmp_path, seed):
    """Files in order of arrival, events late and repeated: the stream, the batch and a slow version agree."""
    rows = events(seed)
    files(spark, rows, EVENTS, str(tmp_path / "in"), 7)
    want = slow_sessions(rows, 300, 7200)
    batch = closed_sessions(spark.read.parquet(str(tmp_path / "in")), 300, 7200)
    got = sorted(str((r.user_id, r.first_ts, r.last_ts, r.n_events, r.total, r.first_type, r.last_type)) for r in batch.collect())
    assert got == want and len(want) > 20
    stream = available(closed_sessions(event_stream(spark, str(tmp_path / "in")), 300, 7200), "sessions")
    assert plain(stream) == plain(batch)


def conversations(seed):
    rng, rows = random.Random(seed), []
    for c in range(12):
        for t in range(rng.randrange(1, 12)):
            if not (c % 4 == 3 and t == 3):  # these lose a turn
                rows.append((c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(["", None, "é\U0001f600", "some text"])))
    rng.shuffle(rows)
    rows += rng.sample(rows, 15)  # repeated
    return rows + [(None, 0, "user", "x"), (50, None, "user", "x"), (51, -1, "user", "x"), (52, 1, "user", "late"), (52, 0, "user", "first")]


def slow_turns(rows):
    by, out = {}, []
    for c, t, role, text in rows:
        if c is not None and t is not None and t >= 0:
            by.setdefault(c, {})[t] = (role or "", len(text or ""))
    for c, own in by.items():
        t, chars, asked = 0, 0, None
        while t in own:
            role, n = own[t]
            chars += n
            out.append(str((c, t, role, n, chars, asked if role == "assistant" else None)))
            asked, t = t if role == "user" else asked, t + 1
    return sorted(out)


@pytest.mark.parametrize("span", [1024, 3])
def test_turns(spark, tmp_path, span):
    rows = conversations(span)
    files(spark, rows, TURNS, str(tmp_path / "in"), 6)
    want = slow_turns(rows)
    batch = assembled_turns(spark.read.parquet(str(tmp_path / "in")), span=span)
    shown = lambda df: sorted(str(tuple(r)) for r in df.collect())
    assert shown(batch) == want
    assert shown(available(assembled_turns(event_stream(spark, str(tmp_path / "in"))), "turns", after=False)) == want


def test_empty(spark, tmp_path):
    spark.createDataFrame([], EVENTS).write.parquet(str(tmp_path / "e"))
    spark.createDataFrame([], TURNS).write.parquet(str(tmp_path / "t"))
    for df, fold in ((str(tmp_path / "e"), closed_sessions), (str(tmp_path / "t"), assembled_turns)):
        batch = fold(spark.read.parquet(df))
        stream = available(fold(event_stream(spark, df)), "none", after=fold is closed_sessions)
        assert batch.count() == stream.count() == 0 and batch.columns == stream.columns


def test_sessions_keep_no_python_state(spark, tmp_path):
    """A call into Python for each user and micro-batch took most of the time of many users."""
    files(spark, events(3), EVENTS, str(tmp_path / "in"), 1)
    plan = closed_sessions(event_stream(spark, str(tmp_path / "in")))._jdf.queryExecution().logical().toString()
    assert "TransformWithState" not in plan and "session_window" in plan.lower()
