"""Registered queries of folds with state: each over its table, and as a stream over the same files, with one SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.plans.catalog import query
from sparkloom.sources.tables import table
from sparkloom.streaming.events import available, event_stream
from sparkloom.streaming.keyed import assembled_turns, closed_sessions
from sparkloom.streaming.pairs import answered, first_answers, paired, settled

#: Files in a micro-batch.
FILES = 256
LIMIT, LATE = 86_400, 7_200

_SESSIONS = """
WITH e AS (SELECT DISTINCT ON (event_id) * FROM events WHERE event_id IS NOT NULL AND ts IS NOT NULL AND user_id IS NOT NULL
), g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 1800000000 THEN 0 ELSE 1 END AS fresh FROM e
), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_events, sum(coalesce(round(value * 100), 0)::BIGINT) / 100 AS total,
  arg_min(event_type, struct_pack(t := ts, i := event_id)) AS first_type, arg_max(event_type, struct_pack(t := ts, i := event_id)) AS last_type
FROM s GROUP BY user_id, session HAVING epoch_us(max(ts)) + 1800000000 <= (SELECT (epoch_ms(max(ts)) - 7200000) * 1000 FROM e)
"""

_TURNS = """
WITH t AS (SELECT conv_id, turn, min(struct_pack(r := coalesce(role, ''), n := length(coalesce(text, '')))) AS x FROM conversations WHERE conv_id IS NOT NULL AND turn >= 0 GROUP BY ALL
), u AS (SELECT conv_id, turn, x.r AS role, x.n AS n_chars, row_number() OVER w AS place, (sum(x.n) OVER (w ROWS UNBOUNDED PRECEDING))::BIGINT AS chars_so_far,
  max(CASE WHEN x.r = 'user' THEN turn END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, role, n_chars, chars_so_far, CASE WHEN role = 'assistant' THEN asked END AS answers FROM u WHERE place = turn + 1
"""

_PURCHASES = """
WITH f AS (SELECT s.event_id AS start_id, s.ts AS start_ts, min(struct_pack(t := e.ts, i := e.event_id)) AS x
  FROM events s LEFT JOIN events e ON e.event_type = 'purchase' AND e.user_id = s.user_id AND e.ts BETWEEN s.ts AND s.ts + INTERVAL 1 DAY WHERE s.event_type = 'view' GROUP BY ALL)
SELECT start_id, start_ts, x.i AS end_id, x.t AS end_ts FROM f
"""

_SETTLED = _PURCHASES + "WHERE start_ts < (SELECT least(max(ts) FILTER (event_type = 'view'), max(ts) FILTER (event_type = 'purchase')) - INTERVAL 93601 SECONDS FROM events)"


def _plain_times(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes))


@query(_SESSIONS)
def sessions_over(spark, sf_dir) -> DataFrame:
    return _plain_times(closed_sessions(table(spark, sf_dir, "events")))


@query(_SESSIONS)
def sessions_over_streamed(spark, sf_dir) -> DataFrame:
    return _plain_times(available(closed_sessions(event_stream(spark, f"{sf_dir}/events.parquet", FILES)), "sessions"))


@query(_TURNS)
def turns_in_order(spark, sf_dir) -> DataFrame:
    return assembled_turns(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


@query(_TURNS)
def turns_in_order_streamed(spark, sf_dir) -> DataFrame:
    return available(assembled_turns(event_stream(spark, f"{sf_dir}/conversations.parquet", FILES)), "turns", after=False)


def _views_and_purchases(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = events.select("event_id", F.col("user_id").alias("key"), "ts", "event_type")
    return rows.filter("event_type = 'view'").select(F.col("event_id").alias("start_id"), "key", "ts"), rows.filter("event_type = 'purchase'").select(F.col("event_id").alias("end_id"), "key", "ts")


@query(_PURCHASES)
def purchase_after_view(spark, sf_dir) -> DataFrame:
    return _plain_times(paired(*_views_and_purchases(table(spark, sf_dir, "events")), LIMIT))


@query(_SETTLED)
def purchase_after_view_streamed(spark, sf_dir) -> DataFrame:
    """Only views whose answer can't change any more, whatever comes later."""
    until = settled(*_views_and_purchases(table(spark, sf_dir, "events")), LIMIT, LATE)
    stream = answered(*_views_and_purchases(event_stream(spark, f"{sf_dir}/events.parquet", FILES)), LIMIT, LATE)
    found = _plain_times(first_answers(available(stream, "purchases")))
    return found.filter(F.col("start_ts") < F.lit(until).cast("timestamp_ntz")) if until else found.limit(0)
