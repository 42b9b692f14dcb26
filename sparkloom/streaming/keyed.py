"""Folds by key over streams, with state of their own, and the batch queries that give the same rows.

State lies in RocksDB under the query's checkpoint, so `state_store` must have been set in the session.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from sparkloom.operators.relational import gaps
from sparkloom.sources.tables import materialize

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_store(spark: SparkSession) -> None:
    """Sets the session's state store to the one that these folds need, unless it has been set."""
    if (spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) or "HDFS").rpartition(".")[2].startswith("HDFS"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)


def _named(found: DataFrame) -> DataFrame:
    """Times as timestamps, cents as a value."""
    times = (F.timestamp_micros(c).alias(n) for c, n in (("first", "first_ts"), ("last", "last_ts")))
    return found.select("user_id", *times, "n_events", (F.col("cents") / 100).alias("total"), "first_type", "last_type")


def closed_sessions(events: DataFrame, gap: int = 1800, late: int = 7200) -> DataFrame:
    """events(event_id, ts, user_id, event_type, value) to the sessions that are over: user_id, first_ts, last_ts, n_events, total, first_type, last_type.

    A session ends where more than `gap` seconds pass without an event of the user; it is over once the watermark, `late`
    seconds behind the latest event of all, has passed the last event and the gap. Repeated event ids count once,
    equal times go by id, values are summed as whole cents. Of a stream, events behind the watermark are dropped; where
    none are, the stream, by Spark's session windows without Python in its state, gives the rows that the batch gives, whatever the order of arrival. Events without id, time or
    user are left out, those without value, or with one that is no number of cents, add nothing.
    """
    rows = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.coalesce(F.round(F.col("value") * 100).try_cast("long"), F.lit(0)).alias("cents"))
    rows = rows.filter("event_id is not null and ts is not null and user_id is not null")
    if events.isStreaming:
        state_store(events.sparkSession)
        timed = rows.withWatermark("ts", f"{late} seconds").dropDuplicatesWithinWatermark(["event_id"]).withColumn("at", F.unix_micros("ts"))
        order = F.struct("at", "event_id")
        found = timed.groupBy(F.session_window("ts", f"{gap} seconds").alias("w"), "user_id").agg(
            F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n_events"), F.sum("cents").alias("cents"), F.min_by("event_type", order).alias("first_type"), F.max_by("event_type", order).alias("last_type"))
        return _named(found)
    now = F.unix_millis(F.max("ts")) - late * 1000
    once = materialize(rows.dropDuplicates(["event_id"]), "once")
    seen = once.agg(now.alias("now")).first().now
    numbered = gaps(once, "user_id", "ts", gap).withColumn("at", F.unix_micros("ts"))
    order = F.struct("at", "event_id")
    found = numbered.groupBy("user_id", "session").agg(
        F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n_events"), F.sum("cents").alias("cents"), F.min_by("event_type", order).alias("first_type"), F.max_by("event_type", order).alias("last_type"))
    return _named(found.filter(F.col("last") + gap * 1_000_000 <= F.lit(seen) * 1000))


TURNS = "conv_id long, turn long, role string, n_chars long, chars_so_far long, answers long"


class TurnAssembly(StatefulProcessor):
    """Of a conversation: turns in whatever order they come, given out in theirs, each as soon as all before it have been.

    State that has not been touched for `keep` milliseconds goes: a conversation that lost a turn for good is
    forgotten, with the turns that waited for it.
    """

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "next long, chars long, asked long", self.keep)
        self.early = handle.getMapState("early", "turn long", "role string, n_chars long", self.keep)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        next_, chars, asked = self.at.get() if self.at.exists() else (0, 0, None)
        came = {}
        for r in rows:
            if r.turn >= next_ and (r.turn not in came or (r.role, r.n_chars) < came[r.turn]):
                came[r.turn] = (r.role, r.n_chars)
        while True:
            if next_ in came:
                role, n = came.pop(next_)
            elif self.early.containsKey((next_,)):
                role, n = self.early.getValue((next_,))
                self.early.removeKey((next_,))
            else:
                break
            chars += n
            yield Row(conv_id=key[0], turn=next_, role=role, n_chars=n, chars_so_far=chars, answers=asked if role == "assistant" else None)
            asked = next_ if role == "user" else asked
            next_ += 1
        for turn, row in came.items():
            if not self.early.containsKey((turn,)):
                self.early.updateValue((turn,), row)
        self.at.update((next_, chars, asked))

    def close(self) -> None:
        pass


def assembled_turns(turns: DataFrame, keep_hours: int = 24 * 7, span: int = 1024) -> DataFrame:
    """turns(conv_id, turn, role, text) to the turns of each conversation from 0 to the first that is missing: conv_id, turn, role, n_chars, chars_so_far, answers.

    chars_so_far sums up to the turn; answers is the last turn of the user before an assistant's, null for others. A
    stream gives each turn once, when all before it have come; state of conversations without news for `keep_hours`
    is dropped. Of a repeated turn the first to come counts in a stream, within a micro-batch and in a batch the smallest
    (role, number of characters): equal repeats make no difference. Rows without id or turn, and turns below 0, are
    left out; a null role is the empty one, a null text is empty.

    The batch query sums over ranges of `span` turns and carries over a row for each range, so that no task gets a whole
    conversation.
    """
    plain = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars")).filter("conv_id is not null and turn >= 0")
    if turns.isStreaming:
        state_store(turns.sparkSession)
        return plain.groupBy("conv_id").transformWithState(TurnAssembly(keep_hours * 3_600_000), TURNS, "append", "ProcessingTime")
    rows = plain.groupBy("conv_id", "turn").agg(F.min(F.struct("role", "n_chars")).alias("r")).select("conv_id", "turn", "r.*", F.floor(F.col("turn") / span).alias("__range"))
    rows = materialize(rows, "turns")
    asked = F.when(F.col("role") == "user", F.col("turn"))
    ranges = rows.groupBy("conv_id", "__range").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.max(asked).alias("asked"))
    before = Window.partitionBy("conv_id").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("conv_id", "__range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{c}") for c in ("n", "chars")), F.max("asked").over(before).alias("__asked"))
    ranges = materialize(ranges, "ranges")
    own = Window.partitionBy("conv_id", "__range").orderBy("turn")
    within = own.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__at", F.row_number().over(own)).withColumn("__sum", F.sum("n_chars").over(within)).withColumn("__last", F.max(asked).over(own.rowsBetween(Window.unboundedPreceding, -1)))
    found = rows.join(ranges, ["conv_id", "__range"]).filter(F.col("__n") + F.col("__at") == F.col("turn") + 1)
    answers = F.when(F.col("role") == "assistant", F.coalesce("__last", "__asked"))
    return found.select("conv_id", "turn", "role", "n_chars", (F.col("__chars") + F.col("__sum")).alias("chars_so_far"), answers.alias("answers"))
