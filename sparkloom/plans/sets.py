"""Registered queries of samples, sets, differences, elapsed times and numbered lines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.relational import elapsed
from sparkloom.operators.samples import counted_sample, equal_sets, largest_share
from sparkloom.operators.snapshots import difference, snapshot
from sparkloom.plans.catalog import query
from sparkloom.sources.lines import numbered_lines
from sparkloom.sources.tables import run_folder, table


@query("""SELECT event_type, count(*) AS n_rows, array_to_string((list(event_id ORDER BY value DESC, event_id))[1:5], ',') AS dearest FROM events GROUP BY 1""")
def dearest_events_by_type(spark, sf_dir) -> DataFrame:
    found = counted_sample(table(spark, sf_dir, "events", "event_type", "event_id", "value"), ["event_type"], [F.desc("value")], ["event_id"], 5)
    return found.select("event_type", "n_rows", F.array_join(F.transform("sample", lambda r: r["event_id"].cast("string")), ",").alias("dearest"))


@query("""SELECT len(s) AS n_members, count(*) AS n_keys, min(c) AS first_customer FROM (SELECT o_custkey AS c, list_sort(list(DISTINCT o_orderpriority)) AS s FROM orders GROUP BY 1) GROUP BY s""")
def customers_with_equal_priorities(spark, sf_dir) -> DataFrame:
    found = equal_sets(table(spark, sf_dir, "orders", "o_custkey", "o_orderpriority"), ["o_custkey"], ["o_orderpriority"], "first")
    return found.select("n_members", "n_keys", F.col("first.o_custkey").alias("first_customer"))


@query("SELECT source, count(*) AS n_rows, count(*) / (SELECT count(*) FROM documents) AS share FROM documents GROUP BY 1 HAVING count(*) > 0.01 * (SELECT count(*) FROM documents)")
def largest_sources(spark, sf_dir) -> DataFrame:
    return largest_share(table(spark, sf_dir, "documents", "source"), ["source"], 0.01)


@query("""WITH o AS (SELECT doc_id AS key, coalesce(text, '') || '|' || coalesce(lang, '') AS c FROM documents
), n AS (SELECT CASE WHEN doc_id % 7 = 2 THEN doc_id + 1000000000 ELSE doc_id END AS key, CASE WHEN doc_id % 7 = 1 THEN coalesce(text, '') || ' revised' ELSE coalesce(text, '') END || '|' || coalesce(lang, '') AS c FROM documents WHERE doc_id % 7 <> 0
), b AS (SELECT key, o.c AS was, n.c AS now FROM o FULL JOIN n USING (key) WHERE o.c IS NULL OR n.c IS NULL OR o.c <> n.c
), g AS (SELECT was AS c, min(key) AS other FROM b WHERE now IS NULL GROUP BY 1), a AS (SELECT now AS c, min(key) AS other FROM b WHERE was IS NULL GROUP BY 1)
SELECT key, CASE WHEN was IS NOT NULL AND now IS NOT NULL THEN 'changed' WHEN was IS NULL AND g.c IS NOT NULL THEN 'moved' WHEN was IS NULL THEN 'added' WHEN a.c IS NOT NULL THEN 'gone' ELSE 'removed' END AS change,
  CASE WHEN was IS NULL THEN g.other WHEN now IS NULL THEN a.other END AS other FROM b LEFT JOIN g ON was IS NULL AND g.c = now LEFT JOIN a ON now IS NULL AND a.c = was""")
def documents_changed(spark, sf_dir) -> DataFrame:
    """Against a later state of all documents, in which of every seven one is gone, one is revised and one has another id."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang").fillna("", ["text", "lang"])
    later = docs.filter("doc_id % 7 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 1, F.concat("text", F.lit(" revised"))).otherwise(F.col("text")))
    later = later.withColumn("doc_id", F.when(F.col("doc_id") % 7 == 2, F.col("doc_id") + 1_000_000_000).otherwise(F.col("doc_id")))
    return difference(*(snapshot(x, "doc_id", ["text", "lang"]) for x in (docs, later)))


@query("SELECT event_id, user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 AS seconds FROM events")
def time_since_last_event(spark, sf_dir) -> DataFrame:
    return elapsed(table(spark, sf_dir, "events", "event_id", "user_id", "ts"), "user_id", "ts", "event_id", "seconds").select("event_id", "user_id", "seconds")


@query("SELECT o_custkey AS custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT ALL SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def finished_and_urgent_orders(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders", F.col("o_custkey").alias("custkey"), "o_orderstatus", "o_orderpriority")
    return orders.filter("o_orderstatus = 'F'").select("custkey").intersectAll(orders.filter("o_orderpriority = '1-URGENT'").select("custkey"))


@query(r"""SELECT coalesce(role, 'none') AS role, sum(1 + len(regexp_extract_all(coalesce(text, ''), '\r\n|\r|\n')))::BIGINT AS n_lines, sum(1 + len(regexp_extract_all(coalesce(text, ''), '\r\n|\r|\n')))::BIGINT AS numbers_end FROM conversations GROUP BY 1""")
def lines_by_role(spark, sf_dir) -> DataFrame:
    """The turns are written as text files, a folder for each role, and read back with line numbers: the last number of every file adds up to the lines."""
    path = f"{run_folder(spark)}/sparkloom-texts-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "conversations", "role", "text").select(F.coalesce("role", F.lit("none")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows.write.partitionBy("role").text(path)
    lines = numbered_lines(spark, path)
    files = lines.groupBy("file").agg(F.count("*").alias("n"), F.max("line").alias("end"))
    return files.groupBy(F.regexp_extract("file", r"/role=([^/]*)/", 1).alias("role")).agg(F.sum("n").alias("n_lines"), F.sum("end").alias("numbers_end"))
