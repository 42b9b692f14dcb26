"""The registered queries outside the llm subpackage, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.json_text import number_field, words
from sparkloom.functions.objects import Field, json_spans, typed
from sparkloom.operators.communities import communities
from sparkloom.operators.graph import hubs
from sparkloom.operators.links import targets
from sparkloom.operators.relational import as_of, gaps, latest, missing, ordered_text, share_of_group, top_per_group
from sparkloom.sources.tables import table
from sparkloom.streaming.events import counts_by_window

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter("l_shipdate <= timestamp_ntz'1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"), F.count("*").alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def local_supplier_volume(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_extendedprice", "l_discount")
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").join(table(spark, sf_dir, "customer", "c_custkey", "c_nationkey"), F.expr("o_custkey = c_custkey"))
    sellers = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").join(table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey"), F.expr("s_nationkey = n_nationkey")).join(table(spark, sf_dir, "region", "r_regionkey"), F.expr("n_regionkey = r_regionkey"))
    found = lines.join(sellers, F.expr("l_suppkey = s_suppkey")).join(orders, F.expr("l_orderkey = o_orderkey and c_nationkey = s_nationkey"))
    return found.groupBy("n_name").agg(F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def customers_without_orders(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders", F.col("o_custkey").alias("c_custkey"))
    return missing(table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment"), orders, "c_custkey")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")
def customers_without_urgent_orders(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders", F.col("o_custkey").alias("c_custkey"), "o_orderpriority", "o_orderstatus").filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'")
    return missing(table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment"), orders, "c_custkey")


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1")
def orders_with_returns(spark, sf_dir) -> DataFrame:
    returned = table(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag").filter("l_returnflag = 'R'")
    return table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority").join(returned, F.expr("l_orderkey = o_orderkey"), "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, count(o_orderkey) AS n_orders, coalesce(round(sum(o_totalprice), 2), 0) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def orders_by_customer(spark, sf_dir) -> DataFrame:
    sums = table(spark, sf_dir, "orders", "o_custkey", "o_totalprice").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    found = table(spark, sf_dir, "customer", "c_custkey").join(sums, F.expr("c_custkey = o_custkey"), "left")
    return found.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce(F.round("t", 2), F.lit(0.0)).alias("total"))


@query("SELECT user_id, event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def last_event_of_user(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events", "user_id", "event_id", "event_type", "ts")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return latest(rows, ["user_id"], [-micros, -F.col("event_id")])


@query("SELECT event_type, event_id, value, rank FROM (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id)::INT AS rank FROM events) WHERE rank <= 10")
def top_events_by_type(spark, sf_dir) -> DataFrame:
    return top_per_group(table(spark, sf_dir, "events", "event_type", "event_id", "value"), ["event_type"], [F.desc("value"), F.col("event_id")], 10)


@query("""SELECT user_id, session, count(*) AS n_events FROM (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS session
FROM (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) <= 1800000000 THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY ALL""")
def user_sessions(spark, sf_dir) -> DataFrame:
    return gaps(table(spark, sf_dir, "events", "user_id", "ts"), "user_id", "ts", 1800).groupBy("user_id", "session").agg(F.count("*").alias("n_events"))


@query("""SELECT p.event_id, (SELECT max_by(c.event_id, struct_pack(t := c.ts, e := c.event_id)) FROM events c WHERE c.event_type = 'click' AND c.user_id = p.user_id AND c.ts <= p.ts) AS click_id
FROM events p WHERE p.event_type = 'purchase'""")
def click_before_purchase(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events", "user_id", "ts", "event_id", "event_type").filter("event_type in ('click', 'purchase')")
    clicks = rows.filter("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("event_id").alias("click_id"))
    return as_of(rows.filter("event_type = 'purchase'").select("user_id", "ts", "event_id"), clicks, "user_id", "ts", ["click_id"]).select("event_id", "click_id")


@query("SELECT event_type, count(*) AS n, count(try_cast(json_extract_string(props, '$.k') AS DOUBLE)) AS n_k, sum(try_cast(json_extract_string(props, '$.k') AS DOUBLE)) AS sum_k FROM events GROUP BY 1")
def props_by_type(spark, sf_dir) -> DataFrame:
    k = number_field("props", "k")
    return table(spark, sf_dir, "events", "event_type", "props").groupBy("event_type").agg(F.count("*").alias("n"), F.count(k).alias("n_k"), F.sum(k).alias("sum_k"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def events_by_hour(spark, sf_dir) -> DataFrame:
    found = counts_by_window(table(spark, sf_dir, "events", "ts", "event_type", "value"))
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH e AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem), d AS (SELECT node, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY 1)
SELECT node, fan_in, fan_out, fan_in + fan_out AS degree FROM d ORDER BY degree DESC, node LIMIT 20""")
def supply_hubs(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey")
    return hubs(lines.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")), 20)


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey), 6) AS share FROM lineitem")
def share_of_order(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return share_of_group(lines, ["l_orderkey"], "l_extendedprice", "share").select("l_orderkey", "l_linenumber", "l_partkey", F.round("share", 6).alias("share"))


@query("SELECT c_nationkey AS nationkey FROM customer WHERE c_acctbal < 0 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def nations_in_debt_with_rich_suppliers(spark, sf_dir) -> DataFrame:
    debtors = table(spark, sf_dir, "customer", "c_nationkey", "c_acctbal").filter("c_acctbal < 0").select(F.col("c_nationkey").alias("nationkey"))
    return debtors.intersect(table(spark, sf_dir, "supplier", "s_nationkey", "s_acctbal").filter("s_acctbal > 0").select("s_nationkey"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, grouping(l_returnflag)::INT * 2 + grouping(l_linestatus)::INT AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def quantity_cube(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", "l_quantity").cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.grouping_id().cast("int").alias("level"))


@query(r"""SELECT lang, count(*) AS n_docs, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS n_words, max(n_chars) AS longest FROM documents GROUP BY 1""")
def words_by_language(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents", "lang", "text", "n_chars").groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.size(words("text"))).alias("n_words"), F.max("n_chars").alias("longest"))


@query("SELECT conv_id, count(*) AS n_turns, string_agg(role, '>' ORDER BY turn, role) AS roles FROM conversations GROUP BY 1")
def conversation_shapes(spark, sf_dir) -> DataFrame:
    return ordered_text(table(spark, sf_dir, "conversations", "conv_id", "turn", "role"), "conv_id", "turn", "role", ">", "n_turns", "roles")


def _communities(rounds: int) -> str:
    text = """WITH p AS (SELECT 's' || l_suppkey AS a, 'p' || l_partkey AS b, count(*) AS w FROM lineitem GROUP BY ALL
), e AS MATERIALIZED (SELECT a AS node, b AS other, w FROM p UNION ALL SELECT b, a, w FROM p), m AS (SELECT sum(w) AS m FROM e), s0 AS (SELECT node, sum(w) AS degree, node AS community FROM e GROUP BY 1
"""
    for r in range(rounds):
        text += f"""), c{r} AS (SELECT community, sum(degree) AS mass, count(*) AS members FROM s{r} GROUP BY 1
), n{r} AS (SELECT node, target, sum(w) AS w FROM (SELECT e.node, t.community AS target, w FROM e JOIN s{r} t ON t.node = e.other UNION ALL SELECT node, community, 0 FROM s{r}) GROUP BY ALL
), b{r} AS (SELECT s.node, target FROM n{r} n JOIN s{r} s USING (node) JOIN c{r} o ON o.community = s.community JOIN c{r} c ON c.community = target, m
  WHERE (md5(s.node)[1] >= '8') = {r % 2 == 1} AND (target = s.community OR o.members > 1 OR c.members > 1 OR target < s.community)
  QUALIFY row_number() OVER (PARTITION BY s.node ORDER BY m.m * w - s.degree * (c.mass - CASE WHEN target = s.community THEN s.degree ELSE 0 END) DESC, target <> s.community, target) = 1
), s{r + 1} AS MATERIALIZED (SELECT node, degree, coalesce(target, community) AS community FROM s{r} LEFT JOIN b{r} USING (node)
"""
    return text + f") SELECT node, community FROM s{rounds}"


@query(_communities(4))
def supply_communities(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey")
    return communities(lines.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")), 4)


#: The given pages hold links from the root only; scheme and host of a URL are lower case there, without a port.
_LINKS = r"""WITH l AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]*') || regexp_replace(h, '#.*$', '') AS target FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS h FROM pages)
), n AS (SELECT regexp_replace(url, '#.*$', '') AS url, min(page_id) AS page_id FROM pages GROUP BY 1)"""


@query(_LINKS + " SELECT target, count(*) AS n_links, count(DISTINCT l.page_id) AS n_pages, any_value(n.page_id) AS page_id FROM l LEFT JOIN n ON n.url = target GROUP BY target")
def link_targets(spark, sf_dir) -> DataFrame:
    return targets(table(spark, sf_dir, "pages", "page_id", "url", "html"))


@query("""WITH e AS (SELECT event_id, event_id % 6 AS c, props, json_extract(props, '$.k')::BIGINT AS k FROM events)
SELECT event_id, CASE WHEN c IN (1, 2) THEN 2 WHEN c IN (0, 4) THEN 1 ELSE 0 END AS n_objects, CASE WHEN c < 2 THEN k END AS k, CASE WHEN c < 2 THEN NULL WHEN c IN (2, 4) THEN 'k: type' ELSE 'no text' END AS reason FROM e""")
def records_in_notes(spark, sf_dir) -> DataFrame:
    """Notes of six kinds are made of the events: their JSON alone, in prose with stray quotes and braces, of wrong types, and none."""
    kinds = (
        "props", """concat('note "', event_type, ': ', props, ' {', props)""", """concat('{"k": "', event_id, '"} and {"key": ', event_id, '}')""", "'[1, 2] }{ \"'", """concat('{"key": ', event_id % 100, '.5}')""", "null",
    )
    note = F.expr("case event_id % 6 " + " ".join(f"when {i} then {x}" for i, x in enumerate(kinds)) + " end")
    found = table(spark, sf_dir, "events", "event_id", "event_type", "props").select("event_id", json_spans(note).alias("o"))
    found = found.select("event_id", F.coalesce(F.size("o"), F.lit(0)).alias("n_objects"), F.try_element_at("o", F.lit(1)).getField("json").alias("json"))
    found = found.withColumn("n_objects", F.greatest("n_objects", F.lit(0)))
    return typed(found, "json", [Field("k", "bigint", ("k", "key"))]).drop("json")
