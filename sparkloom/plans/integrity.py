"""The registered query of the constraint engine: rules over most of the given tables, some of which the data breaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.constraints import Apart, Determines, Holds, Refers, Same, Side, Some, Unique, violations
from sparkloom.plans.catalog import query
from sparkloom.sources.tables import table

RULES = [
    Unique("line of an order", Side("lineitem", ("l_orderkey", "l_linenumber"))),
    Unique("document", Side("documents", ("doc_id",))),
    Refers("order has a customer", Side("orders", ("o_custkey",)), Side("customer", ("c_custkey",))),
    Refers("customer ordered urgently", Side("customer", ("c_custkey",)), Side("orders", ("o_custkey",), "o_orderpriority = '1-URGENT' and o_orderstatus = 'F'")),
    Refers("label has a document", Side("labels", ("doc_id",)), Side("documents", ("doc_id",))),
    Refers("turn has one before", Side("conversations", ("conv_id", "turn - 1"), "turn > 0"), Side("conversations", ("conv_id", "turn"))),
    Same("priorities of dear and cheap orders", Side("orders", ("o_orderstatus", "o_orderpriority"), "o_totalprice >= 2000"), Side("orders", ("o_orderstatus", "o_orderpriority"), "o_totalprice < 2000")),
    Apart("debtor has no open order", Side("customer", ("c_custkey",), "c_acctbal < 0"), Side("orders", ("o_custkey",), "o_orderstatus = 'P'")),
    Determines("brand of a type", Side("part", ("p_type",)), "p_brand"),
    Holds("length of a text", Side("documents", ("doc_id",)), "n_chars = char_length(text)"),
    Holds("quantity by flag", Side("lineitem", ("l_returnflag", "l_linestatus")), "l_quantity < 50"),
    Holds("grades", Side("labels", ("quality", "toxic")), "quality in (0, 1) and toxic in (0, 1)"),
    Some("a region", Side("region", ())),
    Some("an order of no price", Side("orders", (), "o_totalprice = 0")),
]


def _sql() -> str:
    def head(name: str, kind: str, keys: str) -> str:
        return f"SELECT '{name}' AS rule, '{kind}' AS kind, {keys} AS key"

    def pair(name: str, kind: str, a: str, b: str, having: str) -> str:
        return f"{head(name, kind, 'key')}, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right, NULL AS least_value, NULL AS greatest_value FROM ({a}) a FULL JOIN ({b}) b USING (key) WHERE {having}"

    def keys(expression: str, source: str) -> str:
        return f"SELECT {expression} AS key, count(*) AS n FROM {source} GROUP BY 1"

    one = "0 AS n_right, NULL AS least_value, NULL AS greatest_value"
    refers, price = "coalesce(a.n, 0) > 0 AND b.n IS NULL", "o_orderstatus || '|' || o_orderpriority"
    return " UNION ALL ".join([
        f"{head('line of an order', 'Unique', "l_orderkey || '|' || l_linenumber")}, count(*) AS n_left, {one} FROM lineitem GROUP BY ALL HAVING count(*) > 1",
        f"{head('document', 'Unique', 'doc_id::VARCHAR')}, count(*) AS n_left, {one} FROM documents GROUP BY ALL HAVING count(*) > 1",
        pair("order has a customer", "Refers", keys("o_custkey::VARCHAR", "orders"), keys("c_custkey::VARCHAR", "customer"), refers),
        pair("customer ordered urgently", "Refers", keys("c_custkey::VARCHAR", "customer"), keys("o_custkey::VARCHAR", "orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'"), refers),
        pair("label has a document", "Refers", keys("doc_id::VARCHAR", "labels"), keys("doc_id::VARCHAR", "documents"), refers),
        pair("turn has one before", "Refers", keys("conv_id || '|' || (turn - 1)", "conversations WHERE turn > 0"), keys("conv_id || '|' || turn", "conversations"), refers),
        pair("priorities of dear and cheap orders", "Same", keys(price, "orders WHERE o_totalprice >= 2000"), keys(price, "orders WHERE o_totalprice < 2000"), "a.n IS NULL OR b.n IS NULL"),
        pair("debtor has no open order", "Apart", keys("c_custkey::VARCHAR", "customer WHERE c_acctbal < 0"), keys("o_custkey::VARCHAR", "orders WHERE o_orderstatus = 'P'"), "a.n > 0 AND b.n > 0"),
        f"{head('brand of a type', 'Determines', 'p_type')}, count(*), 0, min(p_brand), max(p_brand) FROM part GROUP BY ALL HAVING min(p_brand) <> max(p_brand)",
        f"{head('length of a text', 'Holds', 'doc_id::VARCHAR')}, count(*), {one} FROM documents WHERE (n_chars = length(text)) IS NOT TRUE GROUP BY ALL",
        f"{head('quantity by flag', 'Holds', "l_returnflag || '|' || l_linestatus")}, count(*), {one} FROM lineitem WHERE (l_quantity < 50) IS NOT TRUE GROUP BY ALL",
        f"{head('grades', 'Holds', "quality || '|' || toxic")}, count(*), {one} FROM labels WHERE (quality IN (0, 1) AND toxic IN (0, 1)) IS NOT TRUE GROUP BY ALL",
        f"{head('a region', 'Some', "''")}, 0, {one} WHERE NOT EXISTS (FROM region)",
        f"{head('an order of no price', 'Some', "''")}, 0, {one} WHERE NOT EXISTS (FROM orders WHERE o_totalprice = 0)",
    ])


@query(_sql())
def integrity(spark, sf_dir) -> DataFrame:
    names = sorted({s.table for r in RULES for s in (r.left, getattr(r, "right", None)) if s})
    return violations({n: table(spark, sf_dir, n) for n in names}, RULES).withColumn("key", F.array_join("key", "|"))
