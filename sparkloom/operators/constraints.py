"""Rules that tables must keep, declared as data and checked together: one scan of each table, one shuffle, one table of violations.

Every rule says something about keys: which occur on its left side, which on its right side, and with which values. So
a row of a table becomes a few facts (rule, key, side, value), one for each rule that it has a part in, and all facts
of all tables are aggregated together by (rule, key), on the map side first: a key with very many rows costs a row for
each task. What a rule forbids is a condition on these counts.

A key is a list of SQL expressions over the table's columns, compared as strings. Rows with a null in a key have no part
in a rule about keys, as in SQL; that there are no nulls is a rule of its own (Holds). `where` restricts a side's rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Side:
    table: str
    key: tuple[str, ...]
    where: str | None = None


@dataclass(frozen=True)
class Unique:
    """No key occurs twice."""

    name: str
    left: Side
    broken = "n_left > 1"


@dataclass(frozen=True)
class Refers:
    """Every key of the left side occurs on the right side. Turned around it says that the left covers the right."""

    name: str
    left: Side
    right: Side
    broken = "n_left > 0 and n_right = 0"


@dataclass(frozen=True)
class Same:
    """Both sides have the same keys. With (group, member) as key: the same members in every group."""

    name: str
    left: Side
    right: Side
    broken = "(n_left > 0) <> (n_right > 0)"


@dataclass(frozen=True)
class Apart:
    """No key occurs on both sides."""

    name: str
    left: Side
    right: Side
    broken = "n_left > 0 and n_right > 0"


@dataclass(frozen=True)
class Determines:
    """A key has one value at most; a null is none."""

    name: str
    left: Side
    value: str
    broken = "least_value <> greatest_value"


@dataclass(frozen=True)
class Holds:
    """The condition is true in every row; false and null are violations, listed by key with their number. Nulls in a key are allowed here, as the empty string."""

    name: str
    left: Side
    condition: str
    broken = "n_left > 0"


@dataclass(frozen=True)
class Some:
    """There is a row."""

    name: str
    left: Side
    broken = "n_left = 0"


Rule = Unique | Refers | Same | Apart | Determines | Holds | Some
_FACT = "array<struct<rule:int,key:array<string>,side:int,value:string>>"


def _facts_of(rule: Rule, number: int, side: Side, at: int) -> Column:
    """The fact of a row, null if it has none."""
    key = F.array(*(F.expr(k).cast("string") for k in side.key)) if side.key else F.array().cast("array<string>")
    takes_part = F.expr(side.where) if side.where else F.lit(True)
    if isinstance(rule, Holds):
        takes_part = takes_part & ~F.coalesce(F.expr(rule.condition), F.lit(False))
        key = F.transform(key, lambda k: F.coalesce(k, F.lit("")))
    else:
        takes_part = takes_part & F.forall(key, lambda k: k.isNotNull())
    value = F.expr(rule.value).cast("string") if isinstance(rule, Determines) else F.lit(None).cast("string")
    return F.when(takes_part, F.struct(F.lit(number).alias("rule"), key.alias("key"), F.lit(at).alias("side"), value.alias("value")))


def violations(tables: dict[str, DataFrame], rules: list[Rule]) -> DataFrame:
    """rule, kind, key (array of strings), n_left, n_right, least_value, greatest_value: a row for each key that breaks a rule.

    Rules need different names. Tables without rows have no facts: only Some is broken by that, and Refers, Same by what
    the other side has. Rules about a table that isn't given are an error.
    """
    if len({r.name for r in rules}) < len(rules):
        raise ValueError("rules need different names")
    by_table: dict[str, list[Column]] = {}
    for number, rule in enumerate(rules):
        for at, side in enumerate(s for s in (rule.left, getattr(rule, "right", None)) if s):
            if side.table not in tables:
                raise ValueError(f"{rule.name}: no table {side.table}")
            by_table.setdefault(side.table, []).append(_facts_of(rule, number, side, at))
    parts = [tables[t].select(F.explode(F.filter(F.array(*facts), lambda f: f.isNotNull()).cast(_FACT)).alias("f")).select("f.*") for t, facts in by_table.items()]
    if not parts:
        raise ValueError("no rules")
    some = [i for i, r in enumerate(rules) if isinstance(r, Some)]
    if some:  # else a rule without rows would not come up
        spark = parts[0].sparkSession
        parts.append(spark.createDataFrame([(i, [], 1, None) for i in some], parts[0].schema))
    facts = reduce(DataFrame.unionByName, parts)
    left = (F.col("side") == 0).cast("long")
    counted = facts.groupBy("rule", "key").agg(F.sum(left).alias("n_left"), F.sum(1 - left).alias("n_right"), F.min("value").alias("least_value"), F.max("value").alias("greatest_value"))
    broken = F.expr("case rule " + " ".join(f"when {i} then {r.broken}" for i, r in enumerate(rules)) + " end")
    named = (F.element_at(F.array(*(F.lit(x) for x in xs)), F.col("rule") + 1).alias(n) for n, xs in (("rule", [r.name for r in rules]), ("kind", [type(r).__name__ for r in rules])))
    found = counted.filter(broken)
    n_right = F.when(F.col("rule").isin(some), F.lit(0)).otherwise(F.col("n_right")) if some else F.col("n_right")
    return found.select(*named, "key", "n_left", n_right.cast("long").alias("n_right"), "least_value", "greatest_value")
