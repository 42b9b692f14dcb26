"""Every registered query with SQL against DuckDB on the smallest given tables."""

import math

import duckdb
import pytest

from sparkloom.plans import catalog, integrity, sets, state  # noqa: F401

DIR = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(str(tuple(round(x, 4) + 0.0 if isinstance(x, float) and math.isfinite(x) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_like_sql(spark, name):
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents labels pages conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    want = c.sql(catalog.SQL[name])
    got = catalog.QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.select(*want.columns).collect()) == plain(want.fetchall())
