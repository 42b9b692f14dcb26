"""Every query with SQL against DuckDB on the smallest given tables; the pipeline's rules on the same."""

import duckdb
import pytest

from sparkloom.llm import queries

DIR = "/root/testdata/sf0.001"


def oracle(sql, where):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{where}/{t}.parquet')")
    r = c.sql(sql)
    return r.columns, r.fetchall()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_like_sql(spark, name):
    where = "/root/testdata/sf0.01" if name == "op5_secrets" else DIR  # the smallest has no secrets
    got = queries.QUERIES[name](spark, where)
    columns, want = oracle(queries.SQL[name], where)
    if name == "op5_secrets":
        assert any(sum(r[1:4]) for r in want)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want)) and sorted(columns) == sorted(got.columns)


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = {r.doc_id: r for r in cp.run(spark, DIR).collect()}
    assert 0 < len(rows) < docs.count()
    leaks = {r.doc_id for r in queries.QUERIES["op3_decontaminate"](spark, DIR).filter("contaminated").collect()}
    bad = {r.doc_id for r in spark.read.parquet(f"{DIR}/labels.parquet").filter("toxic = 1").collect()}
    assert not rows.keys() & leaks and len(rows.keys() & bad) <= len(bad) // 5
    assert all(len(r.ids) == r.n_tokens and r.n_chars == len(r.text) for r in rows.values())
    from sparkloom.llm.secrets import redact, scan

    assert redact(spark.createDataFrame([(r.doc_id, r.text) for r in rows.values()], "doc_id long, text string")).count() == len(rows)
    assert scan(spark.createDataFrame([(r.doc_id, r.text) for r in rows.values()], "path long, text string"))[0].filter("size(findings) > 0").count() == 0


def test_empty_stages(spark, tmp_path):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, DIR)
    assert docs.count() == 0
