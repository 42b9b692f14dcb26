"""Every stage of the pipeline on nulls, repeated rows, ties, long texts and clashing columns."""

import pytest

import corpus_pipeline as cp

DIR = "/root/testdata/sf0.001"
LONG = "A quiet river ran past the old mill, and nobody counted the days. " * 20_000
ROWS = [
    (9_000_001, "One short, clean text about rivers.", "en", "s", 35), (9_000_001, "One short, clean text about rivers.", "en", "s", 35), (9_000_002, "A", "en", "b", 1), (9_000_002, "A", "en", "a", 1),
    (9_000_002, "B other words", None, None, None), (None, "A null id, kept as it is.", "en", "s", 25), (None, "A null id, kept as it is.", "en", "s", 25), (9_000_003, None, None, None, None),
    (9_000_004, "", "en", "s", 0), (9_000_005, LONG, "en", "s", len(LONG)), (9_000_006, LONG, "en", "s", len(LONG)),
]
EXTRA = "component_id string, expected_grade string, contaminated int, item_ids int, overlap string, findings string, blob int, bands int, `a.b` string, row string, key int, extra0 int"


def frame(spark, rows=ROWS):
    names = [c.split()[0].strip("`") for c in EXTRA.split(", ")]
    values = tuple(1 if " int" in c else "x" for c in EXTRA.split(", "))
    df = spark.createDataFrame([(*r, *values) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA)
    assert df.columns[5:] == names
    return df


@pytest.mark.parametrize("stage", [f for _, f in cp.STAGES], ids=[n for n, _ in cp.STAGES])
def test_odd_rows(spark, stage):
    df = frame(spark)
    out = stage(spark, df, DIR)
    last = stage is cp.STAGES[-1][1]
    assert out.columns == [*df.columns, "n_tokens", "ids", "decoded_sha256"] if last else out.columns == df.columns
    got = out.collect()
    assert all(r["a.b"] == "x" and r["component_id"] == "x" and r["key"] == 1 for r in got)
    have = sorted((str(r.doc_id), str(r.text), str(r.source)) for r in got)
    if stage is cp.one_of_each:
        want = [ROWS[0], ROWS[3], ROWS[5], ROWS[6], ROWS[7], ROWS[8], ROWS[9]]
    elif stage is cp.good_quality:  # no row is rated, so that nothing is rejected
        want = ROWS
    else:
        want = ROWS
    assert have == sorted((str(r[0]), str(r[1]), str(r[3])) for r in want)
    assert stage(spark, df.limit(0), DIR).count() == 0


def test_repeated_ids_are_decided_alike_in_any_order(spark):
    df = frame(spark).repartition(5)
    a = sorted((str(r.doc_id), str(r.text), str(r.source)) for r in cp.one_of_each(spark, df, DIR).collect())
    b = sorted((str(r.doc_id), str(r.text), str(r.source)) for r in cp.one_of_each(spark, frame(spark, ROWS[::-1]), DIR).collect())
    assert a == b
