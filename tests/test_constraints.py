import pytest

from sparkloom.operators.constraints import Apart, Determines, Holds, Refers, Same, Side, Some, Unique, violations

FILES = [("a", "x", 1), ("b", "x", 2), ("c", "y", 3), ("c", "y", 3), (None, "z", 4), ("d", "x", None)]
LAYERS = [("L1", "a"), ("L1", "b"), ("L2", "b"), ("L2", "q"), ("L3", None)]
RULES = [
    Unique("file id", Side("files", ("path",))),
    Refers("layer has files", Side("layers", ("path",)), Side("files", ("path",))),
    Refers("file is in a layer", Side("files", ("path",), "size is not null"), Side("layers", ("path",))),
    Determines("one layer a file", Side("layers", ("path",)), "layer"),
    Same("sets", Side("files", ("lang", "path")), Side("wanted", ("lang", "path"))),
    Apart("layer is no file", Side("layers", ("lower(layer)",)), Side("files", ("path",))),
    Apart("path is both", Side("layers", ("path",)), Side("files", ("path",), "lang = 'x'")),
    Holds("size", Side("files", ("path", "lang")), "size < 4"),
    Some("some big", Side("files", (), "size > 100")),
    Some("some small", Side("files", (), "size > 1")),
]
WANTED = {
    ("file id", "Unique", ("c",), 2, 0), ("layer has files", "Refers", ("q",), 1, 0), ("file is in a layer", "Refers", ("c",), 2, 0), ("one layer a file", "Determines", ("b",), 2, 0),
    ("sets", "Same", ("x", "d"), 1, 0), ("sets", "Same", ("y", "e"), 0, 1), ("path is both", "Apart", ("a",), 1, 1), ("path is both", "Apart", ("b",), 2, 1),
    ("size", "Holds", ("", "z"), 1, 0), ("size", "Holds", ("d", "x"), 1, 0), ("some big", "Some", (), 0, 0),
}


def tables(spark, tmp_path=None):
    made = {
        "files": spark.createDataFrame(FILES, "path string, lang string, size int"), "layers": spark.createDataFrame(LAYERS, "layer string, path string"),
        "wanted": spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "c"), ("y", "e")], "lang string, path string"),
    }
    if tmp_path:
        for n, df in made.items():
            df.write.parquet(str(tmp_path / n))
            made[n] = spark.read.parquet(str(tmp_path / n))
    return made


def found(df):
    return {(r.rule, r.kind, tuple(r.key), r.n_left, r.n_right) for r in df.collect()}


def test_planted_faults(spark):
    df = violations(tables(spark), RULES)
    assert found(df) == WANTED and df.count() == len(WANTED)


def test_one_scan_a_table(spark, tmp_path):
    df = violations(tables(spark, tmp_path), RULES)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.index("Final Plan") : plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    assert plan.count("FileScan parquet") == 3 and plan.count("Exchange hashpartitioning") == 1


def test_empty_tables(spark):
    empty = {n: df.limit(0) for n, df in tables(spark).items()}
    assert {r[0] for r in found(violations(empty, RULES))} == {"some big", "some small"}


def test_refused(spark):
    with pytest.raises(ValueError, match="no table"):
        violations(tables(spark), [Unique("x", Side("nothing", ("a",)))])
    with pytest.raises(ValueError, match="different names"):
        violations(tables(spark), [RULES[0], RULES[0]])
    with pytest.raises(ValueError, match="no rules"):
        violations(tables(spark), [])
