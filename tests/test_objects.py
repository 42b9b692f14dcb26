import json
import random

import pytest

from sparkloom.functions.objects import Field, discovered, json_spans, spans, typed


def strict(text, kind):
    def refuse(_):
        raise ValueError

    try:
        value = json.loads(text, parse_constant=refuse)
    except (ValueError, RecursionError):
        return False
    return text[0] + text[-1] in {"object": ("{}",), "array": ("[]",), "any": ("{}", "[]")}[kind] and isinstance(value, (dict, list))


def slow(text, kind):
    """From the left, the first start with an end that makes a JSON value."""
    found, at = [], 0
    while at < len(text):
        end = next((e for e in range(at + 2, len(text) + 1) if strict(text[at:e], kind)), None)
        found += [(at, end)] if end else []
        at = end or at + 1
    return found


HARD = [
    "", "no braces", "{}", '} {"a":1}', 'say "hi {"a":1}', '{"a":"}"}', '{"a":"\\"}"} {', '{"a":{"b":[1,{"c":2}]}} tail {"d":null}', '{broken {"in":1}', '{"a":1', '{"a":NaN}{"b":1e5}', "{'a':1}", '```json\n{"a": true}\n```',
    '{"é\U0001f600":"ü"}x{ }', '[{"a":1}]', "[1, [2]] [", '{"a":1,}', '{"a" :\n1}{"b":2}', '{"a":"\n"}', "{" * 50, '{"a":' * 30 + "1" + "}" * 29, '[as asked]: [{"a":1}]',
]


@pytest.mark.parametrize("kind", ["object", "array", "any"])
def test_like_a_slow_parser(kind):
    rng = random.Random(3)
    bits = ["{", "}", "[", "]", '"', "\\", ":", ",", "1", '"a"', '"a":', " ", "true", "x", '{"a":1}', '"}"', "\n"]
    for text in [*HARD, *("".join(rng.choices(bits, k=rng.randrange(14))) for _ in range(800))]:
        assert spans(text, kind) == slow(text, kind), text


def test_very_deep_and_long():
    assert spans('{"a":' * 3000 + '{"b":1}')[-1] == (15_000, 15_007)
    assert len(spans('x {"a":1} ' * 100_000)) == 100_000


def test_column(spark):
    rows = spark.createDataFrame([(1, 'é {"a":1} {'), (2, None), (3, "")], "id int, text string").select("id", json_spans("text").alias("o")).collect()
    assert {r.id: r.o and [tuple(x) for x in r.o] for r in rows} == {1: [(2, 9, '{"a":1}')], 2: None, 3: []}


FIELDS = [Field("k", "bigint", ("k", "key")), Field("name", "string"), Field("x", "double", needed=False)]


def test_typed(spark):
    cases = {
        '{"k":1,"name":"a"}': (1, "a", None, None), '{"k":1,"name":"a","x":2}': (1, "a", 2.0, None), '{"k":1,"name":"","x":2.5}': (1, "", 2.5, None), '{"key":7,"name":"a"}': (7, "a", None, None), '{"k":"1","key":7,"name":"a"}': (7, "a", None, None),
        '{"k":null,"key":7,"name":"a","x":null}': (7, "a", None, None), '{"k":"1","name":"a"}': "k: type", '{"k":1.5,"name":"a"}': "k: type", '{"name":"a"}': "k: missing", '{"k":1}': "name: missing", '{"k":1,"name":5}': "name: type", '{"k":1,"name":"a","x":"2"}': "x: type",
        "[1]": "no object", "5": "no object", "null": "no object", "{": "no json", "": "no json", '{"k":1,"name":{"a":1}}': "name: type", '{"k":{},"name":[]}': "k: type",
    }
    df = spark.createDataFrame([(t, "old", 3) for t in [*cases, None]], "props string, k string, other int")
    got = {r.props: r for r in typed(df, "props", FIELDS).collect()}
    for text, want in [*cases.items(), (None, "no text")]:
        r = got[text]
        assert (r.k, r.name, r.x, r.reason) == (want if isinstance(want, tuple) else (None, None, None, want)), text
        assert r.other == 3
    assert typed(df.limit(0), "props", FIELDS).count() == 0
    for bad in (Field("d", "date"), Field("d", "string", ("a.b",))):
        with pytest.raises(ValueError):
            typed(df, "props", [bad])


def test_discovered(spark):
    df = spark.createDataFrame([('{"a":1}',), ('{"a":2.5,"b":"x"}',), ("{",), (None,)], "t string")
    r = discovered(df, "t").first()
    assert (r.n_json, r.n_other) == (2, 1) and "a: DECIMAL" in r.schema.replace("a: DOUBLE", "a: DECIMAL") and "b: STRING" in r.schema
