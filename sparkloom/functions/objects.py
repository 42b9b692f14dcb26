"""JSON objects in messy text, and typed records out of them, with the reason for each that is refused."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STARTS = {"object": re.compile(r'\{(?=[ \t\r\n]*["}])'), "array": re.compile(r"\["), "any": re.compile(r'\[|\{(?=[ \t\r\n]*["}])')}


def _refuse(name: str) -> None:
    raise ValueError(name)  # NaN and the infinities, which JSON does not have


_DECODER = json.JSONDecoder(parse_constant=_refuse, parse_int=lambda _: 0, parse_float=lambda _: 0.0)


def spans(text: str, kind: str = "object") -> list[tuple[int, int]]:
    """Start and end of every JSON value of that kind that stands in the text, the outermost ones, from the left.

    Whether a brace opens an object depends on nothing before it: at each one a JSON value is read, strings, escapes and
    nesting as JSON has them. Where there is none, the search goes on behind that brace alone; so stray braces and quotes
    in the text around hide nothing, and an object inside a broken one is found. Nesting of a thousand levels or so is none.
    """
    found, at, starts = [], 0, _STARTS[kind]
    while m := starts.search(text, at):
        try:
            end = _DECODER.raw_decode(text, m.start())[1]
        except (ValueError, RecursionError):
            at = m.start() + 1
            continue
        found.append((m.start(), end))
        at = end
    return found


def _column(kind: str):
    @F.arrow_udf("array<struct<start:int,end:int,json:string>>")
    def objects(texts: pa.Array) -> pa.Array:
        rows = [None if t is None else [{"start": a, "end": b, "json": t[a:b]} for a, b in spans(t, kind)] for t in texts.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("json", pa.string())])))

    return objects


def json_spans(text: Column | str, kind: str = "object") -> Column:
    """Array of (start, end, json) of the JSON objects in a text, or of its arrays, or of any of both; positions count code points. Null of a null."""
    return _column(kind)(text)


@dataclass(frozen=True)
class Field:
    """A field of a record: its type as Spark writes it, and the names that it may have, of which the first that has a value of that type counts."""

    name: str
    type: str
    names: tuple[str, ...] = ()
    needed: bool = True


#: Of a type the schema_of_variant of values that are taken for it as they are.
_TAKES = {
    "bigint": ("BIGINT",), "double": ("BIGINT", "DOUBLE", "DECIMAL"), "string": ("STRING",), "boolean": ("BOOLEAN",),
}


def _value(record: Column, field: Field) -> tuple[Column, Column]:
    """The field's value, and whether a name of it is there with a value of another type."""
    if field.type not in _TAKES:
        raise ValueError(f"{field.name}: a field is one of {', '.join(_TAKES)}")
    values, odd = [], []
    for name in field.names or (field.name,):
        if not re.fullmatch(r"\w+", name):
            raise ValueError(f"{name}: names are letters, digits and underscores")
        got = F.try_variant_get(record, f"$.{name}", "variant")
        kind = F.regexp_extract(F.schema_of_variant(got), r"^\w+", 0)
        fits = kind.isin(*_TAKES[field.type])
        values.append(F.when(fits, F.try_variant_get(record, f"$.{name}", field.type)))
        odd.append(F.coalesce(~fits & (kind != "VOID"), F.lit(False)))
    value = F.coalesce(*values)
    some = odd[0]
    for o in odd[1:]:
        some = some | o
    return value, value.isNull() & some


def typed(rows: DataFrame, text: str, fields: list[Field], reason: str = "reason") -> DataFrame:
    """Adds the fields of the JSON object in a column, and why a row is refused: null if it isn't, and then every needed field has a value.

    Reasons: "no text", "no json", "no object", then for the first field that fails "<name>: missing" or "<name>: type". A
    value counts only in its JSON type (a bigint is a number without fraction, a double any number); JSON's null is as
    missing. An optional field of another type refuses the row as well. Columns named like a field or the reason give way.
    """
    plain = rows.drop(*(f.name for f in fields if f.name != text), *([reason] if reason != text else []))
    plain = plain.withColumn("__v", F.try_parse_json(F.col(text)))
    shape = F.regexp_extract(F.schema_of_variant("__v"), r"^\w+", 0)
    problem = F.when(F.col(text).isNull(), "no text").when(F.col("__v").isNull(), "no json").when(shape != "OBJECT", "no object")
    columns = []
    for f in fields:
        value, odd = _value(F.col("__v"), f)
        columns.append(value.alias(f"__f{len(columns)}"))
        problem = problem.when(odd, f"{f.name}: type")
        problem = problem.when(value.isNull(), f"{f.name}: missing") if f.needed else problem
    kept = [c for c in plain.columns if c not in {"__v", *(f.name for f in fields), reason}]
    found = plain.select(*(F.col(f"`{c}`") for c in kept), *columns, problem.alias(reason))
    values = (F.when(F.col(reason).isNull(), F.col(f"__f{i}")).alias(f.name) for i, f in enumerate(fields))
    return found.select(*(F.col(f"`{c}`") for c in kept), *values, reason)


def discovered(rows: DataFrame, text: str) -> DataFrame:
    """One row: the schema that fits all JSON values in a column, merged on the map side, and how many are none."""
    v = F.try_parse_json(F.col(text))
    return rows.agg(F.schema_of_variant_agg(v).alias("schema"), F.count(v).alias("n_json"), F.count_if(F.col(text).isNotNull() & v.isNull()).alias("n_other"))
