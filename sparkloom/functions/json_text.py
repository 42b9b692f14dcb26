"""Records in messy text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_field(text: Column | str, field: str) -> Column:
    """The named number of a JSON object, null where the text is no object or lacks it."""
    return F.get_json_object(text, f"$.{field}").try_cast("double")


def words(text: Column | str) -> Column:
    """Words between ASCII white space; none in a null."""
    return F.filter(F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
