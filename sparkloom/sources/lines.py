"""Lines of text files with their numbers, and state that runs along them, though files are read in splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.sources.tables import materialize


def _carried(rows: DataFrame, totals: dict[str, Column], kinds: dict[str, str]) -> DataFrame:
    """Per split (file, block) what the splits before it in its file amount to: sums, or the last value that is not null. A row a split."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    of = {"sum": lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)), "last": lambda c: F.last(c, ignorenulls=True).over(before)}
    splits = rows.groupBy("file", "block").agg(*(x.alias(n) for n, x in totals.items()))
    return materialize(splits.select("file", "block", *(of[kinds[n]](n).alias(f"{n}_before") for n in totals)), "splits")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, line (from 1), text of the text files at a path: numbers are those of a plain read, whatever the splits.

    A split knows where it starts in its file, and its own rows in order; a count for each split, summed along the file,
    does the rest. Lines end at \\n, \\r\\n or \\r, as Spark has it; an empty file has none. Compressed files are one split.
    Rows are written once, as their order within a split is that of one reading.
    """
    rows = spark.read.text(path).select(F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))
    rows = materialize(rows, "lines")
    starts = _carried(rows, {"n": F.count("*")}, {"n": "sum"})
    firsts = rows.groupBy("file", "block").agg(F.min("at").alias("first"))  # rows of a split have numbers without gaps
    splits = materialize(starts.join(firsts, ["file", "block"]), "starts")
    return rows.join(splits, ["file", "block"]).select("file", "block", (F.col("n_before") + F.col("at") - F.col("first") + 1).alias("line"), "text")


def sections(lines: DataFrame) -> DataFrame:
    """Adds to numbered lines of Markdown: fenced (the line is in, opens or closes a code fence), heading and level (of the section that the line is in; null before the first).

    A line that starts, after up to three spaces, with ``` opens a fence or closes the open one; a line of one to six #
    and a space outside of fences begins a section, to which it belongs. The state at a split's start is carried over from
    the splits before, first the parity of fences, then the last heading: no task gets more than a split.
    """
    lines = materialize(lines.withColumn("__mark", F.regexp_like("text", F.lit(r"^ {0,3}```")).cast("int")), "marked")
    within = Window.partitionBy("file", "block").orderBy("line")
    so_far = within.rowsBetween(Window.unboundedPreceding, 0)
    carried = _carried(lines, {"marks": F.sum("__mark")}, {"marks": "sum"})
    rows = lines.join(carried, ["file", "block"]).withColumn("__marks", F.col("marks_before") + F.sum("__mark").over(so_far)).drop("marks_before")
    rows = rows.withColumn("fenced", (F.col("__marks") % 2 == 1) | (F.col("__mark") == 1))
    head = F.when(~F.col("fenced") & F.regexp_like("text", F.lit(r"^#{1,6} ")), F.struct(F.trim(F.regexp_extract("text", r"^#+ (.*)$", 1)).alias("heading"), F.length(F.regexp_extract("text", "^#+", 0)).alias("level")))
    rows = materialize(rows.withColumn("__head", head).drop("__mark", "__marks"), "headed")
    last = F.max_by("__head", F.when(F.col("__head").isNotNull(), F.col("line")))
    carried = _carried(rows, {"head": last}, {"head": "last"})
    own = F.coalesce(F.last("__head", ignorenulls=True).over(so_far), F.col("head_before"))
    found = rows.join(carried, ["file", "block"]).withColumn("__own", own)
    return found.select("file", "block", "line", "text", "fenced", F.col("__own.heading").alias("heading"), F.col("__own.level").alias("level"))


def tail(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The last n lines of each file, numbered."""
    lines = numbered_lines(spark, path)
    ends = materialize(lines.groupBy("file").agg(F.max("line").alias("__end")), "ends")
    return lines.join(ends, "file").filter(F.col("line") > F.col("__end") - n).drop("__end")
