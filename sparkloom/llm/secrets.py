"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Each row of a table of versions is a text at a path, at a version of the path if the table tells versions apart;
the text is a blob named by its SHA-256. The ledger has a row for each pair of blob and rule version that was
ever scanned, with its findings. A scan takes each blob of the given versions once, leaves out the pairs that the
ledger has, scans and appends the rest, and joins findings back to every path that holds the blob.
A blob that a third of all paths share is one row after the map-side part of the deduplication. Findings are
written before they are joined back, one row a blob, so that Spark may split such a blob's partition.

A ledger is a folder of Parquet files that the caller keeps between scans. The registered query keeps one of its own run
in the shared folder: its versions come in INCREMENTS, each of which scans only the blobs that earlier ones have not;
every blob of the table is scanned once in each run. `redact` without a ledger starts an empty one and scans all at once.

Positions come from one pass per rule: matches are taken with the text before them, anchored at the last
match's end, and their lengths are summed along the blob.

Defined cases: a null text counts as empty and has no findings; repeated rows share a blob and get the same
findings; a null path or version is a path or version; a pair that the ledger holds twice, as after a retried
append, counts once; other columns of the versions are ignored by `scan` and kept by `redact`, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize, shared_folder

#: Parts in which the registered query's versions come.
INCREMENTS = 2

#: (kind, pattern, group whose length counts, least length). The order ranks kinds that start at one place.
#: The first three are the contract's, the others the published forms of keys that hosts hand out.
RULES = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
)
BASE = ("assign", "access", "hex")
_FINDINGS = "array<struct<start: bigint, rank: int, end: bigint, kind: string>>"
LEDGER = f"blob string, findings {_FINDINGS}, rule_version string"


def rule_version(rules=RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def _matches(text, rule) -> F.Column:
    """Of one rule: array of (rank, number, length with the gap before, length, does it count)."""
    rank, (kind, pattern, group, least) = rule
    every = F.lit(rf"(?s)\G(.*?)({pattern})")
    value = F.regexp_extract_all(text, every, F.lit(2 + group))
    all_ = F.arrays_zip(F.regexp_extract_all(text, every, F.lit(0)).alias("whole"), F.regexp_extract_all(text, every, F.lit(2)).alias("match"), value.alias("value"))
    rows = F.transform(all_, lambda x, i: F.struct(
        F.lit(rank).alias("rank"), i.alias("number"), F.length(x["whole"]).alias("length"), F.length(x["match"]).alias("own"), (F.length(x["value"]) >= least).alias("counts"),
    ))
    return F.when(text.rlike(pattern), rows).otherwise(F.array().cast("array<struct<rank: int, number: int, length: int, own: int, counts: boolean>>"))


def scan_blobs(blobs: DataFrame, rules=RULES) -> DataFrame:
    """Of blobs(blob, text), one row each: blob, rule_version, findings, sorted; empty where there are none."""
    found = F.flatten(F.array(*(_matches(F.col("text"), r) for r in enumerate(rules))))
    rows = blobs.select("blob", F.explode_outer(found).alias("m")).select("blob", "m.*")
    along = Window.partitionBy("blob", "rank").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("length").cast("bigint")).over(along))
    kind = F.element_at(F.array(*(F.lit(r[0]) for r in rules)), F.col("rank") + 1)
    finding = F.struct((F.col("end") - F.col("own")).alias("start"), F.col("rank"), F.col("end"), kind.alias("kind"))
    return rows.groupBy("blob").agg(F.sort_array(F.collect_list(F.when(F.col("counts"), finding))).cast(_FINDINGS).alias("findings")).withColumn("rule_version", F.lit(rule_version(rules)))


def _versions(versions: DataFrame, path: str, version: str | None, text: str) -> DataFrame:
    plain = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return versions.select(F.col(f"`{path}`").alias("path"), *([F.col(f"`{version}`").alias("version")] if version else []), plain.alias("text"), F.sha2(plain, 256).alias("blob"))


def _known(ledger: DataFrame, rules) -> DataFrame:
    """The ledger's rows of a rule version; scans that ran at the same time may have added a blob twice."""
    return ledger.filter(F.col("rule_version") == rule_version(rules)).select("blob", "findings", "rule_version").dropDuplicates(["blob"])


def _unseen(versions: DataFrame, ledger: DataFrame | None, rules) -> DataFrame:
    """The ledger's new rows: the scan of the blobs that it lacks."""
    blobs = versions.select("blob", "text").dropDuplicates(["blob"])
    if ledger is not None:
        blobs = blobs.join(ledger.filter(F.col("rule_version") == rule_version(rules)).select("blob"), "blob", "left_anti")
    return scan_blobs(blobs, rules).select("blob", "findings", "rule_version")


def _back(versions: DataFrame, every: DataFrame) -> DataFrame:
    return versions.drop("text").join(every.select("blob", "findings"), "blob", "left").select(*(c for c in versions.columns if c != "text"), "findings")


def scan(versions: DataFrame, path: str = "path", text: str = "text", ledger: DataFrame | None = None, rules=RULES, version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings of every row of versions: path, version if there is one, blob, findings; the ledger's new rows: blob, findings, rule_version).

    Append the new rows to the ledger for the next scan, or use `scan_kept`, which does.
    """
    versions = _versions(versions, path, version, text)
    new = _unseen(versions, ledger, rules)
    return _back(versions, new if ledger is None else _known(ledger, rules).unionByName(new)), new


def kept_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """The ledger in a folder; empty before the first scan."""
    spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(ledger)
    return spark.read.schema(LEDGER).parquet(ledger)


def _add(versions: DataFrame, ledger: str | None, rules) -> DataFrame:
    """Scans the blobs that the ledger in the folder lacks, appends them to it, and gives its rows of the rule version."""
    spark = versions.sparkSession
    if ledger is None:  # a run's own, with the rows of this scan alone
        return materialize(_unseen(versions, None, rules), "secrets-ledger")
    _unseen(versions, kept_ledger(spark, ledger), rules).write.mode("append").parquet(ledger)
    return materialize(_known(kept_ledger(spark, ledger), rules), "findings")


def scan_kept(versions: DataFrame, path: str = "path", text: str = "text", ledger: str | None = None, rules=RULES, version: str | None = None) -> DataFrame:
    """The findings that `scan` gives, by way of the ledger kept in a folder; without one, of a new ledger of this run."""
    versions = _versions(versions, path, version, text)
    return _back(versions, _add(versions, ledger, rules))


def scan_increments(versions: DataFrame, path: str = "path", text: str = "text", rules=RULES, parts: int = INCREMENTS, ledger: str | None = None) -> DataFrame:
    """The findings that `scan` gives, of versions that come in parts (by a hash of the path), with one ledger for all: a part scans only what those before it left."""
    spark = versions.sparkSession
    versions = _versions(versions, path, None, text)
    ledger = ledger or f"{shared_folder(spark)}/sparkloom-ledger-{uuid.uuid4().hex}"
    for k in range(parts):
        part = versions.filter(F.coalesce(F.pmod(F.xxhash64(F.col("path").cast("string")), F.lit(parts)), F.lit(0)) == k)
        _unseen(part, kept_ledger(spark, ledger), rules).write.mode("append").parquet(ledger)
    return _back(versions, _known(kept_ledger(spark, ledger), rules))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", ledger: str | None = None, rules=RULES) -> DataFrame:
    """docs with every found span of the text replaced by the mark, by way of a ledger; where there is n_chars, it is the new length."""
    plain = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), plain.alias("text"), F.sha2(plain, 256).alias("blob"))
    # blobs without a match are left out of the join's small side
    found = _add(rows.select("blob", "text"), ledger, rules).filter(F.size("findings") > 0).select("blob", "findings")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    whole = F.col("text")

    def put(acc, x):
        gap = F.when(x["start"] > acc["at"], F.concat(F.substring(whole, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), F.lit(mark)))
        gap = F.when((x["start"] == acc["at"]) & (acc["at"] == 0), F.lit(mark)).otherwise(F.coalesce(gap, F.lit("")))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    clean = F.aggregate("findings", start, put, lambda acc: F.concat(acc["out"], F.substring(whole, (acc["at"] + 1).cast("int"), F.length(whole))))
    hit = F.col("findings").isNotNull()
    joined = rows.join(found, "blob", "left").withColumn("clean", F.when(hit, clean))
    new = {c: F.col("row").getField(c) for c in docs.columns}
    new[text] = F.when(hit, F.col("clean")).otherwise(new[text])
    if "n_chars" in new:
        new["n_chars"] = F.when(hit, F.length("clean").cast("bigint")).otherwise(new["n_chars"])
    return joined.select(*(x.alias(c) for c, x in new.items()))


def _line(findings) -> F.Column:
    return F.concat_ws(",", F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def _is(kind: str):
    return lambda x: x["kind"] == kind


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan_increments(spark.read.parquet(f"{sf_dir}/documents.parquet"), path="doc_id")
    base = F.filter("findings", lambda x: x["rank"] < len(BASE))
    counts = [F.size(F.filter("findings", _is(k))).cast("bigint").alias(f"n_{k}") for k in BASE]
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(_line(base), 256).alias("base_sha256"), _line(F.col("findings")).alias("spans"))
