"""From documents to token ids: quality, near duplicates, benchmark leaks, secrets, byte pairs.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before kept. All stages
but the last return the columns of documents, and further ones that docs has, unchanged.

Defined cases, for every stage: an empty table gives an empty one; a null text counts as empty and stays null;
repeated rows are documents each (the second stage keeps one of them); a null id is a document of its own; extra
columns pass, whatever their names; a text is read whole, up to some 40 MB: steps of the first three stages hold 35 to 50
bytes for each byte of the longest text. What a stage adds to that stands with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe, decontaminate, minhash, quality, secrets
from sparkloom.llm.shared import discard, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade reaches the cutoff; the model is learned from the rated ones among docs.

    Rows of one id and text are judged alike. Without ratings among docs all stay. Probabilities equal to the cutoff stay.
    """
    ratings = quality.graded(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    model = quality.learn(docs, ratings)
    return _named(quality.grade(_plain(docs), model).filter(F.col("top_probability") >= quality.CUTOFF), docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id.

    Of rows of one id, with whatever texts, that with the smallest text, lang, source and n_chars stays (nulls
    before all). Rows with a null id, and those without words, are linked with nothing and stay.
    """
    removed = materialize(minhash.link(docs).filter("not kept").select("doc_id").distinct(), "removed")
    kept = _plain(docs).join(removed, "doc_id", "left_anti")
    twice = materialize(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "twice")
    if not twice.isEmpty():
        order = F.struct(*(F.struct(F.col(c).isNotNull(), c) for c in COLUMNS[1:] if c in docs.columns))
        one = kept.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*(c for c in kept.columns if c != "doc_id")), order).alias("row"))
        kept = kept.join(twice, "doc_id", "left_anti").unionByName(one.select("doc_id", "row.*"))
    return _named(kept, docs)


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Rows of equal text are judged alike; an empty benchmark leaves all."""
    found = decontaminate.find_leaks(_plain(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _named(found.filter("not contaminated"), docs)


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced, n_chars with them."""
    return secrets.redact(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with n_tokens, ids and the SHA-256 of the text that the ids decode to (decoded_sha256); these three names are the stage's."""
    import public_tokenizers

    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return _named(bpe.encode(_plain(docs), vocabulary), docs, F.col("n_tokens"), F.col("ids"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _plain(docs: DataFrame) -> DataFrame:
    """docs with columns beyond those of documents numbered, so that none can clash with a name that an operator gives."""
    return docs.select(*(F.col(f"`{c}`").alias(c if c in COLUMNS else f"extra{i}") for i, c in enumerate(docs.columns)))


def _named(plain: DataFrame, docs: DataFrame, *more: Column) -> DataFrame:
    """The columns of docs under their own names, then more."""
    return plain.select(*(F.col(c if c in COLUMNS else f"extra{i}").alias(c) for i, c in enumerate(docs.columns)), *more)


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each), ("decontamination", no_leaks), ("secrets", no_secrets), ("tokens", token_ids)]

#: A fitted model decides in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
