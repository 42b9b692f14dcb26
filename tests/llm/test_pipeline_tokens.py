import hashlib

import public_tokenizers

import corpus_pipeline
from sparkloom.llm import bpe


def test_tokens_are_decoded(spark):
    docs = spark.createDataFrame([(1, "Some words, some more."), (2, ""), (3, None)], "doc_id long, text string")
    e = bpe.Encoder(bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json")))
    for r in corpus_pipeline.token_ids(spark, docs, "").collect():
        ids = e.encode([r.text or ""])[0]
        assert r.ids == ids.tolist() and r.decoded_sha256 == hashlib.sha256(e.decode(ids).encode()).hexdigest()
