import random

import pyarrow as pa

from sparkloom.llm.shared import BATCH_BYTES, bound_batches, span_hashes, trimmed, utf8, word_bounds

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_are_bounded_only_where_the_session_sets_nothing(spark):
    before = spark.conf.get(KEY, None)
    try:
        spark.conf.unset(KEY)
        bound_batches(spark)
        assert spark.conf.get(KEY) == str(BATCH_BYTES)
        spark.conf.set(KEY, "32m")
        bound_batches(spark)
        assert spark.conf.get(KEY) == "32m"
    finally:
        spark.conf.set(KEY, before) if before else spark.conf.unset(KEY)


def test_scans_are_bounded_only_where_the_session_sets_nothing(spark):
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        bound_batches(spark)
        assert int(spark.conf.get(key)) <= 1024
        spark.conf.set(key, "4096")
        bound_batches(spark)
        assert spark.conf.get(key) == "4096"
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def test_steps_of_texts_keep_temporary_arrays_small():
    """Words and shingles of a batch of texts: some 50 bytes for each byte of a step, not of the batch."""
    import tracemalloc

    import numpy as np

    from sparkloom.llm.minhash import _profiles

    rng = random.Random(7)
    texts = [" ".join(rng.choice(("alpha", "beta", "gamma", "delta")) + str(rng.randrange(999)) for _ in range(120)) for _ in range(1200)]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(1200)), pa.array(texts)], names=["doc_id", "text"])
    tracemalloc.start()
    try:
        rows = sum(x.num_rows for x in _profiles(5)(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 1200 and most < 32 << 20


def thue_morse(a, b, n):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_long_words_of_other_letters_differ():
    """Complementary Thue-Morse words, for which every polynomial modulo 2**64 gives one value."""
    words = [thue_morse(a, b, n) for n in (512, 1024, 2048, 4096) for a, b in (("a", "b"), ("b", "a"), ("k", "q"), ("q", "k"))]
    data, offsets = utf8(pa.array(words))
    assert len(set(span_hashes(data, offsets[:-1], offsets[1:], fold=True, twice=True).tolist())) == len(words)
    again, at = utf8(pa.array(["x", *words[::-1]]))
    assert span_hashes(again, at[1:-1], at[2:], fold=True, twice=True)[::-1].tolist() == span_hashes(data, offsets[:-1], offsets[1:], fold=True, twice=True).tolist()


def test_such_words_are_not_linked_nor_removed(spark):
    from sparkloom.llm import minhash, substring_dedup

    a, b = thue_morse("a", "b", 1024), thue_morse("b", "a", 1024)
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert all(r.kept for r in minhash.link(docs).collect())
    docs = spark.createDataFrame([(1, " ".join([a] * 35)), (2, " ".join([b] * 35))], "doc_id long, text string")

    assert all(r.n_removed == 0 for r in substring_dedup.remove_repeats(docs).collect())


def test_trimmed_against_a_slow_version():
    """Words without marks, with a few, with more than are looked at one by one, and of marks alone."""
    rng = random.Random(61)
    parts = ["a", "Zb", "é", "don't", ".", ",,", "-" * 9, "(" * 5, " ", "  "]
    for _ in range(500):
        data, offsets = utf8(pa.array(["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(4)]))
        starts, ends, _ = word_bounds(data, offsets)
        marks = bytes(b for b in range(33, 127) if not chr(b).isalnum())
        for s, e, lo, hi in zip(*(x.tolist() for x in (starts, ends, *trimmed(data, starts, ends))), strict=True):
            word = data[s:e].tobytes()
            left = s + len(word) - len(word.lstrip(marks))
            assert (lo, hi) == ((left, left + len(word.strip(marks))) if word.strip(marks) else (e, e))
