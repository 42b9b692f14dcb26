import random

import public_tokenizers
from tokenizers import Tokenizer

from sparkloom.llm.bpe import Encoder, Vocabulary, encode

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = [
    "", " ", "Hello, World's  best\tsoup", "aaaaaaaaaaaaaaaaaa", "ΟΔΟΣ ΣΣ", "İstanbul ǅ ẞ", "été", "x<|endoftext|>Y <|startoftext|><|endoftext|>", "a\x1cb\x1db\x85c᠎d​E",
    "日本語テキスト 123 ½ ٣", "!!!??? --- ...'''s 'S 'LL", "\U0001f600\U0001f468‍\U0001f469", "\x00\x01 a\x00b", "the the THE", "x" * 5000, "ẛ̣ Ω Å", "<|END", "i'm you'Re we've he'd'll",
]


def test_like_the_library():
    t, e, rng = Tokenizer.from_file(PATH), Encoder(Vocabulary(PATH)), random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzABCéßñüΣσ'.,! \n0123456789́日 "
    texts = HARD + ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(400)]
    for s, ids in zip(texts, e.encode(texts), strict=True):
        want = t.encode(s, add_special_tokens=False).ids
        assert ids.tolist() == want, s
        assert e.decode(ids) == t.decode(want, skip_special_tokens=False), s


def test_long_words_and_texts(monkeypatch):
    """A heap merges long words, and long texts are cut at white space: the ids stay the library's."""
    import time

    from sparkloom.llm import bpe

    t, v, rng = Tokenizer.from_file(PATH), Vocabulary(PATH), random.Random(9)
    letters = "etaoinshrdlucmfwypvbgkjqxzé日"
    words = ["".join(rng.choices(letters, k=n)) for n in (1, 2, 3, 50, bpe.LONG - 1, bpe.LONG, bpe.LONG + 1, 3000, 20_000)] + ["a" * 5001, "ab" * 3000, "the" * 2000, "!?" * 700]
    e = Encoder(v)
    for w in words:
        assert e.encode([w])[0].tolist() == t.encode(w, add_special_tokens=False).ids
    assert not any(len(w.encode()) > bpe.LONG for w in e.cache if isinstance(w, str))
    monkeypatch.setattr(bpe, "LONG", 0)
    assert Encoder(v).encode(words[:-5])[3].tolist() == t.encode(words[3], add_special_tokens=False).ids  # every word by the heap
    monkeypatch.undo()
    monkeypatch.setattr(bpe, "PIECE", 300)
    text = " ".join(words[:8] * 3) + " <|endoftext|> é\u0301 \n" + "x" * 1000
    assert e.encode(["short", text, ""])[1].tolist() == t.encode(text, add_special_tokens=False).ids
    monkeypatch.undo()
    began = time.process_time()
    assert len(e.encode(["".join(rng.choices(letters[:26], k=300_000))])[0])
    assert time.process_time() - began < 15


def test_frame(spark):
    df = spark.createDataFrame([(1, "Hi there", 5, "z"), (2, None, 6, "y"), (2, None, 6, "y"), (None, "", 7, None)], "doc_id long, text string, n_tokens int, ids string")
    rows = encode(df, PATH).collect()
    assert sorted(r.n_tokens for r in rows) == [0, 0, 0, 2] and [r.decoded for r in rows if r.n_tokens] == ["hi</w> there</w>"]
    assert encode(df.limit(0), PATH).count() == 0
