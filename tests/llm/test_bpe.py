import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe
from tessera.llm.common import table

P = bpe.Params(bpe.default_path())
ODD = [
    None, "", " \t\n", "Hello, World's it'LL 42 ½ x²", "a<|endoftext|>B <|startoftext|>", "<|end", "ΣΑΣ Σ. İI ıi", "é ́e é́ ﬁ Å Å K", "x\x1cy\x1fz\x85q\xa0r s​t",
    "日本語 テスト 👍🏽 مرحبا", "DON'T don''t 's's", "ß ẞ Ǆ ǅ Ñ ñ ſ ŉ", "ͅa İx", "w" * 30_000, "ab " * 20_000, "\x00\x01 \x7f",
]


def want(text):
    e = bpe.load(P.tokenizer)
    ids = e.encode(text or "", add_special_tokens=False).ids
    back = e.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


@pytest.mark.parametrize("head", [0, 60, 1 << 19])
def test_against_the_library(spark, sf_dir, head):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    got = {r.doc_id: tuple(r)[1:] for r in bpe.op6_bpe(docs, bpe.Params(P.tokenizer, head)).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.doc_id] == want(r.text), r.text[:60] if r.text else r.text


def test_pieces_encode_like_the_text():
    t, rng = bpe.load(P.tokenizer), random.Random(3)
    letters = "aZ9 '.,sTé́ÀŒ\xa0\x85\x1c­½²ªµİıſŸſ<|>\n-日"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 12)))
        pieces = bpe.split_pieces(text)
        ids = [i for e in t.encode_batch(pieces, add_special_tokens=False) for i in e.ids]
        assert ids == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_every_plain_character():
    t = bpe.load(P.tokenizer)
    for c in map(chr, range(0x180)):
        for text in (c, f"a{c}b", f"{c}{c}1", f"'{c}", f"{c}'S"):
            ids = [i for e in t.encode_batch(bpe.split_pieces(text), add_special_tokens=False) for i in e.ids]
            assert ids == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_repeated_and_empty_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "c"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit("clash"), "head": F.lit(0), "extra": F.lit(1)})
    got = sorted(((r.doc_id, r.n_tokens) for r in bpe.op6_bpe(docs).collect()), key=str)
    assert got == [(1, 2), (1, 2), (2, 0), (None, 1)]
    assert bpe.op6_bpe(docs.limit(0)).count() == 0


def test_ids_decode(spark):
    docs = spark.createDataFrame([(1, "Some words, again"), (2, None)], "doc_id long, text string")
    ids = bpe.token_ids(docs, P)
    back = {r.doc_id: r.text for r in bpe.decoded_texts(ids, P).collect()}
    e = bpe.load(P.tokenizer)
    assert back == {1: e.decode(e.encode("Some words, again", add_special_tokens=False).ids, skip_special_tokens=False), 2: ""}


def test_packed_numbers_come_back():
    rng = np.random.default_rng(0)
    for n in (np.zeros(0, int), np.array([0, 127, 128, 16383, 16384, (1 << 21) - 1]), rng.integers(0, 1 << 18, 5000)):
        assert bpe.unpack(bpe.pack(n)).tolist() == n.tolist()


def test_words_of_stretches(monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(bpe, "_STRETCH", 16)
    texts = ["".join(rng.choice("ab \n\té") for _ in range(rng.randint(0, 60))).encode() for _ in range(200)] + [b"x" * 100]
    words, code, counts = bpe.distinct_words(texts)
    assert [words[i] for i in code] == [w for t in texts for w in t.split()]
    assert counts.tolist() == [len(t.split()) for t in texts] and len(set(words)) == len(words)
