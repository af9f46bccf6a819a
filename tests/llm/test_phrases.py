"""Collocations against counts of every phrase."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import phrases
from tessera.llm.common import table

from .oracle import same

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_query_against_sql(spark):
    sf_dir = "/root/testdata/sf0.01"  # the least one with phrases that occur 100 times
    same(phrases.op12_collocations(table(spark, sf_dir, "documents")), sf_dir, phrases.OP12_SQL)


def brute(rows, least, top):
    out = []
    for lang in {r[0] or "und" for r in rows}:
        f, n = Counter(), 0
        for _, text in (r for r in rows if (r[0] or "und") == lang):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
            for piece in re.split("[.,;:!?\x0a-\x0d]", low):
                w = [x for x in re.split("[\x20\x09]+", piece) if x]
                n += len(w)
                f.update(tuple(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
        good = {q: a for q, a in f.items() if len(q) > 1 and a >= least}
        inside = {q[i:j] for q, a in good.items() for i in range(len(q)) for j in range(i + 1, len(q) + 1) if j - i < len(q) and f[q[i:j]] == a}
        made = []
        for q, a in good.items():
            if q not in inside:
                score, k = min((1000 * a * n // (f[q[:k]] * f[q[k:]]), k) for k in range(1, len(q)))
                made.append((-score, -a, " ".join(q).encode(), f[q[:k]], f[q[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(made)[:top])]
    return sorted(out)


def texts(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["É", "Word", "\x1f", "x\x00y"]
    weights = [1 / (i + 1) for i in range(len(words))]
    fixed = ["Deep blue Sea water now", "red red red", "deep blue sea", "one two"]
    rows = []
    for i in range(160):
        parts = [" ".join(rng.choices(words, weights, k=rng.randrange(12))) if rng.random() < 0.7 else rng.choice(fixed) for _ in range(rng.randrange(6))]
        rows.append((rng.choice(["en", "en", "fr", None, "und"]), rng.choice([" ", "\t ", ", ", "\n", ""]).join(parts)))
    return rows


@pytest.mark.parametrize(("seed", "least", "top", "growth"), [(1, 4, 5, 2), (2, 3, 40, 3), (3, 5, 100000, 16)])
def test_against_brute_force(spark, seed, least, top, growth):
    rows = texts(seed)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    got = sorted(tuple(r[c] for c in COLUMNS) for r in phrases.collocations(docs, least, top, growth).collect())
    assert got == brute(rows, least, top)


def test_only_words_within_the_bound_are_grown(spark, monkeypatch):
    """Rare pairs score above what common words can reach: these are never expanded."""
    rows = [("en", " ".join(f"rare{i} pair{i}" for i in range(20)) + ". the of. of the. the the")] * 5 + [("en", "the " * 500)] * 5
    chosen = []
    real = phrases.grown
    monkeypatch.setattr(phrases, "grown", lambda coded, often, words, least: chosen.append(words.count()) or real(coded, often, words, least))
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = sorted(tuple(r[c] for c in COLUMNS) for r in phrases.collocations(docs, 5, 20, 2).collect())
    assert got == brute(rows, 5, 20)
    assert sum(chosen) <= 41  # the rare words and 'of', not 'the'


def test_odd_rows(spark):
    rows = [(None, None), ("en", ""), ("en", "!!! ... \t \n"), ("en", "a b " * 400_000), ("fr", "z" * 3_000_000), ("de", "one, two. " * 300_000), (None, "x y"), ("und", "x y")] + [("en", "a b c")] * 3
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({"word": F.lit(1), "n": F.lit("x")})
    assert sorted(tuple(r[c] for c in COLUMNS) for r in phrases.collocations(docs, 2, 10).collect()) == brute(rows, 2, 10)
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_words_that_share_a_hash_are_told(monkeypatch):
    """Words of one hash come as rows of one hash with different words: what the choice of a seed looks for."""
    real = phrases.xxhash.xxh64_intdigest

    class Shared:
        @staticmethod
        def xxh64_intdigest(word, seed=0):
            return 7 if word in (b"a", b"b") else real(word, seed)

    monkeypatch.setattr(phrases, "xxhash", Shared)
    enc = phrases.Encoder(42)
    enc.codes(b"a b c")
    rows = enc.rows("en").to_pydict()
    assert rows["word"] == ["a", "b", "c"] and rows["h"][0] == rows["h"][1] == 7 != rows["h"][2]


def test_what_a_task_holds_is_of_all_languages():
    import pyarrow as pa

    from tessera.llm.phrases import encoded

    texts = [" ".join(f"{lang}{i}" for i in range(8)) for lang in "abcd"]
    batches = [pa.RecordBatch.from_pydict({"lang": [lang], "text": [text]}) for lang, text in zip("abcd", texts, strict=True)]
    out = [b.column("word")[0].is_valid for b in encoded(42, most_words=20)(iter(batches))]
    assert True in out[: len(out) - 1 - out[::-1].index(False)]  # words are handed on before the last text
