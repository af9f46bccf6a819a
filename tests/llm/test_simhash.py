import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.common import table


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows, radius=4):
    fps = sorted({f for _, f in rows})
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                up[find(a)] = find(b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(least.get(find(f), d), d)
    return sorted(((d, f, least.get(find(f))) for d, f in rows), key=str)


def test_fingerprint_against_bits():
    for text in ["", " \t", "One", "a b c", "a b c d", "The Cat sat on the mat " * 9, "\x1cx  y é À z w v"]:
        assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


@pytest.mark.parametrize("block", [3, 2048])
def test_links_connect_what_close_codes_connect(spark, block):
    rng = np.random.default_rng(5)
    codes = {0}
    for _ in range(12):
        centre = int(rng.integers(0, 1 << 63)) * 2 + 1
        for _ in range(25):
            c = centre
            for b in rng.integers(0, 64, int(rng.integers(0, 6))):
                c ^= 1 << int(b)
            codes.add(c)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    got = simhash.near_links(spark.createDataFrame([(c,) for c in signed], "fp long"), 4, 2, block).collect()
    rows = [(i, c) for i, c in enumerate(sorted(codes))]
    up = dict.fromkeys(codes)
    up = {c: c for c in codes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in got:
        a, b = a % (1 << 64), b % (1 << 64)
        up[find(a)] = find(b)
    want = {}
    for d, f, c in slow_components(rows):
        want.setdefault(c, set()).add(f)
    have = {}
    for c in codes:
        have.setdefault(find(c), set()).add(c)
    assert {frozenset(x) for x in want.values()} == {frozenset(x) for x in have.values()}


def test_query_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = sorted(((r[0], int(r[1], 16), r[2]) for r in simhash.op5_near_duplicates(docs).collect()), key=str)
    assert got == slow_components([(r[0], slow_fingerprint(r[1])) for r in docs.select("doc_id", "text").collect()])


def test_edge_rows(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, None), (3, ""), (None, "A B C D E"), (None, None), (4, "x" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("root", F.lit(1))
    got = sorted(map(tuple, simhash.op5_near_duplicates(docs).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (None, 1), (2, 2), (3, 2), (None, 2), (4, 4)], key=str)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r[0], r[1]) for r in kept.collect() if r[1]) == [(1, "a b c d e"), (4, "x" * 100_000)]
    assert kept.count() == 3
    assert simhash.op5_near_duplicates(docs.limit(0)).count() == 0
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_long_chain_is_one_component(spark):
    from tessera.llm.components import component_labels

    links = spark.range(300).selectExpr("id as a", "id + 1 as b")
    assert component_labels(links, "t").select("root").distinct().count() == 1


def slow_kept(rows):
    """The least id of each component of texts whose five-word shingles have Jaccard similarity 0.8, over all pairs."""
    sets = {}
    for d, t in rows:
        words = (t or "").encode().lower().split()
        sets[d] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) - 1e-6:
                both = len(x & y)
                if x == y or both / (len(x) + len(y) - both) >= 0.8:
                    p, q = sorted((find(a), find(b)))
                    up[q] = p
    return {find(d) for d in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_keep_one_against_brute_force_jaccard(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for base in range(25):
        words = [f"w{x}" for x in rng.integers(0, 2000, int(rng.integers(5, 120)))] + (["the", "licence", "applies", "to", "all"] * 3 if base % 3 == 0 else [])
        for _ in range(8):
            copy = list(words)
            for at in rng.integers(0, len(copy), int(rng.integers(0, 5))):
                copy[at] = f"x{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(copy)))
    want = slow_kept(rows)
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r.doc_id for r in kept.collect()} == want


def test_keep_one_on_the_given_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == slow_kept([(r.doc_id, r.text) for r in docs.collect()])
