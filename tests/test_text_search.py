"""Block search by words and trigrams against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval as R
from tessera.operators import text_search as TS


def grams(text):
    x = f"  {(text or '').lower()} "
    return {x[i : i + 3] for i in range(len(x) - 2)}


def words(text):
    return [w for w in re.split(r"[^a-z0-9]+", (text or "").lower()) if w]


def bm25(queries, nodes):
    tf = {i: Counter(words(t)) for i, t in nodes}
    length = {i: sum(c.values()) for i, c in tf.items() if c}
    n, mean = len(length), sum(length.values()) / max(1, len(length))
    df = Counter(w for c in tf.values() for w in c)
    out = {}
    for q, text in queries:
        for i in length:
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[i][w] * 2.2 / (tf[i][w] + 1.2 * (0.25 + 0.75 * length[i] / mean)) for w in set(words(text)) if tf[i][w])
            if s > 0:
                out.setdefault(q, {})[i] = s
    return out


def first(scores, k):
    return [i for _, i in sorted((-round(s, 6), i) for i, s in scores.items())[:k]]


def made(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    text = lambda m: " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(40)], k=rng.randrange(1, m)))
    nodes = [(i, text(30)) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "!?"), (n + 3, "zebra crossing"), (n + 4, "w1 " * 3000)]
    nodes += [(n + 10 + i, "the very same text w3") for i in range(15)]
    queries = [(i, text(12)) for i in range(12)] + [(100, "zebra crosing"), (101, None), (102, "the very same text w3"), (103, "nothing of it"), (104, "zebr cros")]
    return queries, nodes


@pytest.fixture(params=[(1, 40, 5), (2, 300, 10)])
def case(request, spark):
    seed, n, k = request.param
    queries, nodes = made(seed, n)
    return queries, nodes, k, spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(nodes, "node_id long, content string").withColumns({"words": F.lit("x"), "id": F.lit(1)}).repartition(3)


def ranked(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.node_id)
    return out


def test_word_search(case, monkeypatch):
    queries, nodes, k, qs, ns = case
    monkeypatch.setattr(TS, "NODE_BLOCK", 64)
    assert ranked(R.bm25(qs, ns, k)) == {q: first(s, k) for q, s in bm25(queries, nodes).items()}


def test_text_search(case, monkeypatch):
    queries, nodes, k, qs, ns = case
    monkeypatch.setattr(TS, "NODE_BLOCK", 64)
    lexical, want = bm25(queries, nodes), {}
    for q, text in queries:
        hit = lexical.get(q, {})
        best = max((round(s, 6) for s in hit.values()), default=0)
        for i, content in nodes:
            a, b = grams(text), grams(content)
            sim = len(a & b) / len(a | b)
            if i in hit or sim > 0.1:
                want.setdefault(q, {})[i] = (0.7 * round(hit[i], 6) / best if i in hit else 0) + 0.3 * sim
    assert ranked(R.text_channel(qs, ns, k)) == {q: first(s, k) for q, s in want.items()}


def test_no_nodes_or_queries(case):
    _, _, k, qs, ns = case
    for find in (R.bm25, R.text_channel, R.grep_channel):
        assert find(qs, ns.limit(0), k).count() == 0
        assert find(qs.limit(0), ns, k).count() == 0


def test_common_words_are_looked_up_for_few_nodes():
    """With a rare and a common word the search ends its additions at the rare one."""
    n = 5000
    rare, common = {"id": 1, "w": 9.0}, {"id": 2, "w": 0.5}
    rows = [[common, rare] if i < 20 else [common] for i in range(n)]
    lists = TS.Lists(pa.array(rows, pa.list_(pa.struct([("id", pa.int64()), ("w", pa.float64())]))))
    at, scores = lists.best([1, 2, 77], 5)
    assert set(at.tolist()) == set(range(20)) and np.allclose(scores, 9.5)


def test_prefix_filter_keeps_all_of_a_similarity():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 30))) for _ in range(300)]
    g = TS.Grams(pa.array([s.tolist() for s in sets], pa.list_(pa.int64())))
    for y in sets[:40]:
        for least in (0.1, 0.3, 0.5, 0.9, 1.0):
            near = {i for i, s in enumerate(sets) if len(np.intersect1d(s, y)) / len(np.union1d(s, y)) >= least}
            assert near <= set(g.sharing(y, least).tolist())
    s = g.similarity(np.arange(300), sets[0])
    assert np.allclose(s, [len(np.intersect1d(x, sets[0])) / len(np.union1d(x, sets[0])) for x in sets])
