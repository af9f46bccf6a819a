"""The vector index against all pairs: whatever it rules out, nothing is lost."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import similarity as M
from tessera.operators.vector_index import Index, Params, Ring, best_scores, pack_rings

SMALL = Params(block=40, query_block=64, sample=64)


def table(spark, m, tags):
    return spark.createDataFrame([(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(m, tags, strict=True))], "node_id long, embedding array<double>, tag long")


@pytest.fixture(scope="module")
def vectors():
    """Thirty tight clusters, one of which holds a third of all rows, some exact copies and some zero vectors."""
    r = np.random.default_rng(5)
    centre = r.normal(size=(30, 12))
    at = np.where(r.random(900) < 0.34, 0, r.integers(0, 30, 900))
    m = centre[at] + 0.05 * r.normal(size=(900, 12))
    m[100:140] = m[99]
    m[::97] = 0
    return m, r.integers(0, 4, 900)


def all_scores(m):
    n = np.linalg.norm(m, axis=1, keepdims=True)
    u = np.divide(m, n, out=np.zeros_like(m), where=n > 0)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -2)
    return s


def wanted(s, k, least):
    out = set()
    for q, row in enumerate(s):
        for v in [v for v in np.lexsort((np.arange(len(row)), -row)) if row[v] >= max(least, -1.5)][:k]:
            out.add((q, int(v), float(row[v])))
    return out


@pytest.mark.parametrize("least", [-1.0, 0.9])
def test_k_nearest(spark, vectors, least):
    m, tags = vectors
    v = table(spark, m, tags)
    got = {(r.query_id, r.node_id, r.score) for r in M.nearest(v, v, 5, least, p=SMALL).collect()}
    want = wanted(all_scores(m), 5, least)
    assert len(got) == len(want) and {x[:2] for x in got} == {x[:2] for x in want}
    s = all_scores(m)
    s[tags[:, None] == tags[None]] = -2
    got = {(r.query_id, r.node_id) for r in M.nearest(v, v, 5, least, "tag", SMALL).collect()}
    assert got == {x[:2] for x in wanted(s, 5, least)}


def test_all_within_and_what_is_skipped(spark, vectors):
    m, tags = vectors
    v, s = table(spark, m, tags), all_scores(m)
    got = {(r.query_id, r.node_id) for r in M.nearest(v, v, None, 0.8, p=SMALL).collect()}
    assert got == {x[:2] for x in wanted(s, None, 0.8)}
    asked, index = M._sides(v, v, None, SMALL)
    index.search(asked, M._best(None, 0.8, False), "query_id long, node_id long, score double", 0.8, None).count()
    seen, pairs = index.pairs
    assert index.n_blocks >= 20 and seen < pairs / 2
    index.search(asked, M._best(5, -1.0, False), "query_id long, node_id long, score double", -1.0, 5).count()
    assert index.pairs[0] < index.pairs[1] * 0.75
    assert index.blocks.groupBy("j").count().agg(F.max("count")).first()[0] <= 3 * SMALL.block  # a hot cell is split


def test_tags_and_top_pairs(spark, vectors):
    m, tags = vectors
    v, s = table(spark, m, tags), all_scores(m)
    got = M.tags_within(v, v, 0.8, "tag", SMALL).collect()
    assert len(got) == len(set(got)) and {(r.query_id, r.tag) for r in got} == {(q, int(tags[n])) for q, n in zip(*np.nonzero(s >= 0.8), strict=True)}
    top = [(r.a, r.b, r.score) for r in M.overlapping_pairs(v, 0.8, 30, SMALL).collect()]
    a, b = np.nonzero(np.triu(s, 1) >= 0.8)
    order = np.lexsort((b, a, -s[a, b]))[:30]
    assert [x[2] for x in top] == [float(x) for x in s[a, b][order]]
    assert [x[:2] for x in top] == list(zip(a[order].tolist(), b[order].tolist(), strict=True))


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0], None), (2, [1.0, None], 5), (3, [float("nan"), 0.0], 6), (4, None, 7), (None, [1.0, 1.0], 8), (5, [2.0, 0.0], 5)]
    v = spark.createDataFrame(rows, "node_id long, embedding array<double>, tag long").withColumn("id", F.lit("clash")).withColumn("i", F.lit(0))
    got = sorted((r.query_id, r.node_id, r.score) for r in M.nearest(v, v, None, 0.5).collect())
    assert got == [(a, b, 1.0) for a in (1, 2, 5) for b in (1, 2, 5) if a != b]
    assert sorted((r.query_id, r.tag) for r in M.tags_within(v, v, 0.5, "tag").collect()) == [(1, 5), (2, 5), (5, 5)]
    empty = v.limit(0)
    for a, b in ((empty, v), (v, empty), (empty, empty)):
        assert M.nearest(a, b, 3).count() == 0 and M.nearest(a, b, None).count() == 0 and M.tags_within(a, b, 0.5, "tag").count() == 0
    uneven = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "node_id long, embedding array<double>")
    with pytest.raises(Exception, match="unequal length"):
        M.nearest(uneven, uneven, 1).count()


def test_bounds_and_rings():
    r = np.random.default_rng(1)
    m, c, q = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (r.normal(size=(n, 5)) for n in (200, 3, 50)))
    theta, mine = np.arccos(q @ c.T), np.arccos(m @ c.T)
    near = mine.argmin(1)
    rings = [Ring(k, mine[near == k, k].min(), mine[near == k, k].max(), 0, 1) for k in range(3)]
    bound = best_scores(theta, np.zeros(50, bool), rings)
    for k in range(3):
        assert (bound[:, k] >= (q @ m[near == k].T).max(1) - 1e-9).all()
    rings, where = pack_rings([(0, 2, 100, 0.2, 0.3), (0, 1, 4, 0.1, 0.15), (1, 0, 3, 0.0, 0.1), (0, 3, 4, 0.31, 0.32)], 40)
    assert where == [(0, 1, 0), (0, 2, 0), (0, 3, 1), (1, 0, 2)] and rings[0] == Ring(0, 0.1, 0.3, 0, 3) and [x.first for x in rings] == [0, 3, 4]
