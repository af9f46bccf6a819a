"""Curves against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hilbert
from tessera.llm.common import table


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_neighbours_on_the_curve_are_neighbours_in_space(dims, bits):
    grid = np.stack(np.meshgrid(*[range(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    key = hilbert.hilbert_key(grid, bits)
    assert sorted(key.tolist()) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


def brute(x, ids, queries, k):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(1))
        out[q] = sorted((float(v), i) for v, i in zip(d, ids, strict=True) if i != q)[:k]
    return out


def by_query(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r["id"] if "id" in df.columns else r.vec_id))
    return {q: sorted(v) for q, v in got.items()}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_query(spark, sf):
    e = table(spark, f"/root/testdata/{sf}", "embeddings")
    rows = e.orderBy("vec_id").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64)
    got = by_query(hilbert.op11_hilbert_neighbours(e))
    want = brute(x, ids, [i for i in ids if i % 100 == 0], 10)
    assert got.keys() == want.keys() and all([r for r, _, _ in v] == list(range(1, 11)) for v in got.values())
    assert np.mean([len({i for *_, i in got[q]} & {i for _, i in want[q]}) / 10 for q in want]) >= 0.9
    for q, found in got.items():
        true = np.sqrt(((x[[ids.index(i) for *_, i in found]] - x[ids.index(q)]) ** 2).sum(1))
        assert np.allclose([s for _, s, _ in found], true, rtol=1e-14, atol=0) and list(found) == sorted(found)


def test_clusters_need_narrow_windows(spark):
    """The window is measured: on 200 tight clusters it is a small share of the rows, and recall holds."""
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(200, 1, 16)) * 3 + rng.normal(size=(200, 15, 16)) * 0.05).reshape(-1, 16)
    ids = list(range(len(x)))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    queries = rows.where("id % 7 = 0").select(F.col("id").alias("query_id"))
    seen = []
    real = hilbert.measured_window
    hilbert.measured_window = lambda *a: seen.append(real(*a)) or seen[-1]
    try:
        got = by_query(hilbert.nearest(rows, queries, curves=8))
    finally:
        hilbert.measured_window = real
    want = brute(x, ids, [i for i in ids if i % 7 == 0], 10)
    assert np.mean([len({i for *_, i in got[q]} & {i for _, i in want[q]}) / 10 for q in want]) >= 0.95
    assert seen[0] < 0.05 * len(x)


def test_copies_and_ties(spark):
    """Of a vector with hundreds of copies the smallest ids come first; equal distances by id."""
    rows = [(i, [1.0, 0.0]) for i in range(300)] + [(1000 + i, [0.0, 1.0 + 0.0 * i]) for i in range(4)] + [(2000, [0.5, 0.5]), (2001, [-0.5, 0.5])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = by_query(hilbert.nearest(df, spark.createDataFrame([(250,), (3,), (2000,)], "query_id long"), most_rows=64))
    assert got[250] == [(i + 1, 0.0, i) for i in range(10)]
    assert got[3] == [(r + 1, 0.0, i) for r, i in enumerate([0, 1, 2, 4, 5, 6, 7, 8, 9, 10])]
    assert [i for *_, i in got[2000]] == list(range(10))  # (1, 0) is as far as (0, 1), with smaller ids


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (200, None), (300, [0.0, 0.0]), (400, [nan, 1.0]), (500, [inf, 1.0]), (600, [None, 1.0]), (700, []), (None, [1.0, 1.0]), (1, [1.0, -0.0]), (2, [2.0]), (2, [2.0]), (3, [1.0, 0.0, 3.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"rank": F.lit("x"), "score": F.lit(1), "rep": F.lit(2), "h": F.lit(3)})
    got = by_query(hilbert.op11_hilbert_neighbours(e))
    assert got.keys() == {0, 100}
    assert got[0] == [(1, 0.0, 1), (2, 1.0, 2), (3, float(np.sqrt(2.0)), 100), (4, 3.0, 3)]
    assert [i for *_, i in got[100]] == [0, 1, 2, 3]
    assert hilbert.op11_hilbert_neighbours(e.limit(0)).count() == 0
    assert by_query(hilbert.op11_hilbert_neighbours(e.where("vec_id = 0"))) == {}
    assert hilbert.op11_hilbert_neighbours(e.where("vec_id = 3")).count() == 0
