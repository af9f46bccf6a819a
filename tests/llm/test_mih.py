import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import mih
from tessera.llm.common import table

from .oracle import same


def test_query_against_sql(spark, sf_dir):
    same(mih.op7_hamming_topk(table(spark, sf_dir, "embeddings")), sf_dir, mih.OP7_SQL)


@pytest.mark.parametrize(("code_block", "query_block", "segments"), [(50, 7, 4), (1 << 17, 512, 3)])
def test_against_brute_force(spark, code_block, query_block, segments):
    rng = np.random.default_rng(1)
    base = rng.integers(-(1 << 63), (1 << 63) - 1, 40, dtype=np.int64)
    codes = [int(c ^ (np.int64(1) << np.int64(b))) for c in base for b in rng.integers(0, 63, 6)] + [7] * 30
    rows = list(enumerate(codes))
    queries = [(i, c) for i, c in rows if i % 20 == 0] + [(-1, 7), (-2, -1)]
    got = {}
    for r in mih.nearest(spark.createDataFrame(rows, "id long, code long"), spark.createDataFrame(queries, "query_id long, code long"), 5, segments, code_block, query_block).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.distance, r.id))
    for q, c in queries:
        want = sorted(((x ^ c) & (1 << 64) - 1).bit_count() * 1000 + i for i, x in rows)[:5]
        assert [d * 1000 + i for _, d, i in sorted(got[q])] == want


def test_edge_rows(spark):
    rows = [(0, [1.0, -1.0]), (1, None), (None, [1.0, -1.0]), (20, [float("nan"), 2.0]), (20, [float("nan"), 2.0]), (40, [])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"code": F.lit("clash"), "rank": F.lit(1)})
    got = {}
    for r in mih.op7_hamming_topk(e).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.distance, r.vec_id))
    assert sorted(got[0]) == [(1, 0, 0), (2, 0, None), (3, 1, 40), (4, 2, 20), (5, 2, 20)]
    assert len(got[20]) == 10 and set(got) == {0, 20, 40}
    assert mih.op7_hamming_topk(e.limit(0)).count() == 0
