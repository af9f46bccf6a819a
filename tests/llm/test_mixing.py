import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing, registry
from tessera.llm.common import table

from .oracle import same


def test_query_against_sql(spark, sf_dir):
    same(mixing.op3_source_mix(table(spark, sf_dir, "documents")), sf_dir, mixing.OP3_SQL)


def test_targets_share_the_excess(spark):
    rows = [("a", 10), ("b", 1000), ("c", 5), (None, 300), ("d", 0)]
    got = {r.source: r for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    total = sum(s for _, s in rows)
    assert sum(r.target for r in got.values()) == pytest.approx(total)
    assert all(r.target <= 3 * r.source_size for r in got.values())
    assert got["a"].target == 30 and got["c"].target == 15 and got["d"].target == 0
    assert got[None].rank == 4 and got["b"].target == pytest.approx(got[None].target)


@pytest.mark.parametrize("per_bucket", [3, 20_000])
def test_buckets_do_not_change_the_start(spark, per_bucket):
    sized = spark.range(200).selectExpr("id as doc_id", "if(id % 3 = 0, 's', 't') as source", "id % 7 + 1 as size")
    rows = mixing.placed(sized, per_bucket).collect()
    for s in "st":
        spans = sorted((r.start, r.start + r.size) for r in rows if r.source == s)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_positions_invert_the_demand(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('s', id % 3) as source", "repeat('w ', 10) as text")
    rows = mixing.mixed_positions(docs).collect()
    for i, phases in enumerate(mixing.PHASES):
        at = [r.position for r in rows if r.source == f"s{i}"]
        for k, rate in enumerate(phases):
            assert sum(k / 4 <= p < (k + 1) / 4 for p in at) / len(at) == pytest.approx(rate / 4, abs=0.01)


def test_edge_rows(spark):
    rows = [(1, "a b", "s"), (1, "a b", "s"), (2, None, "s"), (3, "", None), (None, "c d e", None), (4, "w " * 50_000, "t"), (5, "x", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("start", F.lit(1))
    got = mixing.op3_source_mix(docs).collect()
    assert sorted((r.doc_id or 0, r.size) for r in got) == [(0, 3), (1, 2), (1, 2), (2, 0), (3, 0), (4, 50_000), (5, 1)]
    assert all(r.taken <= 3 * r.size for r in got)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    mixed.collect()
    assert mixing.op3_source_mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_takes_near_the_target(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    taken = mixing.op3_source_mix(docs).groupBy("target", "source_size").agg(F.sum("taken").alias("t"), F.max("size").alias("m")).collect()
    assert all(abs(r.t - r.target) <= r.m for r in taken)
    words = mixing.sizes(mixing.mix(docs)).agg(F.sum("size")).first()[0]
    assert words == mixing.op3_source_mix(docs).agg(F.sum("taken")).first()[0]


def test_queries_follow_the_curriculum(spark, tmp_path):
    """Both queries against an own walk over the schedule: words in hashed order, weights integrated in small steps."""
    texts = [(i, "w " * (1 + i % 5), f"s{i % 3}") for i in range(240)] + [(900, None, "s0")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    sized = {i: len((t or "").split()) for i, t, _ in texts}
    target = {r.source: r.target for r in mixing.source_targets(mixing.sizes(docs).select("source", "size")).collect()}
    want = {}
    for k, s in enumerate(sorted(target)):
        ids = sorted((i for i, _, x in texts if x == s), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
        start = 0
        for n in range(mixing.MAX_PASSES):
            for i in ids:
                middle, start = start + sized[i] / 2, start + sized[i]
                if sized[i] and middle < target[s]:
                    time = reached = 0.0
                    for phase in range(4):
                        rate = mixing.PHASES[k][phase] * target[s]
                        if middle <= reached + rate / 4:
                            time = phase / 4 + (middle - reached) / rate
                            break
                        reached += rate / 4
                    want[i, n] = time
    got = registry.queries()["op3_mix_positions"]
    path = str(tmp_path)
    docs.write.parquet(f"{path}/documents.parquet")
    rows = got(spark, path).collect()
    assert {(r.doc_id, r["pass"]): r.position for r in rows} == pytest.approx(want) and len(rows) == len(want)
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    per = registry.queries()["op3_source_mix"](spark, path).collect()
    first = [want.get((r.doc_id, 0), 2.0) for r in per]
    assert first == sorted(first) and first[-1] == 2.0
    assert {r.doc_id: r.taken for r in per} == {i: n * sum((i, p) in want for p in range(3)) for i, n in sized.items()}
