"""Invariants of the operators on small frames."""

import itertools

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators import lifecycle as L
from tessera.operators import scans as S
from tessera.operators import similarity as M
from tessera.operators import windows as W
from tessera.operators.vector_index import Params


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_support_raises_and_contradiction_lowers(spark):
    prior = frame(spark, [(1, 0.9), (2, 0.5), (3, 0.5)], "id long, credibility double")
    e = frame(spark, [(1, 2, "SUPPORTS", 1.0), (1, 3, "CONTRADICTS", 1.0)], "src long, dst long, edge_type string, weight double")
    got = {r.id: r.confidence for r in G.propagate_confidence(prior, e).collect()}
    assert got[1] == 0.9 and got[2] > 0.5 > got[3]


def test_pagerank_keeps_its_mass(spark):
    e = frame(spark, [(1, 2, 1.0), (2, 3, 2.0), (2, 1, 1.0), (3, 4, 1.0)], "src long, dst long, weight double")
    rank = G.personalized_pagerank(e, frame(spark, [(1, 1.0)], "id long, weight double")).collect()
    assert sum(r["rank"] for r in rank) == pytest.approx(1.0)


def test_heat_takes_the_best_source_and_respects_depth(spark):
    heat = frame(spark, [(1, 1.0), (9, 0.6)], "id long, heat double")
    e = frame(spark, [(i, i + 1, "SUPPORTS", 1.0) for i in range(1, 6)] + [(9, 2, "SUPPORTS", 1.0)], "src long, dst long, edge_type string, edge_heat double")
    got = {r.id: r.heat for r in G.diffuse_heat(heat, e).collect()}
    assert got[2] == pytest.approx(0.63) and set(got) == {2, 3, 4}


def test_shortest_path(spark):
    e = frame(spark, [(1, 2), (2, 3), (3, 4), (1, 5), (5, 4)], "src long, dst long")
    assert [r.node_id for r in G.shortest_path(e, 1, 4).orderBy("place").collect()] == [1, 5, 4]
    assert G.shortest_path(e, 1, 77).count() == 0


def test_domination_does_not_depend_on_row_order(spark):
    rank = frame(spark, [(i, i) for i in range(6)], "node_id long, place int")
    pairs = [(0, 1), (1, 2), (2, 3), (4, 5)]
    for order in itertools.islice(itertools.permutations(pairs), 0, 24, 8):
        got = L.dominated(frame(spark, list(order), "a long, b long"), rank).collect()
        assert {r.node_id for r in got} == {1, 3, 5}


def test_greedy_sentences_fit_their_budget(spark):
    text = " ".join(f"Sentence number {i} was found in /tmp/a{i}.txt because of it." for i in range(40))
    (row,) = W.key_sentences(frame(spark, [(1, text)], "node_id long, content string"), 200).collect()
    assert 0 < len(row.summary) <= 200
    parts = row.summary.split(". ")
    assert [text.index(p) for p in parts] == sorted(text.index(p) for p in parts)


def test_blocks_do_not_change_neighbours(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    v = frame(spark, [(i, [float(x) for x in rng.normal(size=5)]) for i in range(60)], "node_id long, embedding array<float>")
    a = M.nearest(v, v, 4, p=Params(block=7)).orderBy("query_id", "rank").collect()
    assert a == M.nearest(v, v, 4).orderBy("query_id", "rank").collect()


def test_export_and_import_of_one_tenant(spark, tmp_path):
    df = frame(spark, [(1, "a"), (2, "b"), (3, "a")], "id long, silo_id string")
    S.silo_export({"nodes": df, "edges": df.where("id = 1")}, f"{tmp_path}/x")
    back = S.silo_import(spark, f"{tmp_path}/x", "a")
    assert (back["nodes"].count(), back["edges"].count()) == (2, 1)
    df.limit(1).write.mode("overwrite").partitionBy("silo_id").parquet(f"{tmp_path}/x/nodes")
    with pytest.raises(ValueError, match="nodes"):
        S.silo_import(spark, f"{tmp_path}/x")


def test_findings_history(spark):
    old = frame(spark, [("a", 1, 1), ("b", 2, 4), ("d", 5, 2)], "k string, body long, version long")
    new = frame(spark, [("b", 3, 10), ("c", 9, 11), ("d", 6, 12)], "k string, body long, finding long")
    cites = frame(spark, [(10, 1), (10, 2), (11, 1), (12, 3)], "finding long, node_id long")
    nodes = frame(spark, [(1,), (2,)], "node_id long")
    now, history = L.upsert_findings(old, new, ["k"], cites, cites, nodes)
    assert {(r.k, r.body, r.version, r.n_claims) for r in now.collect()} == {("a", 1, 1, None), ("b", 3, 5, 2), ("c", 9, 1, 1), ("d", 5, 2, None)}
    assert [(r.k, r.version) for r in history.collect()] == [("b", 4)]


def test_chains_with_absent_predecessors_and_circles(spark):
    schema = "node_id long, supersedes_id long"
    got = G.version_roots(frame(spark, [(2, 1), (3, 2), (7, None)], schema)).collect()
    assert {tuple(r) for r in got} == {(2, 2, 0), (3, 2, 1), (7, 7, 0)}
    with pytest.raises(ValueError, match="circle"):
        G.version_roots(frame(spark, [(1, 3), (2, 1), (3, 2)], schema))


def test_vectors_of_unequal_length_are_an_error(spark):
    v = frame(spark, [(1, [1.0, 0.0]), (2, [1.0]), (3, [1.0, 1.0, 1.0])], "node_id long, embedding array<float>")
    with pytest.raises(Exception, match="unequal length"):
        M.nearest(v, v, 1).collect()


def test_warping_by_hand(spark):
    rows = [(1, [[0.0], [3.0]], [[0.0], [0.0], [3.0]]), (2, [[0.0]], [[3.0], [4.0]]), (3, [], [[1.0]]), (4, None, None)]
    got = M.dtw_similarity(frame(spark, rows, "id long, a array<array<double>>, b array<array<double>>")).collect()
    assert {r.id: r.similarity for r in got} == pytest.approx({1: 1.0, 2: 1 / 6, 3: 0.0, 4: 0.0})


def test_forgetting_can_be_taken_back_in_time_only(spark):
    n = frame(spark, [(1, "ACTIVE"), (2, "SUPERSEDED"), (3, "ACTIVE")], "node_id long, state string")
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    n = L.forget(n, frame(spark, [(1,), (2,)], "node_id long"), at("2024-01-01 12:00:00"))
    n = L.cancel_forget(n, frame(spark, [(2,)], "node_id long"), at("2024-01-01 12:59:00"))
    n = L.cancel_forget(n, frame(spark, [(1,)], "node_id long"), at("2024-01-01 13:00:00"))
    assert {(r.node_id, r.state) for r in n.collect()} == {(1, "TOMBSTONED"), (2, "SUPERSEDED"), (3, "ACTIVE")}
    e = frame(spark, [(1, 3), (2, 3)], "src long, dst long")
    nodes, edges = L.hard_delete(n, e, at("2024-01-01 13:00:00"))
    assert {r.node_id for r in nodes.collect()} == {2, 3} and [tuple(r) for r in edges.collect()] == [(2, 3)]


def test_text_ratio_is_the_library_ratio(spark):
    (r,) = M.text_ratio(frame(spark, [(1, "Abcd", "bcde")], "id long, a string, b string")).collect()
    assert r.ratio == pytest.approx(0.75)


def test_empty_inputs(spark):
    e = frame(spark, [], "src long, dst long, edge_type string, weight double")
    seeds = frame(spark, [], "id long")
    assert G.neighborhood(e, seeds, 3).count() == 0
    assert G.label_propagation(e).count() == 0
    assert L.dominated(frame(spark, [], "a long, b long"), frame(spark, [], "node_id long, place int")).count() == 0
    assert M.nearest(frame(spark, [], "node_id long, embedding array<float>"), frame(spark, [], "node_id long, embedding array<float>"), 3).count() == 0
    assert e.agg(F.count("*")).first()[0] == 0


def test_blocks_of_a_broadcast_hold_every_row_once(spark):
    rows = [r.id for block in S.in_blocks(spark.range(57), "id", 10) for r in block.collect()]
    assert sorted(rows) == list(range(57))
