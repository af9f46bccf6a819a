"""How many rows the steps of iterative operators write, which is what their time and disk grow with."""

import pytest

from tessera.operators import chains as C
from tessera.operators import graph as G


@pytest.fixture
def written(monkeypatch):
    """Tag and rows of each table that a step writes."""
    seen = []
    for module in (G, C):

        def spy(df, tag, real=module.materialize):
            out = real(df, tag)
            seen.append((tag, out.count()))
            return out

        monkeypatch.setattr(module, "materialize", spy)
    return seen


def rows(written, tag):
    return [n for t, n in written if t == tag]


def test_queries_walk_side_by_side(spark, written):
    edges = spark.createDataFrame([(i, -j, 1.0) for i in range(1, 5) for j in range(1, 7)], "src long, dst long, weight double")
    seeds = spark.createDataFrame([(q, q % 4 + 1, 1.0) for q in range(8)] + [(8, 99, 1.0)], "query_id long, id long, weight double")
    got = G.ppr_channel(edges, seeds, 3, rounds=3).collect()
    assert max(rows(written, "ppr")) == 11  # a row a node and not one a query and node
    assert {r.query_id for r in got} == set(range(9)) and [r.score for r in got if r.query_id == 8] == [1.0]


def test_propagation_ends_where_no_source_moves(spark, written):
    edges = spark.createDataFrame([(1, -1, "SUPPORTS", 1.0), (2, -1, "SUPPORTS", 1.0), (2, -2, "CONTRADICTS", 1.0)], "src long, dst long, edge_type string, weight double")
    prior = spark.createDataFrame([(1, 0.9), (2, 0.5), (-1, 0.1), (-2, 0.6)], "id long, credibility double")
    got = {r.id: round(r.confidence, 6) for r in G.propagate_confidence(prior, edges, epsilon=0.0, rounds=20).collect()}
    assert got == {1: 0.9, 2: 0.5, -1: 0.58, -2: 0.0} and len(rows(written, "propagate")) == 1


def test_the_step_that_joins_a_pair_is_not_kept(spark, written):
    # b's side of the edge that joins them has many further neighbours
    edges = [(1, -1), (2, -1), (2, -2)] + [(2, -i) for i in range(3, 60)] + [(1, -i) for i in range(100, 160)]
    e = spark.createDataFrame(edges, "src long, dst long")
    got = [(r.place, r.node_id) for r in G.shortest_paths(e, spark.createDataFrame([(1, -2)], "a long, b long"), 4).orderBy("place").collect()]
    assert got == [(0, 1), (1, -1), (2, 2), (3, -2)]
    assert sum(rows(written, "paths-reached")) == 0 and max(rows(written, "paths-front")) < 60 + 5


def test_joining_steps_are_tried_from_the_first_path_on(spark, written):
    near, far = range(10, 50), range(100, 140)
    edges = [(1, i) for i in near] + [(2, j) for j in far] + [(i, j) for i in near for j in far] + [(900, k) for k in range(901, 931)]
    pairs = [(1, 2)] + [(i, 900) for i in near]  # the others have no path
    found = G.shortest_paths(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(pairs, "a long, b long"), 4, few=0)
    assert [tuple(r) for r in found.orderBy("place").collect()] == [(1, 2, 0, 1), (1, 2, 1, 10), (1, 2, 2, 100), (1, 2, 3, 2)]
    assert max(rows(written, "paths-front")) == 40 and sum(rows(written, "paths-met")) == 1  # of 1600 joining steps


def test_like_chains_are_counted_and_no_rows(spark):
    from tessera.operators.similarity import _dtw, agreeing_chains
    from tessera.operators.vector_index import Params

    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 4)) + 0.6
    steps = [[rng.normal(size=4).tolist() for _ in range(i % 3)] if i % 7 else None for i in range(60)]
    chains = spark.createDataFrame([(i, i % 5 if i % 11 else None, v[i].tolist(), steps[i]) for i in range(60)], "node_id long, agent_id int, embedding array<double>, steps array<array<double>>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {}
    for i in range(60):
        for j in range(60):
            if i != j and round(u[i] @ u[j], 6) >= 0.2 and _dtw(steps[i], steps[j]) > 0.3:
                k = (i, j % 5 if j % 11 else None)
                want[k] = want.get(k, 0) + 1
    for p in (Params(), Params(block=16)):
        found = agreeing_chains(chains, 0.2, 0.3, p).groupBy("query_id", "agent_id").sum("n").collect()
        assert {(r[0], r[1]): r[2] for r in found} == want and len(want) < sum(want.values())


def test_no_chain_is_written_for_each_block(spark, monkeypatch):
    import numpy as np

    from tessera.operators import vector_index as V
    from tessera.operators.similarity import agreeing_chains

    seen = []
    real = V.materialize
    monkeypatch.setattr(V, "materialize", lambda df, tag: (out := real(df, tag), seen.append(out.count()))[0])
    rng = np.random.default_rng(4)
    chains = [(i, i % 3, rng.normal(size=4).tolist(), [rng.normal(size=4).tolist() for _ in range(1 + i % 2)]) for i in range(120)]
    chains = spark.createDataFrame(chains, "node_id long, agent_id int, embedding array<double>, steps array<array<double>>")
    found = agreeing_chains(chains, -1.0, 0.0, V.Params(block=8, query_block=8, together=4))
    assert found.groupBy().sum("n").first()[0] == 120 * 119 and seen and max(seen) <= 120


def test_pagerank_iterates_no_end_without_edges(spark, written):
    edges = spark.createDataFrame([(1, -i, 1.0) for i in range(1, 40)] + [(2, 1, 1.0)], "src long, dst long, weight double")
    got = {r.id: r["rank"] for r in G.personalized_pagerank(edges, spark.createDataFrame([(1, 1.0), (-1, 1.0)], "id long, weight double"), rounds=4).collect()}
    assert max(rows(written, "pagerank")) == 2 and len(got) == 40 and abs(sum(got.values()) - 1) < 1e-9


def test_what_targets_share_is_summed_once(spark, written):
    kinds = ("SUPPORTS", "CONTRADICTS", "SYNTHESIZED_FROM")
    edges = [(s, -p, kinds[(s + p) % 3], 0.1 + s * p % 7 / 10) for s in range(1, 13) for p in range(1, 13) if s * p % 5]
    e = spark.createDataFrame(edges + [(20, 21, "SUPPORTS", 1.0), (21, 22, "SUPPORTS", 1.0)], "src long, dst long, edge_type string, weight double")
    prior = spark.createDataFrame([(i, abs(i) % 10 / 10) for i in range(-12, 23)], "id long, credibility double")
    got = {(r.target, r.id): r.confidence for r in C.propagate_local(prior, e, spark.createDataFrame([(i,) for i in (1, 2, 3, 20)], "id long"), 2, 0.0).collect()}
    whole = {r.id: r.confidence for r in G.propagate_confidence(prior, e, supporting=(kinds[0], kinds[2])).collect()}
    want = {(s, d): whole[d] for s, d, *_ in edges if s < 4 and abs(whole[d] - abs(d) % 10 / 10) > 1e-9} | {(20, 21): whole[21], (20, 22): whole[22]}
    assert got == pytest.approx(want)
    assert sum(rows(written, "local-inside")) == 2 and len(rows(written, "local-seen")) == 1  # of nodes with both in- and out-edges alone
