"""Paths for tables of pairs, subjects in texts, local propagation and trailing counts against plain Python."""

import random
from collections import deque

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.operators import chains as C
from tessera.operators import graph as G
from tessera.operators import joins as J
from tessera.streaming import streams as ST


def path(edges, a, b, most):
    """The path of fewest hops with the smallest ids from b back."""
    near = {}
    for s, d in edges:
        near.setdefault(s, set()).add(d)
        near.setdefault(d, set()).add(s)
    if a not in near or b not in near:
        return None
    hops, todo = {a: 0}, deque([a])
    while todo:
        x = todo.popleft()
        for y in near[x]:
            if y not in hops:
                hops[y] = hops[x] + 1
                todo.append(y)
    if hops.get(b, most + 1) > most:
        return None
    out = [b]
    while out[-1] != a:
        out.append(min(y for y in near[out[-1]] if hops.get(y) == hops[out[-1]] - 1))
    return out[::-1]


@pytest.mark.parametrize(("seed", "n", "m", "most"), [(1, 30, 40, 6), (2, 60, 70, 5), (3, 12, 40, 3)])
def test_paths_of_many_pairs(spark, seed, n, m, most):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(1000, 1001)]
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(40)] + [(0, 1000), (0, 7777), (1000, 1001), (None, 1), (5, 5), (5, 5)]
    got = {}
    for r in G.shortest_paths(spark.createDataFrame(edges + [(None, 3)], "src long, dst long"), spark.createDataFrame(pairs, "a long, b long"), most).orderBy("place").collect():
        got.setdefault((r.a, r.b), []).append((r.place, r.node_id))
    want = {p: w for p in set(pairs) if None not in p and (w := path(edges, *p, most))}
    assert {p: [i for _, i in v] for p, v in got.items()} == want
    assert all([at for at, _ in v] == list(range(len(v))) for v in got.values())


def test_paths_without_edges_or_pairs(spark):
    e, p = spark.createDataFrame([(1, 2)], "src long, dst long"), spark.createDataFrame([(1, 2)], "a long, b long")
    assert G.shortest_paths(e.limit(0), p).count() == 0 and G.shortest_paths(e, p.limit(0)).count() == 0


def test_a_path_is_found_however_long_it_is(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(0, 20), (20, 21), (21, 20), (30, None)], "src long, dst long")
    assert sorted(G.shortest_path(e, 0, 9).collect()) == [(i, i) for i in range(10)]
    assert sorted(G.shortest_path(e, 9, 1, 8).collect()) == [(i, 9 - i) for i in range(1, 10)] and G.shortest_path(e, 9, 1, 7).count() == 0
    assert G.shortest_path(e, 0, 30).count() == 0 and G.shortest_path(e, 5, 5).collect() == [(5, 0)]


def test_subjects_in_texts(spark):
    texts = [(1, "The Red fox and the RED hen"), (2, "hen.*"), (3, None), (4, ""), (5, "fox " * 50_000), (5, "a hen"), (6, "no more")]
    subjects = ["red", "Red", "hen.*", "fox and", None, "", "FOX", "unseen", "red"]
    want = {(s, i) for s in subjects if s is not None for i, t in texts if t is not None and s.lower() in t.lower()}
    t = spark.createDataFrame(texts, "node_id long, content string").withColumns({"s": F.lit(1), "x": F.lit(2)})
    for block in (100, 2):
        got = J.mentions_of(t, "node_id", "content", spark.createDataFrame([(s,) for s in subjects], "subject string"), block).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_local_propagation_of_many_targets_is_that_of_each(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(25), rng.randrange(25), rng.choice(["SUPPORTS", "CONTRADICTS", "SYNTHESIZED_FROM", "CAUSES"]), rng.random()) for _ in range(70)]
    e = spark.createDataFrame(edges, "src long, dst long, edge_type string, weight double")
    prior = spark.createDataFrame([(i, (i % 10) / 10) for i in range(25)], "id long, credibility double")
    key = lambda df: {(r.target, r.id): round(r.confidence, 9) for r in df.collect()}
    targets = [1, 7, 20]
    got = key(C.propagate_local(prior, e, spark.createDataFrame([(i,) for i in [*targets, 7]], "id long"), 2, 0.05, 5))
    want = {}
    for i in targets:
        inside, front = {i}, {i}
        for _ in range(2):
            front = {d for s, d, *_ in edges if s in front} | {s for s, d, *_ in edges if d in front}
            inside |= front
        best = {}
        for s, d, kind, w in edges:
            if s in inside and d in inside and kind != "CAUSES":
                best[s, d, kind] = max(best.get((s, d, kind), 0), w)
        x = {j: (j % 10) / 10 for j in inside}
        p = dict(x)
        for _ in range(5):
            new = dict(p)
            for d in inside:
                parts = []
                for sign in (1, -1):
                    own = [(s, w) for (s, t, kind), w in best.items() if t == d and (kind == "CONTRADICTS") == (sign < 0)]
                    parts += [sign * w * x[s] / sum(v for _, v in own) for s, w in own]
                if parts:
                    new[d] = min(1, max(0, 0.2 * p[d] + 0.8 * sum(parts)))
            x = new
        want |= {(i, j): round(x[j], 9) for j in inside if abs(x[j] - p[j]) > 0.05}
    assert got == pytest.approx(want)


def test_trailing_counts_of_a_hot_node(spark):
    rng = random.Random(9)
    rows = [(i, 0 if i % 3 else i % 7, 1_700_000_000 + rng.choice([rng.randrange(20_000), 1800 * rng.randrange(9)])) for i in range(4000)]
    e = spark.createDataFrame(rows, "entry_id long, node_id long, at long").select("entry_id", "node_id", F.timestamp_seconds("at").alias("ts"), F.lit(1).alias("bucket"), F.lit(2).alias("later"))
    w = Window.partitionBy("node_id").orderBy(F.unix_timestamp("ts")).rangeBetween(-1800, 0)
    want = {tuple(r) for r in e.select("entry_id", F.count("*").over(w)).collect()}
    assert {tuple(r) for r in ST.touch_counts(e).collect()} == want


def test_typed_props_of_odd_texts(spark):
    rows = [(1, '{"a": {"b": [1, 2]}, "c": "x"}'), (2, "{"), (3, None), (4, ""), (5, "7"), (6, '{"a": {"b": ["z", true]}, "c": 3}')]
    got = spark.createDataFrame(rows, "i long, props string").select("i", *X.typed_props(F.col("props"), {"b": ("$.a.b[0]", "bigint"), "c": ("$.c", "string")})).orderBy("i").collect()
    assert [(r.b, r.c, r.valid) for r in got] == [(1, "x", True), (None, None, False), (None, None, False), (None, None, False), (None, None, True), (None, "3", True)]


def test_restart_walk_of_a_signed_graph(spark):
    """Against the matrix: dangling mass is lost, columns of no positive sum are not scaled, without a seed t is even."""
    import numpy as np

    rng = random.Random(8)
    edges = [(rng.randrange(12), rng.randrange(12), rng.choice(["SUPPORTS", "SUPPORTS", "CONTRADICTS", "CAUSES"]), rng.random()) for _ in range(40)] + [(3, 99, "SUPPORTS", 1.0)]
    e, n = spark.createDataFrame(edges, "src long, dst long, edge_type string, weight double"), spark.range(13)
    for seeds in ([2, 5, 5, 77], [77], []):
        a = np.zeros((13, 13))
        for s, d, kind, w in edges:
            if d < 13:
                a[d, s] += {"SUPPORTS": w, "CONTRADICTS": -w}.get(kind, 0)
        total = a.sum(0)
        a = a / np.where(total > 0, total, 1)
        own = [s for s in set(seeds) if s < 13]
        t = np.array([1 / len(own) if i in own else 0.0 for i in range(13)]) if own else np.full(13, 1 / 13)
        x = t.copy()
        for _ in range(100):
            new = 0.15 * t + 0.85 * a @ x
            if abs(new - x).max() < 1e-2:
                break
            x = new
        got = G.pagerank_restart(n, e, spark.createDataFrame([(s,) for s in seeds], "id long"), epsilon=1e-2)
        assert {r.id: r["rank"] for r in got.collect()} == pytest.approx(dict(enumerate(x)))


def test_subgraph_filters(spark):
    e = spark.createDataFrame([(1, 2, "A"), (2, 3, "A"), (3, 4, "A"), (1, 5, "B"), (5, 6, "A"), (2, 6, "A")], "src long, dst long, edge_type string")
    n = spark.createDataFrame([(2, "x"), (3, "x"), (4, "x"), (5, "y"), (6, "y")], "id long, layer string")
    seeds = spark.createDataFrame([(1,)], "id long")
    near, inside = G.subgraph(e, n, seeds, 2, ["A"], ["x"])
    assert {tuple(r) for r in near.collect()} == {(1, 0), (2, 1), (3, 2)} and {tuple(r) for r in inside.collect()} == {(1, 2, "A"), (2, 3, "A")}
    near, inside = G.subgraph(e, n, seeds, 2)
    assert {r.id for r in near.collect()} == {1, 2, 3, 5, 6} and inside.count() == 5


def test_upsert_keeps_columns_of_any_name(spark):
    from tessera.operators import scans as S

    base = spark.createDataFrame([(1, 1, "a"), (2, 5, "b"), (None, 1, "n")], "id long, v long, _new string").withColumn("row", F.lit(7))
    more = spark.createDataFrame([(1, 1, "A"), (2, 4, "B"), (3, 0, "c")], "id long, v long, _new string").withColumn("row", F.lit(8))
    assert {tuple(r) for r in S.upsert(base, more, ["id"], "v").collect()} == {(1, 1, "A", 8), (2, 5, "b", 7), (3, 0, "c", 8), (None, 1, "n", 7)}
