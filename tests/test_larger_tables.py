"""What a task holds, and how often it does its work, must not grow faster than its input."""

import numpy as np
import pyarrow as pa


def test_a_text_is_cut_once_for_its_sentences(spark):
    from tessera.operators.windows import key_sentences

    texts = [(1, ". ".join(f"Sentence {i} was found here" for i in range(300)) + "."), (2, "short"), (3, None), (4, "x" * 600)]
    got = key_sentences(spark.createDataFrame(texts, "node_id long, content string"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    out = {r.node_id: r.summary for r in got.collect()}
    assert out[2] == "short" and out[3] is None and out[4] == "x" * 512 and 400 < len(out[1]) <= 512


def test_trigrams_of_few_texts_are_held_at_a_time(spark):
    from tessera.operators import text_search as TS

    texts = [f"text {i} {'x' * (i % 5)}" for i in range(1000)] + [""]
    made = list(TS.gram_batches(iter([pa.RecordBatch.from_arrays([pa.array(range(1001)), pa.array(texts)], names=["node_id", "text"])])))
    assert max(b.num_rows for b in made) <= TS.GRAM_ROWS and sum(b.num_rows for b in made) == 1001
    d = spark.createDataFrame([(i, t if i else None) for i, t in enumerate(texts)], "node_id long, content string")
    assert TS.node_grams(d).exceptAll(d.select("node_id", TS.trigram_codes("content"))).isEmpty()


def test_a_task_holds_a_bounded_number_of_scores():
    from tessera.operators import similarity as M

    rng = np.random.default_rng(1)
    table = lambda n: pa.table({"id": np.arange(n), "embedding": pa.array(list(rng.normal(size=(n, 4)))), "tag": np.zeros(n, np.int64)})
    queries, vectors = table(600), table(1 << 14)
    sizes = [s.shape for *_, s in M._scores(queries, vectors, False)]
    assert sum(a for a, _ in sizes) == 600 and max(a * b for a, b in sizes) <= 1 << 20


def test_an_encoder_gets_few_texts_at_a_time(spark):
    from tessera.operators import knowledge as K

    def sizes(frames):
        for f in frames:
            yield f.assign(embedding=[[float(len(f))]] * len(f))[["node_id", "embedding"]]

    nodes = spark.range(3000).selectExpr("id as node_id", "string(id) as content", "false as embedded").coalesce(1)
    vectors, _ = K.embed_pending(nodes, sizes)
    assert vectors.selectExpr("max(embedding[0])", "count(*)").first()[:] == (512.0, 3000)


def plans(monkeypatch, module):
    """The physical plan of each table that an operator of ``module`` writes, by tag."""
    seen = []
    real = module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, tag: (seen.append((tag, df._jdf.queryExecution().executedPlan().toString())), real(df, tag))[1])
    return seen


def test_edges_are_walked_without_making_them_distinct(spark, monkeypatch):
    from tessera.operators import graph as G

    seen = plans(monkeypatch, G)
    e = spark.createDataFrame([(1, 2), (1, 2), (2, 1), (2, 3), (3, 4), (4, 4)], "src long, dst long")
    got = G.neighborhood(e, spark.createDataFrame([(1,)], "id long"), 2).collect()
    assert sorted(got) == [(1, 0), (2, 1), (3, 2)]
    assert sorted(G.shortest_path(e, 1, 4).collect()) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert all("Aggregate" not in p for t, p in seen if t in ("hop-edges", "path-edges"))


def test_votes_are_dealt_by_their_number(spark):
    from collections import Counter

    from tessera.operators import graph as G

    assert G._dealt(spark.range(3), "id", rows=20 * G.TASK_ROWS).rdd.getNumPartitions() == 20
    pairs = [(i, (i * 7 + k) % 30) for i in range(30) for k in (1, 2, 5)] + [(3, 3), (4, 4), (1, 9), (9, 1), (1, 9)]
    near = {i: {b for a, b in pairs if a == i} | {a for a, b in pairs if b == i} for i in range(30)}
    label = {i: i for i in near}
    for _ in range(3):
        votes = {i: Counter(label[j] for j in near[i]) for i in near}
        label = {i: min(votes[i], key=lambda x: (-votes[i][x], x)) for i in near}
    got = G.label_propagation(spark.createDataFrame(pairs, "src long, dst long"), 3).collect()
    assert {r.id: r.label for r in got} == label and len(got) == 30


def test_roots_of_chains_are_found_once(spark, sf_dir, monkeypatch):
    from tessera.operators import graph as G
    from tessera.plans.catalog import CASES
    from tessera.sources.fixtures import Tables

    calls = []
    real = G.version_roots
    monkeypatch.setattr(G, "version_roots", lambda v: (calls.append(1), real(v))[1])
    CASES["g10_chain_pointers"][0](Tables(spark, sf_dir))
    assert len(calls) == 1


def test_a_floor_spares_measuring_nodes(monkeypatch):
    from tessera.operators import text_search as TS

    rng = np.random.default_rng(5)
    n, k, least, best = 600, 5, 0.1, 4.0
    words = [[{"id": int(i), "w": float(rng.uniform(0.1, 1))} for i in rng.choice(9, rng.integers(0, 5), replace=False)] for _ in range(n)]
    grams = [np.unique(rng.integers(0, 40, rng.integers(3, 30))) for _ in range(n)]
    lists, held = TS.Lists(pa.array(words, pa.list_(pa.struct([("id", pa.int64()), ("w", pa.float64())])))), TS.Grams(pa.array(grams, pa.list_(pa.int64())))
    measured = []
    monkeypatch.setattr(TS.Grams, "similarity", lambda self, nodes, y, real=TS.Grams.similarity: (measured.append(len(nodes)), real(self, nodes, y))[1])
    asked, y = [0, 1, 2, 3], np.arange(0, 40, 3)
    top = lambda found: sorted(zip(np.round(-found[1], 6).tolist(), found[0].tolist(), strict=True))[:k]
    plain = top(TS.blended(lists, held, asked, y, best, k, least))
    before, measured[:] = sum(measured), []
    floor = 0.7 * float(np.sort(lists.scores(asked))[-k]) / best
    assert top(TS.blended(lists, held, asked, y, best, k, least, floor)) == plain and 0 < sum(measured) <= before
    measured[:] = []
    assert len(TS.blended(lists, held, asked, y, best, k, least, 0.95)[0]) == 0 and not measured  # the k best are in other blocks


def test_words_counted_once_serve_both_text_channels(spark):
    from tessera.operators import retrieval as R
    from tessera.operators import text_search as TS

    nodes = spark.createDataFrame([(i, f"alpha {'beta' * (i % 2)} of gamma{i % 3} of") for i in range(30)] + [(30, None)], "node_id long, content string")
    queries = spark.createDataFrame([(1, "Beta of gamma1 alpha"), (2, "of"), (3, None), (4, "delta alpha delta")], "query_id long, text string")
    words = TS.node_words(nodes)
    counted = TS.counted_terms(words, R.asked_words(queries))
    got = R.grep_channel(queries, nodes, 4, words, counted)
    assert "explode(words" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(got.collect()) == sorted(R.grep_channel(queries, nodes, 4).collect()) and got.count() == 8


def test_nearest_in_two_precisions_are_the_nearest():
    from tessera.operators import similarity as M

    rng = np.random.default_rng(2)
    v = rng.normal(size=(3000, 8))
    v[1::3] = v[::3] + rng.normal(size=(1000, 8)) * 1e-6  # closer than single precision tells
    v[7] = 0
    ids = rng.permutation(3000)
    table = pa.table({"id": ids, "embedding": pa.array(list(v)), "tag": ids % 4})
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)
    s = np.round(u @ u.T, 6)
    for k, least, other in ((3, 0.3, False), (20, -1.0, True), (100, -1.0, False), (None, 0.95, False)):
        skip = (ids[:, None] % 4 == ids[None] % 4) if other else np.eye(3000, dtype=bool)
        want = {}
        for i in range(0, 3000, 30):
            ok = np.flatnonzero(~skip[i] & (s[i] >= least))
            want[ids[i]] = ids[ok[np.lexsort((ids[ok], -s[i, ok]))][:k]].tolist()
        got = M._best(k, least, other)((), table.take(np.arange(0, 3000, 30)), table).to_pydict()
        found = {q: [] for q in want}
        for q, n in zip(got["query_id"], got["node_id"], strict=True):
            found[q].append(n)
        assert found == want


def final_plan(spark, sf_dir, name):
    from tessera.plans.catalog import CASES
    from tessera.sources.fixtures import Tables

    return CASES[name][0](Tables(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()


def test_line_items_are_made_edges_once(spark, sf_dir):
    assert "l_suppkey" not in final_plan(spark, sf_dir, "j39_validate_edges")
    assert "l_suppkey" not in final_plan(spark, sf_dir, "l22_write_findings")


def test_claims_are_numbered_and_texts_cut_for_names_once(spark, sf_dir, monkeypatch):
    from tessera.plans import written

    assert "l_shipdate" not in final_plan(spark, sf_dir, "j12_supersession_candidates")
    tags = [tag for tag, _ in plans(monkeypatch, written)]
    seen = plans(monkeypatch, written)
    final_plan(spark, sf_dir, "l18_extract_claims")
    assert not tags and [tag for tag, _ in seen] == ["names"]


def test_types_are_dealt_by_their_number_and_made_distinct_once(spark, monkeypatch):
    from collections import Counter

    from tessera.operators import extraction as E

    monkeypatch.setattr(E, "TYPE_ROWS", 100)
    seen = plans(monkeypatch, E)
    types = [f"{w}{'s' * (i % 4)} {'x' * i}" for i, w in enumerate(("aaaa", "Cities", "event", "zzzq") * 75)] + ["x", "", None] * 2
    v = E.type_vocabulary(spark, {"First": ["event", "aaa"], "Second": ["city", "event", "aaab"]})
    found = E.type_classes(spark.createDataFrame([(x,) for x in types], "word string"), "word", v)
    assert found.rdd.getNumPartitions() == 4 and [t for t, p in seen if "ExistingRDD[word" in p] == ["types", "type-words"]
    words = {w: (c, i) for i, (c, w) in reversed(list(enumerate([("First", "event"), ("First", "aaa"), ("Second", "city"), ("Second", "event"), ("Second", "aaab")])))}
    grams = lambda x: Counter(f"#{x}#"[i : i + 3] for i in range(len(x)))

    def cosine(a, b):
        a, b = grams(a), grams(b)
        return round(sum(n * b[g] for g, n in a.items()) / (sum(n * n for n in a.values()) ** 0.5 * sum(n * n for n in b.values()) ** 0.5), 9)

    def want(x):
        norm = x.strip(" ").lower() if x else ""
        if token := next((t for t in [norm, *norm.split()] if t in words), None):
            return words[token][0]
        best = max(((cosine(norm, w), -i, c) for w, (c, i) in words.items()), default=None) if norm else None
        return best[2] if best and best[0] >= 0.15 else None

    assert {r.word: r.type_class for r in found.collect()} == {x: want(x) for x in types} and found.count() == 303


def test_new_findings_meet_current_ones_once(spark, sf_dir, monkeypatch):
    from tessera.operators import lifecycle as L

    assert "o_orderkey" not in final_plan(spark, sf_dir, "l22_upsert_findings")
    seen = plans(monkeypatch, L)
    current = spark.createDataFrame([("a", 1, 1), ("b", 2, 4), ("d", 5, 2), (None, 7, 3), ("e", 6, None)], "k string, body int, version int")
    new = spark.createDataFrame([("b", 3, 10), ("c", 9, 11), ("d", 6, 12), (None, 8, 10), ("e", 4, 10)], "k string, body long, finding long")
    cites = spark.createDataFrame([(10, 1), (10, 2), (11, 1), (12, 3)], "finding long, node_id long")
    now, history = L.upsert_findings(current, new, ["k"], cites, cites, spark.createDataFrame([(1,), (2,), (2,)], "node_id long"))
    # a null key meets no other
    want = [("a", 1, None, 1), ("b", 3, 2, 5), ("c", 9, 1, 1), ("d", 5, None, 2), ("e", 4, 2, 1), (None, 7, None, 3), (None, 8, 2, 1)]
    assert sorted(map(tuple, now.select("k", "body", "n_claims", "version").collect()), key=str) == sorted(want, key=str)
    assert [(r.k, r.version) for r in history.collect()] == [("b", 4)] and now.schema["body"].dataType.simpleString() == "bigint"
    assert [t for t, _ in seen] == ["findings-held", "findings"] and all("Join" not in df._jdf.queryExecution().executedPlan().toString() for df in (now, history))
