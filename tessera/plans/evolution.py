"""Queries over consensus, supersession, chains and lifecycle whose rules have several parts, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.operators import aggregates as A
from tessera.operators import chains as C
from tessera.operators import graph as G
from tessera.operators import lifecycle as L
from tessera.operators import scans as S
from tessera.operators import similarity as M
from tessera.operators import windows as W
from tessera.operators.filters import keep_top
from tessera.operators.similarity import nearest
from tessera.plans.analytic import SIM, _tree, knn
from tessera.plans.more import _streamed
from tessera.plans.relational import HITS, MID, _hits, _members, r6, ts
from tessera.plans.rules import joined
from tessera.scratch import scratch_path
from tessera.sources.fixtures import Tables

NOW = "2024-02-01 00:00:00"


def stepped(t: Tables):
    """Each vector as a chain of two steps: its own and the next one's, the last one's twice."""
    w = Window.orderBy("node_id")  # one row a chain; the fixture's order
    after = F.coalesce(F.lead("embedding").over(w), F.col("embedding"))
    return t.vectors.select("node_id", "embedding", "agent_id", F.array(F.col("embedding").cast("array<double>"), after.cast("array<double>")).alias("steps"))


# Sequences of two steps warp onto each other step by step, for no path costs less.
DTW = """st AS (SELECT node_id, agent_id, embedding, CAST(embedding AS DOUBLE[]) AS e1, CAST(coalesce(lead(embedding) OVER (ORDER BY node_id), embedding) AS DOUBLE[]) AS e2 FROM vectors)"""
SAME = "1 / (1 + sqrt(pow(list_distance(x.e1, y.e1), 2) + pow(list_distance(x.e2, y.e2), 2)))"


def _silo_dump(t: Tables):
    """One tenant of nodes, edges and vectors out of an export of all, by what it holds."""
    path = scratch_path(t.spark, "export")
    nodes = t.nodes.select("node_id", "silo_id", "layer")
    of = nodes.select("node_id", "silo_id")
    edges = t.edges.join(of.withColumnRenamed("node_id", "src"), "src")
    vectors = t.vectors.select("node_id", "label").join(of, "node_id")
    S.silo_export({"nodes": nodes, "edges": edges, "vectors": vectors}, path)
    back = S.silo_import(t.spark, path, "src1")
    return back["nodes"].select(F.lit("node").alias("kind"), F.col("node_id").alias("id"), F.col("layer").alias("what")).union(back["edges"].select(F.lit("edge"), "src", "edge_type")).union(back["vectors"].select(F.lit("vector"), "node_id", F.col("label").cast("string")))


def _events(t: Tables):
    e = t.events.withColumn("is_write", F.col("event_type").isin("purchase", "signup"))
    return e.select("user_id", "event_id", "ts", F.concat(F.lit("query about "), "event_type").alias("text"), "is_write")


def _ratio_rows() -> str:
    """The ratio of each two of the fixture's five texts, as rows."""
    from difflib import SequenceMatcher

    texts = [f"query about {k}" for k in ("view", "click", "purchase", "signup", "error")]
    return ", ".join(f"('{a}', '{b}', {SequenceMatcher(None, a, b).ratio()})" for a in texts for b in texts)


STUCK = f""", ratio AS (SELECT * FROM (VALUES {_ratio_rows()}) AS v(a, b, r)), e AS (SELECT user_id, event_id, ts, 'query about ' || event_type AS text, event_type IN ('purchase', 'signup') AS wrote FROM events),
d AS (SELECT *, lag(ts, 2) OVER w AS t2, lag(text) OVER w AS x, lag(text, 2) OVER w AS y, bool_or(wrote) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS any_write FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id FROM d JOIN ratio p ON p.a = d.text AND p.b = x JOIN ratio q ON q.a = d.text AND q.b = y WHERE ts <= t2 + INTERVAL 1 DAY AND NOT any_write AND p.r >= 0.9 AND q.r >= 0.9"""


def _usefulness(t: Tables):
    second = F.date_trunc("second", "ts")
    d = t.events.where("event_type = 'view'").select(F.col("event_id").alias("delivery"), F.col("user_id").alias("session"), second.alias("ts"), F.array(F.array(F.col("value") / 100)).alias("chain_steps"))
    steps = t.events.select(F.col("user_id").alias("session"), second.alias("step_ts"), F.array(F.col("value") / 100).alias("vector"))
    return C.chain_usefulness(d, steps, t.events.where("event_type = 'signup'").select(F.col("user_id").alias("session"), second.alias("begun")), 1, 0.5)


def _timed_edges(t: Tables):
    e = t.edges.select(F.concat_ws("/", F.col("src").cast("string"), F.col("dst").cast("string"), "edge_type").alias("edge_id"), "edge_type", "weight", (F.col("src") * 37 % 100).alias("created_at"), "src", "dst")
    lineage = e.select(F.concat_ws("/", F.col("src").cast("string"), F.col("dst").cast("string"), F.lit("SUPPORTS")).alias("edge_id"), F.col("edge_id").alias("from_id")).where("edge_id <> from_id")
    return C.tombstone_edges(e, lineage, "CONTRADICTS", 0.95, F.lit(50))


def _causes(t: Tables):
    return t.orders.select("o_orderkey", F.col("o_orderkey").alias("edge_id"), F.col("o_custkey").alias("src"), (F.col("o_custkey") + F.col("o_orderkey") % 3 + 1).alias("dst"), F.lit("CAUSES").alias("edge_type"), F.round((F.col("o_orderkey") % 10 + 1) / 11, 9).alias("weight"))


def _walk_patterns() -> str:
    text = """, e AS (SELECT DISTINCT o_orderkey AS src, o_orderkey // 3 AS dst FROM orders WHERE o_orderkey > 0), k AS (SELECT o_orderkey AS id, o_orderstatus AS kind FROM orders),
    w AS (SELECT src, dst, kind AS k FROM e JOIN k ON k.id = dst), p1 AS (SELECT dst, k.kind || '>' || w.k AS pattern, count(*) AS n FROM w JOIN k ON k.id = src GROUP BY 1, 2)"""
    for i in range(2, 7):
        text += f", p{i} AS (SELECT w.dst, pattern || '>' || w.k AS pattern, sum(n) AS n FROM p{i - 1} p JOIN w ON w.src = p.dst GROUP BY 1, 2)"
    union = " UNION ALL ".join(f"SELECT pattern, CAST({i} AS INT) AS length, CAST(sum(n) AS BIGINT) AS frequency FROM p{i} GROUP BY 1" for i in range(2, 7))
    return text + f" SELECT sha256(pattern) AS pattern_id, pattern, length, frequency FROM ({union}) WHERE frequency >= 2"


def _superseding(t: Tables):
    pairs = t.nodes.select(F.col("node_id").alias("winner"), (F.col("node_id") - 5).alias("loser")).where("winner % 3 = 0")
    edges = t.nodes.where("node_id % 2 = 0").select((F.col("node_id") - 5).alias("src"), F.col("node_id").alias("dst"), F.lit("SUPERSEDES").alias("edge_type"))
    done, new = L.apply_supersession(t.nodes.select("node_id", "state", F.lit(None).cast("timestamp_ntz").alias("valid_to")), edges, pairs, ts(NOW))
    kept = done.select("node_id", "state", "superseded_by", F.col("valid_to").cast("string").alias("valid_to"))
    return kept.join(new.select(F.col("dst").alias("node_id"), F.col("src").alias("edge_from")), "node_id", "left")


def _forgotten(t: Tables):
    """What is asked for is forgotten at noon; some is taken back half an hour later; at two the rest goes, with its edges."""
    gone = t.labels.where("toxic = 1").select(F.col("doc_id").alias("node_id"))
    n = L.forget(t.nodes.select("node_id", "state"), gone, ts("2024-01-31 12:00:00"))
    n = L.cancel_forget(n, gone.where("node_id % 2 = 0"), ts("2024-01-31 12:30:00"))
    edges = t.edges.select("src", "dst", "edge_type")
    nodes, kept = L.hard_delete(n, edges, ts("2024-01-31 14:00:00"))
    return nodes.select(F.lit("node").alias("kind"), F.col("node_id").alias("id"), "state").union(kept.groupBy("src").agg(F.count("*").cast("string").alias("n")).select(F.lit("edges"), "src", "n"))


def _erased(t: Tables):
    nodes, edges, audit = L.erase(t.nodes, t.edges, t.labels.where("toxic = 1").select((-F.col("doc_id")).alias("id")).union(t.labels.where("toxic = 1").select((F.col("doc_id") * 2).alias("id"))), cascade=True)
    left = nodes.agg(F.count("*").alias("n_nodes")).crossJoin(edges.agg(F.count("*").alias("n_edges")))
    return audit.crossJoin(left)


def _demoted(t: Tables):
    edges = t.claims.select((-F.col("subject")).alias("src"), F.col("claim_id").alias("dst")).distinct()
    supports = t.claims.groupBy((-F.col("subject")).alias("id")).agg((F.count_distinct("evidence") % 5).alias("n_supports"))
    low, cascade = L.demote_facts(t.claims, edges, supports)
    return low.select(F.col("claim_id").alias("id"), F.lit("demote").alias("action"), F.round("confidence", 6).alias("confidence")).union(cascade.select("id", "action", F.lit(None).cast("double")))


def _findings(t: Tables):
    v = t.versions
    current = v.where("node_id % 2 = 0").groupBy("chain_id").agg(F.max("node_id").alias("body"), F.count("*").alias("version"))
    new = v.where("node_id % 2 = 1").groupBy("chain_id").agg(F.max("node_id").alias("body")).withColumn("finding", F.col("chain_id"))
    cites = v.select(F.col("chain_id").alias("finding"), "node_id")
    now, history = L.upsert_findings(current, new, ["chain_id"], cites, cites.where("node_id % 5 <> 0"), v.where("node_id % 7 = 0").select("node_id"))
    return now.select(F.lit("now").alias("part"), "chain_id", F.col("body").cast("string").alias("body"), "n_claims", "version").union(history.select(F.lit("was"), "chain_id", "body_hash", F.lit(None).cast("long"), "version"))


def _terminals(t: Tables, roots=None):
    v = t.versions.select("node_id", "supersedes_id", F.when((F.col("chain_id") % 3 == 0) | F.col("valid_to").isNotNull(), "SUPERSEDED").otherwise("ACTIVE").alias("state"), (F.col("node_id") % 11 == 0).cast("int").alias("group"))
    return G.chain_terminals(v, roots)


def _pointers(t: Tables):
    roots = G.version_roots(t.versions)
    ends = G.chain_pointers(t.versions, roots).select(F.lit("chain").alias("kind"), "root", "head", F.col("length").cast("string").alias("note"))
    return ends.union(_terminals(t, roots).select(F.when(F.col("all_superseded"), "terminal").otherwise("gap"), "root", "head", F.coalesce(F.col("gap_at").cast("string"), F.lit("-"))))


CASES = {
    "s6_silo_export_import": (
        _silo_dump,
        """, s AS (SELECT node_id, layer FROM nodes WHERE silo_id = 'src1') SELECT 'node' AS kind, node_id AS id, layer AS what FROM s UNION ALL SELECT 'edge', src, edge_type FROM edges JOIN s ON src = node_id
        UNION ALL SELECT 'vector', v.node_id, CAST(label AS VARCHAR) FROM vectors v JOIN s ON s.node_id = v.node_id""",
    ),
    "s7_graph_export": (
        lambda t: S.graph_export(t.edges, t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))).select("src", "name", "n", joined("members")),
        """SELECT src, s_name AS name, count(*) AS n, string_agg(dst || ':' || edge_type, ',' ORDER BY edge_type, dst) AS members FROM edges JOIN supplier ON s_suppkey = src GROUP BY 1, 2""",
    ),
    "a3_consensus_candidates": (
        lambda t: r6(A.consensus_candidates(t.claims, t.part.where("p_size < 40").select(F.col("p_partkey").alias("subject"), (F.col("p_size") / 50).alias("heat"))), "avg_confidence", "priority"),
        """, g AS (SELECT silo_id, subject, predicate, count(DISTINCT evidence) AS n_chains, count(DISTINCT agent_id) AS n_agents, avg(coalesce(confidence, 0.5)) AS c FROM claims GROUP BY ALL)
        SELECT silo_id, subject, predicate, n_chains, n_agents, round(c, 6) AS avg_confidence, round((1 - c) * coalesce(CASE WHEN p_size < 40 THEN p_size / 50 END, 0) * ln(least(n_agents, 5) + 1), 6) AS priority
        FROM g LEFT JOIN part ON p_partkey = subject WHERE n_chains >= 2 AND n_agents >= 2""",
    ),
    "a5_chain_consensus": (
        lambda t: r6(C.chain_consensus_of(stepped(t), t.vectors.where("label = 1"), 0.2, 0.35, least_steps=0.36), "confidence"),
        f""", {DTW}, sim AS (SELECT a.node_id AS q, b.node_id AS n, {SIM} AS s FROM vectors a JOIN vectors b ON a.node_id <> b.node_id WHERE {SIM} >= 0.2),
        e AS (SELECT node_id AS q, node_id AS n FROM vectors UNION ALL SELECT q, n FROM sim JOIN st x ON x.node_id = q JOIN st y ON y.node_id = n WHERE {SAME} > 0.36),
        g AS (SELECT q AS query_id, count(DISTINCT n) AS n_chains, count(DISTINCT agent_id) AS n_agents FROM e JOIN vectors v ON v.node_id = n GROUP BY 1),
        k AS (SELECT q, min(n) AS extends FROM sim JOIN vectors v ON v.node_id = n WHERE s >= 0.35 AND label = 1 GROUP BY 1)
        SELECT query_id, n_chains, n_agents, extends, CAST(round(least(0.95, 0.6 + 0.05 * n_chains + 0.1 * n_agents), 6) AS DOUBLE) AS confidence FROM g LEFT JOIN k ON q = query_id WHERE n_chains >= 3 AND n_agents >= 2""",
    ),
    "a8_belief_confidence": (
        lambda t: A.belief_confidence(t.claims, ts(NOW)).withColumns({"confidence": F.round(F.col("confidence") + 1e-9, 4), "expires_at": F.col("expires_at").cast("string")}),
        f"""SELECT silo_id, subject, predicate, round(1 - product(1 - greatest(0, least(1, confidence))) + 1e-9, 4) AS confidence, CAST(TIMESTAMP '{NOW}' + INTERVAL 7 DAY AS VARCHAR) AS expires_at FROM claims GROUP BY ALL
        HAVING round(1 - product(1 - greatest(0, least(1, confidence))), 9) >= 0.6""",
    ),
    "a13_storage_gauges": (
        lambda t: A.storage_gauges(t.nodes, t.edges, t.vectors),
        "SELECT silo_id, count(*) AS n_nodes, " + ", ".join(f"count(*) FILTER (layer = '{x}') AS n_{x}" for x in ("memory", "knowledge", "wisdom", "intelligence"))
        + """, count(*) FILTER (state = 'ACTIVE') AS n_active, CAST(sum(octet_length(encode(content))) AS BIGINT) AS content_bytes,
        (SELECT count(*) FROM edges e JOIN nodes m ON m.node_id = e.src WHERE m.silo_id = nodes.silo_id) AS n_edges, (SELECT count(*) FROM vectors v JOIN nodes m ON m.node_id = v.node_id WHERE m.silo_id = nodes.silo_id) AS n_vectors FROM nodes GROUP BY 1""",
    ),
    "a15_silo_counts": (
        lambda t: A.status_counts(t.nodes, t.edges),
        """SELECT silo_id, state, count(*) AS n_nodes, CAST(sum(octet_length(encode(content))) AS BIGINT) AS content_bytes,
        (SELECT count(*) FROM edges e JOIN nodes m ON m.node_id = e.src WHERE m.silo_id = nodes.silo_id AND m.state = nodes.state) AS n_edges FROM nodes GROUP BY 1, 2""",
    ),
    "a11_merge_beliefs": (
        lambda t: r6(A.merge_beliefs_numeric((g := t.vectors.withColumn("facts", F.array("node_id", F.col("node_id") + 1))).select(F.col("node_id").alias("a"), F.col("facts").alias("facts_a"), (F.col("label") / 10).alias("confidence_a")).join(
            M.overlapping_pairs(t.vectors, 0.3).select("a", "b"), "a").join(g.select(F.col("node_id").alias("b"), F.array("node_id").alias("facts_b"), (F.col("label") / 10).alias("confidence_b")), "b")), "confidence").withColumn("stale", F.array_join(F.col("stale").cast("array<string>"), ",")),
        f""", p AS (SELECT a.node_id AS a, b.node_id AS b, a.label AS la, b.label AS lb, {SIM} AS s FROM vectors a JOIN vectors b ON a.node_id < b.node_id WHERE {SIM} >= 0.3 ORDER BY s DESC, 1, 2 LIMIT 50)
        SELECT a, b, round((la / 10 * 2 + lb / 10) / 3, 6) AS confidence, CAST(len(list_distinct([a, a + 1, b])) AS BIGINT) AS n_facts, sha256('merge|' || a || '|' || b) AS id, a || ',' || b AS stale FROM p""",
    ),
    "a16_retrieval_quality": (
        lambda t: A.retrieval_quality(_hits(t).withColumn("fallback", (F.col("query_id") == 2) & (F.col("node_id") % 10 == 7))).select("query_id", "quality", "suggestion"),
        f""", {HITS}, q AS (SELECT query_id, round(avg(score), 9) AS s, bool_or(query_id = 2 AND node_id % 10 = 7) AS f FROM hits GROUP BY 1), z AS (SELECT query_id, CASE WHEN s > 0.6 AND NOT f THEN 'high' WHEN s >= 0.4 THEN 'partial' WHEN s > 0 THEN 'low' ELSE 'none' END AS quality FROM q)
        SELECT *, CASE quality WHEN 'high' THEN '' WHEN 'partial' THEN 'narrow the query or ask for more hits' WHEN 'low' THEN 'rephrase the query' ELSE 'nothing is known: store it first' END AS suggestion FROM z""",
    ),
    "a17_consolidate_conclusions": (
        lambda t: r6(A.consolidate_conclusions(t.nodes.withColumns({"context": F.col("node_id") % 37, "consolidated": F.col("node_id") % 101 == 3}), "context"), "confidence"),
        """, x AS (SELECT *, node_id % 37 AS context FROM nodes), g AS (SELECT context, count(*) AS n, avg(confidence) AS m FROM x WHERE state = 'ACTIVE' GROUP BY 1),
        b AS (SELECT context, node_id FROM (SELECT *, row_number() OVER (PARTITION BY context ORDER BY confidence DESC, node_id) AS k FROM x WHERE state = 'ACTIVE') WHERE k = 1)
        SELECT g.context, node_id, n, round(least(1, m + least(0.1, 0.02 * n)), 6) AS confidence FROM g JOIN b ON g.context = b.context WHERE n >= 2 AND g.context NOT IN (SELECT context FROM x WHERE node_id % 101 = 3)""",
    ),
    "a18_finding_quality": (
        lambda t: r6(A.finding_quality(t.nodes.select("node_id", F.col("heat_score").alias("density"), F.col("confidence").alias("coverage"), (F.col("age_hours") / 300).alias("relations"), F.col("heat_score").alias("primary_share"), F.lit(0.5).alias("summary_density"), (F.col("node_id") % 4).alias("n_claims"), F.when(F.col("node_id") % 3 == 0, "silo").otherwise("cluster").alias("scope"))), "quality").select("node_id", "quality", "rejected"),
        "SELECT node_id, round(0.25 * heat_score + 0.30 * confidence + 0.15 * least(1, age_hours / 300) + 0.20 * heat_score + 0.10 * 0.5, 6) AS quality, node_id % 4 = 0 AND node_id % 3 <> 0 AS rejected FROM nodes",
    ),
    "a19_membership_drift": (
        lambda t: r6(A.membership_drift(_members(t, 1), _members(t, 2), "chain_id"), "jaccard"),
        """SELECT chain_id, round(CAST(count(*) FILTER (node_id % 5 >= 2) AS DOUBLE) / count(*), 6) AS jaccard, CAST(count(*) FILTER (node_id % 5 >= 2) AS DOUBLE) / count(*) < 0.8 AS drifted,
        sha256(string_agg(CAST(node_id AS VARCHAR), ',' ORDER BY node_id)) AS fingerprint_before, sha256(coalesce(string_agg(CAST(node_id AS VARCHAR), ',' ORDER BY node_id) FILTER (node_id % 5 >= 2), '')) AS fingerprint FROM versions WHERE node_id % 5 >= 1 GROUP BY 1""",
    ),
    "a26_community_stability": (
        lambda t: r6(A.community_stability(t.vectors.select("node_id", "label", F.lit(0).alias("run")).union(t.vectors.select("node_id", F.when(F.col("node_id") % 9 == 0, -1).otherwise(F.col("label")), F.lit(1)))), "stability"),
        """, r AS (SELECT count(DISTINCT label) AS a, count(DISTINCT CASE WHEN node_id % 9 = 0 THEN -1 ELSE label END) AS b FROM vectors)
        SELECT round(avg(CASE WHEN node_id % 9 = 0 AND label <> -1 THEN 0.0 ELSE 1.0 END), 6) AS stability, count(*) AS n_nodes, (SELECT least(a, b) FROM r) AS fewest, (SELECT greatest(a, b) FROM r) AS most FROM vectors""",
    ),
    "a27_chain_usefulness": (
        _usefulness,
        """, e AS (SELECT event_id, user_id, event_type, value / 100 AS v, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS s FROM events),
        n AS (SELECT d.event_id, 1 / (1 + sqrt(sum(pow(x.v - d.v, 2)))) AS sim FROM e d JOIN e x ON x.user_id = d.user_id AND x.s - d.s BETWEEN 300 AND 3600 WHERE d.event_type = 'view' GROUP BY 1),
        f AS (SELECT DISTINCT d.event_id FROM e d JOIN e x ON x.user_id = d.user_id AND x.s - d.s BETWEEN 300 AND 3600 WHERE d.event_type = 'view' AND x.event_type = 'signup')
        SELECT e.event_id AS delivery, CASE WHEN sim > 0.5 THEN 'useful' WHEN sim IS NOT NULL AND f.event_id IS NOT NULL THEN 'not_useful' ELSE 'unclear' END AS verdict FROM e LEFT JOIN n ON n.event_id = e.event_id LEFT JOIN f ON f.event_id = e.event_id WHERE event_type = 'view'""",
    ),
    "j29_reconcile": (
        lambda t: C.reconcile(t.customer.select(F.col("c_custkey").alias("chain_id"), (F.col("c_custkey") % 6).alias("retries")), t.versions.select("chain_id", F.col("node_id").alias("place"), (F.col("confidence") * 2).alias("confidence"), F.array(F.col("node_id") % 3, F.col("node_id") % 4).alias("premises"))).withColumn("premises", F.array_join(F.col("premises").cast("array<string>"), ",")),
        """, s AS (SELECT chain_id, count(*) AS n, round(avg(confidence * 2), 9) AS m, min(node_id) AS lo, max(node_id) AS hi, array_to_string(list_sort(list_distinct(flatten(list([node_id % 3, node_id % 4])))), ',') AS pr FROM versions GROUP BY 1),
        a AS (SELECT c_custkey AS chain_id, CASE WHEN c_custkey % 6 <= 3 THEN 'retry' WHEN n IS NULL THEN 'archive' ELSE 'rebuild' END AS action, n, m, lo, hi, pr FROM customer LEFT JOIN s ON chain_id = c_custkey)
        SELECT chain_id, action, CASE WHEN action = 'rebuild' THEN n END AS n_steps, CASE WHEN action = 'rebuild' THEN lo END AS first, CASE WHEN action = 'rebuild' THEN hi END AS last, CASE WHEN action = 'rebuild' THEN pr END AS premises,
        CASE WHEN action = 'rebuild' THEN CASE WHEN m >= 0.8 THEN 'success' WHEN m >= 0.5 THEN 'partial' ELSE 'failure' END END AS outcome FROM a""",
    ),
    "w1_rrf_fuse": (
        lambda t: W.rrf_fuse(keep_top(_hits(t).select("query_id", F.col("layer").alias("channel"), (F.col("node_id") % 50).alias("node_id"), "score").groupBy("query_id", "channel", "node_id").agg(F.max("score").alias("score")), ["query_id", "channel"], [F.desc("score"), F.col("node_id")], 40)).withColumn(
            "contributions", F.array_join(F.transform(F.map_entries("contributions"), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 1e6).cast("int").cast("string"))), ",")),
        f""", {HITS}, h AS (SELECT query_id, layer AS channel, node_id % 50 AS node_id, max(score) AS score FROM hits GROUP BY ALL),
        k AS (SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY score DESC, node_id) AS rank FROM h),
        f AS (SELECT query_id, node_id, sum(1.0 / (60 + rank)) AS s, count(*) AS n, string_agg(channel || '=' || CAST(round(1e6 / (60 + rank)) AS INT), ',' ORDER BY channel) AS contributions FROM k WHERE rank <= 40 GROUP BY 1, 2), c AS (SELECT query_id, count(DISTINCT channel) AS n FROM k GROUP BY 1),
        z AS (SELECT f.query_id, node_id, round(s / (c.n / 61.0), 9) AS score, f.n AS n_hits, contributions FROM f JOIN c ON f.query_id = c.query_id)
        SELECT query_id, node_id, score, n_hits, contributions, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM z) WHERE rank <= 20""",
    ),
    "w3_batch_supersession": (
        lambda t: W.batch_supersession(*[x.withColumns({"document_id": F.when(F.col("evidence") % 3 > 0, F.col("evidence")), "position": F.col("claim_id") % 1000}) for x in (t.claims.where(F.col("created_at") > ts(MID)), t.claims.where(F.col("created_at") <= ts(MID)))]),
        f""", c AS (SELECT *, created_at > TIMESTAMP '{MID}' AS fresh, CASE WHEN evidence % 3 > 0 THEN evidence END AS document_id, claim_id % 1000 AS position FROM claims),
        w AS (SELECT *, lag(object) OVER x AS po, lag(claim_id) OVER x AS pc, lag(fresh) OVER x AS pf, lag(document_id) OVER x AS pd, lag(position) OVER x AS pp FROM c WINDOW x AS (PARTITION BY silo_id, subject, predicate ORDER BY fresh, created_at, document_id NULLS LAST, position, claim_id))
        SELECT claim_id, 'superseding' AS status, CASE WHEN NOT pf THEN 'node:' || pc WHEN pd IS NOT NULL THEN 'document:' || pd ELSE 'position:' || pp END AS supersedes FROM w WHERE fresh AND po <> object""",
    ),
    "w4_belief_timeline": (
        lambda t: W.belief_timeline(t.versions.union(t.versions.where("node_id % 10 = 0"))),
        """, d AS (SELECT *, confidence - lag(confidence) OVER w AS step, row_number() OVER w AS place, count(*) OVER (PARTITION BY chain_id) AS n FROM versions WINDOW w AS (PARTITION BY chain_id ORDER BY valid_from, node_id)),
        g AS (SELECT chain_id, CASE WHEN coalesce(bool_and(step > 0), false) THEN 'increasing' WHEN coalesce(bool_and(step < 0), false) THEN 'decreasing' WHEN round(max(abs(step)), 9) > 0.2 THEN 'volatile' ELSE 'stable' END AS trend FROM d GROUP BY 1)
        SELECT d.chain_id, node_id, CAST(place AS INT) AS place, CASE WHEN place = n THEN 'current' ELSE 'superseded' END AS status, trend FROM d JOIN g ON g.chain_id = d.chain_id""",
    ),
    "w10_stuck_sessions": (lambda t: W.stuck_sessions(_events(t), 24 * 60, 0.9), STUCK),
    "st8_stuck_stream": (
        lambda t: _streamed(t, lambda s: C.stuck_stream(s.select("user_id", "event_id", "ts", F.concat(F.lit("query about "), "event_type").alias("text"), F.col("event_type").isin("purchase", "signup").alias("is_write")), 24 * 3600, alike=0.9), "stuck", "user_id long, event_id long"),
        STUCK,
    ),
    "w11_prewarm_queue": (
        lambda t: W.prewarm_queue(t.nodes, t.nodes.where("node_id % 2 = 0").select("node_id", (F.col("confidence") / 4).alias("heat")), t.nodes.select("node_id", (F.col("node_id") % 50).alias("warmed_hours")), cutoff_hours=20),
        """, e AS (SELECT node_id, round(least(1, heat_score + CASE WHEN node_id % 2 = 0 THEN confidence / 4 ELSE 0 END), 6) AS effective FROM nodes WHERE state = 'ACTIVE')
        SELECT node_id, effective FROM e WHERE effective >= 0.33 AND node_id % 50 > 20 ORDER BY effective DESC, node_id LIMIT 100""",
    ),
    "t14_chain_match": (
        lambda t: C.chain_match((s := stepped(t)).where("node_id % 20 = 0"), s, t.vectors.where("node_id % 3 <> 1").select("node_id"), 5, 0.4, 0.25, 0.4),
        f""", {DTW}, {knn('a.node_id % 20 = 0', 5, -1)}, m AS (SELECT query_id, n.node_id, score, rank, CASE WHEN score >= 0.4 THEN 'cold' WHEN score >= 0.25 AND round({SAME}, 9) >= 0.4 THEN 'warm' ELSE 'none' END AS match
        FROM near n JOIN st x ON x.node_id = query_id JOIN st y ON y.node_id = n.node_id), f AS (SELECT query_id, min(rank) FILTER (match <> 'none' AND node_id % 3 <> 1) AS first FROM m GROUP BY 1)
        SELECT m.query_id, node_id, score, match, coalesce(rank = first, false) AS taken FROM m JOIN f ON f.query_id = m.query_id""",
    ),
    "f16_edge_chain_confidence": (
        lambda t: r6(t.edges.groupBy("src").agg(F.sort_array(F.collect_list("weight")).alias("w")).select("src", *[X.edge_chain_confidence("w", kind).alias(name) for kind, name in (("multiplicative", "product"), ("minimum", "least"), ("geometric_mean", "mean"))]), "product", "least", "mean"),
        """SELECT src, round(list_product(w), 6) AS product, round(list_min(w), 6) AS least, round(pow(list_product(w), 1.0 / len(w)), 6) AS mean FROM (SELECT src, list_sort(list(weight)) AS w FROM edges GROUP BY 1)""",
    ),
    "f17_dtw_similarity": (
        lambda t: r6((s := stepped(t)).alias("x").join(s.select((F.col("node_id") - 2).alias("node_id"), "steps").alias("y"), "node_id").select("node_id", M.dtw_of("x.steps", "y.steps").alias("similarity")), "similarity"),
        f", {DTW} SELECT x.node_id, round({SAME}, 6) AS similarity FROM st x JOIN st y ON y.node_id = x.node_id + 2",
    ),
    "g10_chain_pointers": (
        _pointers,
        """, v AS (SELECT *, first_value(node_id) OVER w AS root, row_number() OVER w AS place, CAST(node_id % 11 = 0 AS INT) AS grp FROM versions WINDOW w AS (PARTITION BY chain_id ORDER BY valid_from, node_id)),
        g AS (SELECT root, arg_max(node_id, place) AS head, count(*) AS length, bool_and(chain_id % 3 = 0) AS done, arg_min(grp, place) AS g0 FROM v GROUP BY 1),
        o AS (SELECT v.root, count(*) FILTER (grp <> g0) AS other, arg_min(node_id, place) FILTER (grp <> g0) AS gap FROM v JOIN g ON g.root = v.root GROUP BY 1)
        SELECT 'chain' AS kind, root, head, CAST(length AS VARCHAR) AS note FROM g UNION ALL SELECT CASE WHEN done THEN 'terminal' ELSE 'gap' END, g.root, head, coalesce(CAST(gap AS VARCHAR), '-') FROM g JOIN o ON o.root = g.root WHERE done OR other > 0""",
    ),
    "g12_provenance": (
        lambda t: (lambda e, ids: G.provenance(e, ids).withColumn("way", F.lit("up")).union(G.provenance(e, ids, up=False, kinds=["DERIVED_FROM"]).withColumn("way", F.lit("down"))))(
            _tree(t).withColumn("edge_type", F.lit("DERIVED_FROM")), t.orders.where("o_orderkey % 40 = 7").select(F.col("o_orderkey").alias("id"))),
        """WITH RECURSIVE e AS (SELECT DISTINCT o_orderkey AS src, o_orderkey // 3 AS dst FROM orders WHERE o_orderkey > 0), w(id, hops) AS (SELECT o_orderkey, 0 FROM orders WHERE o_orderkey % 40 = 7 UNION SELECT dst, hops + 1 FROM w JOIN e ON src = id WHERE hops < 10),
        d(id, hops) AS (SELECT o_orderkey, 0 FROM orders WHERE o_orderkey % 40 = 7 UNION SELECT src, hops + 1 FROM d JOIN e ON dst = id WHERE hops < 10)
        SELECT id, CAST(min(hops) AS INT) AS hops, id NOT IN (SELECT src FROM e) AS is_end, 'up' AS way FROM w GROUP BY id UNION ALL SELECT id, CAST(min(hops) AS INT), id NOT IN (SELECT dst FROM e), 'down' FROM d GROUP BY id""",
    ),
    "g13_stale_interior": (
        lambda t: G.stub_stale(t.versions.withColumn("content", F.col("node_id").cast("string")), 5, 3).select("node_id", "content", "stub", "supersedes_id"),
        """, w AS (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY valid_from DESC, node_id DESC) - 1 AS behind, row_number() OVER (PARTITION BY chain_id ORDER BY valid_from, node_id) AS place FROM versions)
        SELECT node_id, CASE WHEN behind > 5 AND place <= 3 THEN NULL ELSE CAST(node_id AS VARCHAR) END AS content, behind > 5 AND place <= 3 AS stub, supersedes_id FROM w""",
    ),
    "g14_causal_closure": (
        lambda t: r6(G.causal_closure(_causes(t)), "w").withColumn("lineage", F.array_join(F.col("lineage").cast("array<string>"), ",")),
        """WITH o AS (SELECT o_orderkey AS id, o_custkey AS src, o_custkey + o_orderkey % 3 + 1 AS dst, round((o_orderkey % 10 + 1) / 11, 9) AS w FROM orders),
        c AS (SELECT src, dst, w, [id] AS l FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY w DESC, id) AS k FROM o) WHERE k = 1),
        s2 AS (SELECT a.src, b.dst, round(a.w * b.w, 9) AS w, list_concat(a.l, b.l) AS l FROM c a JOIN c b ON a.dst = b.src WHERE a.src <> b.dst), p2 AS (SELECT src, dst, w, l FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY w DESC, l) AS k FROM s2 WHERE w >= 0.5) WHERE k = 1),
        s3 AS (SELECT a.src, b.dst, round(a.w * b.w, 9) AS w, list_concat(a.l, b.l) AS l FROM p2 a JOIN c b ON a.dst = b.src WHERE a.src <> b.dst), p3 AS (SELECT src, dst, w, l FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY w DESC, l) AS k FROM s3 WHERE w >= 0.5) WHERE k = 1),
        z AS (SELECT src, dst, w, l FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY w DESC, l) AS k FROM (SELECT * FROM p2 UNION ALL SELECT * FROM p3)) WHERE k = 1)
        SELECT src, dst, round(w, 6) AS w, array_to_string(l, ',') AS lineage FROM z WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.src = z.src AND c.dst = z.dst)""",
    ),
    "g16_tombstone_edges": (
        _timed_edges,
        """, e AS (SELECT CAST(src AS VARCHAR) || '/' || CAST(dst AS VARCHAR) || '/' || edge_type AS id, * FROM edges), h AS (SELECT * FROM e WHERE edge_type = 'CONTRADICTS' AND round(weight, 9) < 0.95 AND src * 37 % 100 < 50)
        SELECT id AS edge_id, 'rule' AS why FROM h UNION ALL SELECT DISTINCT CAST(src AS VARCHAR) || '/' || CAST(dst AS VARCHAR) || '/SUPPORTS', 'derived' FROM h""",
    ),
    "g18_causal_chains": (
        lambda t: G.causal_chains(_tree(t).withColumn("edge_type", F.lit("CAUSES")), t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("kind"))),
        _walk_patterns(),
    ),
    "g18_co_occurrence": (
        lambda t: G.co_occurrence(t.claims.select("evidence", F.concat("predicate", F.lit("="), "object").alias("kind"))),
        """, k AS (SELECT DISTINCT evidence, predicate || '=' || object AS kind FROM claims)
        SELECT sha256(x.kind || '|' || y.kind) AS pattern_id, x.kind AS a, y.kind AS b, count(*) AS frequency FROM k x JOIN k y ON x.evidence = y.evidence AND x.kind < y.kind GROUP BY x.kind, y.kind HAVING count(*) >= 2""",
    ),
    "l3_demote_facts": (
        _demoted,
        """, g AS (SELECT silo_id, subject, predicate, object, count(DISTINCT evidence) AS n FROM claims GROUP BY ALL),
        d AS (SELECT claim_id, c.subject, round(greatest(0.1, confidence - 0.1), 6) AS confidence FROM claims c JOIN g ON c.silo_id = g.silo_id AND c.subject = g.subject AND c.predicate = g.predicate AND c.object = g.object WHERE n < 3)
        SELECT claim_id AS id, 'demote' AS action, confidence FROM d UNION ALL SELECT -subject, CASE WHEN (SELECT count(DISTINCT evidence) FROM claims c WHERE c.subject = s.subject) % 5 < 3 THEN 'tombstone' ELSE 'stale' END, NULL FROM (SELECT DISTINCT subject FROM d) s""",
    ),
    "l4_apply_supersession": (
        _superseding,
        f""", p AS (SELECT w.node_id AS winner, l.node_id AS loser FROM nodes w JOIN nodes l ON l.node_id = w.node_id - 5 WHERE w.node_id % 3 = 0 AND w.state = 'ACTIVE' AND l.state = 'ACTIVE'),
        ok AS (SELECT * FROM p WHERE winner % 2 <> 0)
        SELECT node_id, CASE WHEN winner IS NULL THEN state ELSE 'SUPERSEDED' END AS state, winner AS superseded_by, CASE WHEN winner IS NOT NULL THEN '{NOW}' END AS valid_to, winner AS edge_from FROM nodes LEFT JOIN ok ON loser = node_id""",
    ),
    "l7_retention_sweep": (
        lambda t: L.retention_sweep(t.nodes, t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") * 2).alias("chain_id")), t.customer.select(F.col("c_custkey").alias("chain_id")), 30),
        """, live AS (SELECT *, row_number() OVER (PARTITION BY silo_id ORDER BY age_hours, node_id) AS k FROM nodes WHERE state <> 'TOMBSTONED')
        SELECT node_id AS id, 'tombstone' AS action FROM live WHERE k > 30 OR CASE decay_class WHEN 'ephemeral' THEN age_hours >= 24 WHEN 'standard' THEN age_hours >= 168 AND heat_score < 0.3 WHEN 'durable' THEN age_hours >= 720 AND heat_score < 0.2 ELSE false END
        UNION ALL SELECT node_id, 'delete' FROM nodes WHERE state = 'TOMBSTONED' AND age_hours > 168 UNION ALL SELECT o_orderkey, 'tombstone_summary' FROM orders WHERE o_custkey * 2 NOT IN (SELECT c_custkey FROM customer)""",
    ),
    "l8_forget": (
        _forgotten,
        """, g AS (SELECT node_id FROM nodes WHERE toxic = 1 AND node_id % 2 <> 0 AND state <> 'TOMBSTONED')
        SELECT 'node' AS kind, node_id AS id, state FROM nodes WHERE node_id NOT IN (SELECT node_id FROM g) UNION ALL SELECT 'edges', src, CAST(count(*) AS VARCHAR) FROM edges WHERE src NOT IN (SELECT node_id FROM g) AND dst NOT IN (SELECT node_id FROM g) GROUP BY src""",
    ),
    "l9_erase_audit": (
        _erased,
        """, i AS (SELECT -doc_id AS id FROM labels WHERE toxic = 1 UNION SELECT doc_id * 2 FROM labels WHERE toxic = 1), g AS (SELECT id FROM i UNION SELECT src FROM edges WHERE dst IN (SELECT id FROM i)), n AS (SELECT DISTINCT node_id FROM nodes)
        SELECT *, CASE WHEN n_found = n_asked THEN 'completed' WHEN n_found > 0 THEN 'partial' ELSE 'failed' END AS status FROM (SELECT (SELECT count(*) FROM i) AS n_asked, (SELECT count(*) FROM i WHERE id IN (SELECT node_id FROM n)) AS n_found, (SELECT count(*) FROM g WHERE id IN (SELECT node_id FROM n)) AS n_erased,
        (SELECT count(*) FROM nodes WHERE node_id NOT IN (SELECT id FROM g)) AS n_nodes, (SELECT count(*) FROM edges WHERE src NOT IN (SELECT id FROM g) AND dst NOT IN (SELECT id FROM g)) AS n_edges)""",
    ),
    "l16_compact_chains": (
        lambda t: (lambda s: s[0].join(s[1], "chain_id"))(L.compact_chains(t.versions.select("chain_id", F.col("node_id").alias("place"), F.col("node_id").cast("string").alias("text")))),
        """, s AS (SELECT chain_id, count(*) AS n_steps, sha256(CAST(chain_id AS VARCHAR) || '|' || string_agg(CAST(node_id AS VARCHAR), ' -> ' ORDER BY node_id)) AS summary_id,
        string_agg(CAST(node_id AS VARCHAR), ' -> ' ORDER BY node_id) AS summary FROM versions GROUP BY 1 HAVING count(*) >= 3) SELECT *, 'TOMBSTONED' AS state, summary_id AS replaced_by FROM s""",
    ),
    "l20_close_sessions": (
        lambda t: (lambda s: s[0].select("session", F.lit(-1).cast("long").alias("earlier"), F.lit(-1).cast("long").alias("later")).union(s[1]))(L.close_sessions(
            t.conversations.groupBy(F.col("conv_id").alias("session")).agg(F.max("turn").alias("n")).select("session", (ts("2024-01-31") - F.make_dt_interval(hours=F.col("n").cast("int"))).alias("last_seen"), (F.col("session") % 4 != 0).alias("open")),
            t.conversations.select(F.col("conv_id").alias("session"), F.col("turn").alias("chain"), F.col("turn").alias("created")), ts("2024-01-31"), 150)),
        """, s AS (SELECT conv_id, max(turn) AS n FROM conversations GROUP BY 1), c AS (SELECT conv_id FROM s WHERE conv_id % 4 <> 0 AND n * 60 > 150)
        SELECT conv_id AS session, CAST(-1 AS BIGINT) AS earlier, CAST(-1 AS BIGINT) AS later FROM c UNION ALL SELECT DISTINCT a.conv_id, a.turn, b.turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn WHERE a.conv_id IN (SELECT conv_id FROM c)""",
    ),
    "l22_upsert_findings": (
        _findings,
        """, c AS (SELECT chain_id, max(node_id) AS body, count(*) AS version FROM versions WHERE node_id % 2 = 0 GROUP BY 1), n AS (SELECT chain_id, max(node_id) FILTER (node_id % 2 = 1) AS body, count(*) FILTER (node_id % 5 <> 0 AND node_id % 7 = 0) AS k FROM versions GROUP BY 1),
        g AS (SELECT * FROM n WHERE body IS NOT NULL AND k > 0)
        SELECT 'now' AS part, g.chain_id, CAST(g.body AS VARCHAR) AS body, k AS n_claims, coalesce(version, 0) + 1 AS version FROM g LEFT JOIN c ON c.chain_id = g.chain_id UNION ALL SELECT 'now', chain_id, CAST(body AS VARCHAR), NULL, version FROM c WHERE chain_id NOT IN (SELECT chain_id FROM g)
        UNION ALL SELECT 'was', c.chain_id, sha256(CAST(c.body AS VARCHAR)), NULL, version FROM c JOIN g ON g.chain_id = c.chain_id""",
    ),
}
