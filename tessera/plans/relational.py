"""Queries over the derived tables with their oracle SQL: scans, filters, joins, aggregates, windows, sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import exprs
from tessera.operators import aggregates as A
from tessera.operators import filters as P
from tessera.operators import joins as J
from tessera.operators import lifecycle as L
from tessera.operators import scans as S
from tessera.operators import sets as U
from tessera.operators import windows as W
from tessera.sources.fixtures import Tables

MID = "1998-01-01 00:00:00"


def ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


def r6(df, *names: str):
    """Doubles rounded for comparison."""
    return df.withColumns({n: F.round(n, 6) for n in names})


def _upsert(t: Tables):
    base = t.orders.select(F.col("o_custkey").alias("k"), "o_orderkey", "o_orderdate")
    return S.upsert(base.where("o_orderkey % 2 = 0"), base.where("o_orderkey % 2 = 1"), ["k"], "o_orderkey").select("k", "o_orderkey")


def _observations(t: Tables):
    batch = t.orders.select(F.when(F.col("o_orderkey") % 10 == 0, None).otherwise(F.col("o_custkey")).alias("document_id"), F.col("o_orderkey").alias("position"))
    nodes = t.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("document_id"))
    return S.ingest_observations(nodes, batch).groupBy("status").agg(F.count("*").alias("n"))


def _hits(t: Tables):
    """Nodes as hits of a few queries."""
    return t.nodes.select((F.col("node_id") % 5).alias("query_id"), "node_id", "layer", "state", "confidence", "silo_id", "agent_id", F.col("heat_score").alias("score"), "age_hours")


HITS = "hits AS (SELECT node_id % 5 AS query_id, node_id, layer, state, confidence, silo_id, agent_id, heat_score AS score, age_hours FROM nodes)"


def _fact_pairs(t: Tables):
    """Each claim with the one before it on its subject."""
    w = Window.partitionBy("subject").orderBy("claim_id")
    cols = ["claim_id", "evidence", "agent_id", "created_at", "source_tier"]
    pairs = t.claims.select("subject", F.lag(F.struct(*cols)).over(w).alias("a"), F.struct(*cols).alias("b")).where("a is not null")
    hours = lambda s: F.timestamp_diff("HOUR", F.lit("1995-01-01").cast("timestamp_ntz"), F.col(f"{s}.created_at"))
    named = [c for s in "ab" for c in (F.col(f"{s}.claim_id").alias(s), F.col(f"{s}.evidence").alias(f"doc_{s}"), F.col(f"{s}.agent_id").alias(f"agent_{s}"), hours(s).alias(f"hours_{s}"), F.col(f"{s}.source_tier").alias(f"tier_{s}"))]
    return pairs.select("subject", *named)


PAIRS = """pairs AS (
  SELECT subject, a, claim_id AS b, doc_a, evidence AS doc_b, agent_a, agent_id AS agent_b, date_diff('hour', TIMESTAMP '1995-01-01', t_a) AS hours_a, date_diff('hour', TIMESTAMP '1995-01-01', created_at) AS hours_b, tier_a, source_tier AS tier_b
  FROM (SELECT *, lag(claim_id) OVER w AS a, lag(evidence) OVER w AS doc_a, lag(agent_id) OVER w AS agent_a, lag(created_at) OVER w AS t_a, lag(source_tier) OVER w AS tier_a FROM claims WINDOW w AS (PARTITION BY subject ORDER BY claim_id))
  WHERE a IS NOT NULL)"""


def _conflict_pairs(t: Tables):
    p = _fact_pairs(t)
    days = lambda s: F.floor((F.lit(62000) - F.col(f"hours_{s}")) / 24)
    return p.select("a", "b", "agent_a", "agent_b", "tier_a", "tier_b", days("a").alias("days_a"), days("b").alias("days_b"), (F.col("doc_a") % 4).alias("n_a"), (F.col("doc_b") % 4).alias("n_b"))


def _members(t: Tables, low: int):
    return t.versions.where(f"node_id % 5 >= {low}").groupBy("chain_id").agg(F.collect_set("node_id").alias("members"))


def _source_rules(t: Tables):
    rows = [("https://*.example.org/*", "authoritative", 5), ("http*://m.*", "community", 9), ("*example.com/en/*", "validated", 1)]
    return t.spark.createDataFrame(rows, "pattern string, tier string, priority int")


CASES = {
    # scans
    "s1_list_active": (
        lambda t: S.list_active(t.nodes, 20, 10),
        """, live AS (SELECT * FROM nodes WHERE state = 'ACTIVE' AND length(trim(content)) > 0)
        SELECT node_id, silo_id, age_hours, (SELECT count(*) FROM live) AS total FROM live ORDER BY age_hours, node_id LIMIT 20 OFFSET 10""",
    ),
    "s2_get_nodes": (
        lambda t: S.get_nodes(t.nodes, t.labels.where("toxic = 1").select(F.col("doc_id").alias("node_id"))).select("node_id", "layer"),
        "SELECT node_id, layer FROM nodes WHERE node_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    ),
    "s3_upsert": (_upsert, "SELECT o_custkey AS k, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey"),
    "s4_ingest_observations": (
        _observations,
        """, b AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_custkey END AS d, o_orderkey AS p FROM orders),
        s AS (SELECT d, row_number() OVER (PARTITION BY d ORDER BY p) AS n FROM b)
        SELECT CASE WHEN d IS NOT NULL AND (n > 1 OR EXISTS (SELECT 1 FROM customer WHERE c_custkey = d AND c_custkey % 3 = 0)) THEN 'skipped' ELSE 'created' END AS status, count(*) AS n FROM s GROUP BY 1""",
    ),
    "s8_pending_embedding": (
        lambda t: S.pending_embedding(t.nodes, t.vectors.where("label < 6")).select("node_id", F.length("content").cast("long").alias("n_chars")),
        "SELECT node_id, CAST(least(length(content), 8000) AS BIGINT) AS n_chars FROM nodes WHERE length(content) >= 10 AND node_id NOT IN (SELECT node_id FROM vectors WHERE label < 6)",
    ),
    "s10_lookup_by_uri": (
        lambda t: S.lookup_by_uri(t.pages, t.pages.where("page_id % 9 = 0").select("url")).select("page_id", "url"),
        "SELECT page_id, url FROM pages WHERE url IN (SELECT url FROM pages WHERE page_id % 9 = 0)",
    ),
    # filters
    "p2_filter_all_tags": (
        lambda t: P.filter_all_tags(t.nodes.select("node_id", F.array("layer", "decay_class", "lang").alias("tags")), ["memory", "en"]).select("node_id"),
        "SELECT node_id FROM nodes WHERE layer = 'memory' AND lang = 'en'",
    ),
    "p3_filter_agents": (lambda t: P.filter_agents(t.nodes, None, [1, 2, 3]).select("node_id"), "SELECT node_id FROM nodes WHERE agent_id NOT IN (1, 2, 3)"),
    "p4_filter_inactive": (lambda t: P.filter_inactive(t.nodes).select("node_id"), "SELECT node_id FROM nodes WHERE state IS NULL OR state = 'ACTIVE'"),
    "p5_as_of": (
        lambda t: P.as_of(t.versions, ts(MID)).select("node_id", "chain_id"),
        f"SELECT node_id, chain_id FROM versions WHERE valid_from <= TIMESTAMP '{MID}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{MID}')",
    ),
    "p7_temporal_status": (
        lambda t: P.temporal_status(t.orders.select((F.col("o_orderkey") * 2).alias("node_id")), t.versions, ts(MID)),
        f"""SELECT i.node_id, CASE WHEN v.node_id IS NULL THEN 'node_not_found' WHEN valid_from > TIMESTAMP '{MID}' THEN 'not_yet_valid'
        WHEN valid_to IS NOT NULL AND valid_to <= TIMESTAMP '{MID}' THEN 'node_expired' ELSE 'valid' END AS status
        FROM (SELECT o_orderkey * 2 AS node_id FROM orders) i LEFT JOIN versions v ON v.node_id = i.node_id""",
    ),
    "p8_filter_created": (
        lambda t: P.filter_created(t.versions, "valid_to", ts(MID), ts("1999-01-01")).select("node_id"),
        f"SELECT node_id FROM versions WHERE valid_to IS NULL OR valid_to BETWEEN TIMESTAMP '{MID}' AND TIMESTAMP '1999-01-01'",
    ),
    "p9_content_policy": (
        lambda t: P.content_policy(t.nodes).select("node_id", "tier", "shown", "expandable"),
        """SELECT node_id, CASE WHEN heat_score >= 0.66 THEN 'HOT' WHEN heat_score >= 0.33 THEN 'WARM' ELSE 'COLD' END AS tier,
        CASE WHEN heat_score < 0.33 AND length(content) > 200 THEN substr(content, 1, 200) ELSE content END AS shown, heat_score < 0.33 AND length(content) > 200 AS expandable FROM nodes""",
    ),
    "p11_adaptive_threshold": (
        lambda t: P.adaptive_threshold(_hits(t)).select("query_id", "node_id"),
        f", {HITS} SELECT query_id, node_id FROM hits h WHERE score >= greatest(0.5 * (SELECT max(score) FROM hits b WHERE b.query_id = h.query_id), 0.1)",
    ),
    "p12_finding_visible": (
        lambda t: P.finding_visible(t.nodes.select("node_id", F.when(F.col("layer") == "wisdom", "finding").otherwise("node").alias("kind"), F.col("lang").alias("origin"), (F.col("node_id") % 2 == 0).alias("published"))).select("node_id"),
        "SELECT node_id FROM nodes WHERE layer <> 'wisdom' OR node_id % 2 = 0",
    ),
    "p13_trust_gate": (
        lambda t: P.trust_gate(t.nodes.withColumn("conflicted", F.col("node_id") % 17 == 0), 0.3).groupBy("reason").agg(F.count("*").alias("n")),
        "SELECT CASE WHEN node_id % 17 = 0 THEN 'conflict' WHEN coalesce(confidence, 1) < 0.3 THEN 'low_confidence' END AS reason, count(*) AS n FROM nodes GROUP BY 1",
    ),
    "p15_contradiction_ttl": (
        lambda t: P.contradiction_ttl(t.nodes.select("node_id", (F.col("age_hours") % 12).alias("flagged_hours"), F.array(F.col("node_id") + 1, F.col("node_id") + 2).alias("peers"))),
        "SELECT node_id, unnest([node_id + 1, node_id + 2]) AS peer_id FROM nodes WHERE age_hours % 12 BETWEEN 0 AND 1",
    ),
    "p16_edges_among": (
        lambda t: P.edges_among(t.edges, t.supplier.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("id")).union(t.part.where("p_partkey % 2 = 0").select((-F.col("p_partkey")).alias("id")))).select("src", "dst", "edge_type"),
        "SELECT src, dst, edge_type FROM edges WHERE src IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0) AND dst IN (SELECT -p_partkey FROM part WHERE p_partkey % 2 = 0)",
    ),
    # joins
    "j1_corroborate_exact": (
        lambda t: J.corroborate_exact(t.claims).select("claim_id", "n_evidence", "promote"),
        """, g AS (SELECT silo_id, subject, predicate, object, count(DISTINCT evidence) AS n FROM claims GROUP BY ALL)
        SELECT claim_id, n AS n_evidence, n >= 3 AS promote FROM claims c JOIN g ON c.silo_id = g.silo_id AND c.subject = g.subject AND c.predicate = g.predicate AND c.object = g.object""",
    ),
    "j4_spo_conflicts": (
        lambda t: J.spo_conflicts(t.claims),
        """, g AS (SELECT silo_id, subject, predicate, object, count(*) AS n, min(claim_id) AS c FROM claims GROUP BY ALL)
        SELECT a.silo_id, a.subject, a.predicate, a.object AS object_a, a.n AS n_a, a.c AS claim_a, b.object AS object_b, b.n AS n_b, b.c AS claim_b, 'unresolved' AS status
        FROM g a JOIN g b ON a.silo_id = b.silo_id AND a.subject = b.subject AND a.predicate = b.predicate AND a.object <> b.object""",
    ),
    "j5_neighborhood_conflicts": (
        lambda t: J.neighborhood_conflicts(t.supplier.where("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("id")), t.edges),
        """SELECT dst AS other FROM edges WHERE edge_type = 'CONTRADICTS' AND src IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 5 = 0)
        UNION SELECT src FROM edges WHERE edge_type = 'CONTRADICTS' AND dst IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 5 = 0)""",
    ),
    "j6_shared_evidence_peers": (
        lambda t: J.shared_evidence_peers(t.claims),
        "SELECT claim_id, count(*) OVER (PARTITION BY silo_id, evidence) - 1 AS n_peers FROM claims",
    ),
    "j13_epistemic_edges": (
        lambda t: J.epistemic_edges(t.edges).select("src", *[F.array_join(c, ",").alias(c) for c in ("supports", "contradicts", "causes")]),
        """SELECT src, """
        + ", ".join(f"coalesce(array_to_string(list_sort(list(DISTINCT dst) FILTER (edge_type = '{k}')), ','), '') AS {c}" for k, c in (("SUPPORTS", "supports"), ("CONTRADICTS", "contradicts"), ("CAUSES", "causes")))
        + " FROM edges GROUP BY src",
    ),
    "j15_conflict_expand": (
        lambda t: J.conflict_expand(t.part.where("p_size < 20").select((-F.col("p_partkey")).alias("node_id")), t.edges),
        """, h AS (SELECT -p_partkey AS id FROM part WHERE p_size < 20), c AS (SELECT src AS a, dst AS b FROM edges WHERE edge_type = 'CONTRADICTS' UNION SELECT dst, src FROM edges WHERE edge_type = 'CONTRADICTS')
        SELECT DISTINCT b AS other FROM c WHERE a IN (SELECT id FROM h) AND b NOT IN (SELECT id FROM h)""",
    ),
    "j16_belief_contributors": (
        lambda t: J.belief_contributors(t.claims),
        "SELECT silo_id, subject, predicate, count(*) AS n_claims, count(DISTINCT object) AS n_facts, count(DISTINCT agent_id) AS n_agents FROM claims GROUP BY ALL",
    ),
    "j17_agent_stats": (
        lambda t: J.agent_stats(t.claims, t.supplier.select(F.col("s_suppkey").alias("agent_id"))),
        """SELECT s_suppkey AS agent_id, count(claim_id) AS n_claims, count(DISTINCT CASE WHEN claim_id IS NOT NULL THEN (silo_id, subject, predicate, object) END) AS n_facts,
        count(DISTINCT CASE WHEN claim_id IS NOT NULL THEN (silo_id, subject, predicate) END) AS n_beliefs FROM supplier LEFT JOIN claims ON agent_id = s_suppkey GROUP BY 1""",
    ),
    "j18_agents_summary": (
        lambda t: J.agents_summary(t.supplier.select(F.col("s_suppkey").alias("agent_id"), F.when(F.col("s_acctbal") > 0, F.round(F.col("s_acctbal") / 10000, 4)).alias("trust")), t.nodes),
        """SELECT s_suppkey AS agent_id, (SELECT count(*) FROM nodes WHERE agent_id = s_suppkey) AS n_nodes, coalesce(CASE WHEN s_acctbal > 0 THEN round(s_acctbal / 10000, 4) END, 0.5) AS trust FROM supplier""",
    ),
    "j20_entity_corroboration": (
        lambda t: J.entity_corroboration(t.edges),
        "SELECT x.src AS a, y.src AS b, count(*) AS shared FROM edges x JOIN edges y ON x.dst = y.dst AND x.src < y.src WHERE x.edge_type = 'SUPPORTS' AND y.edge_type = 'SUPPORTS' GROUP BY 1, 2",
    ),
    "j27_shared_participation": (
        lambda t: J.shared_participation(t.edges, -1),
        "SELECT dst, count(DISTINCT src) AS n FROM edges WHERE src IN (SELECT src FROM edges WHERE dst = -1) AND dst <> -1 GROUP BY dst HAVING count(DISTINCT src) >= 2",
    ),
    "j31_evidence_accessible": (
        lambda t: J.evidence_accessible(
            t.claims.select(F.col("subject").alias("chain"), F.col("silo_id").alias("session"), "evidence").distinct(), t.claims.where("evidence % 10 <> 0").select(F.col("silo_id").alias("session"), "evidence").distinct()
        ),
        "SELECT subject AS chain FROM claims GROUP BY subject HAVING bool_and(evidence % 10 <> 0)",
    ),
    # aggregates
    "a1_noisy_or": (
        lambda t: t.claims.groupBy("silo_id", "subject").agg(F.round(A.noisy_or("confidence") + 1e-9, 4).alias("joint")),
        "SELECT silo_id, subject, round(1 - product(1 - greatest(0, least(1, confidence))) + 1e-9, 4) AS joint FROM claims GROUP BY ALL",
    ),
    "a2_corroboration_weight": (
        lambda t: r6(A.corroboration_weight(t.claims, ["silo_id", "subject"]), "weight"),
        """, p AS (SELECT silo_id, subject, agent_id, count(*) AS n FROM claims GROUP BY ALL)
        SELECT silo_id, subject, round(1 - exp(-0.5 * sum(1 + 0.5 * (sqrt(n) - 1))), 6) AS weight FROM p GROUP BY ALL""",
    ),
    "a4_consensus_promote": (
        lambda t: A.consensus_promote(t.claims).select("silo_id", "subject", "outcome"),
        """, g AS (SELECT silo_id, subject, count(DISTINCT agent_id) AS n, round(1 - product(1 - greatest(0, least(1, confidence))), 9) AS j FROM claims GROUP BY ALL)
        SELECT silo_id, subject, CASE WHEN n < 2 THEN 'too_few_agents' WHEN j < 0.7 THEN 'low_confidence' ELSE 'promote' END AS outcome FROM g""",
    ),
    "a6_consensus_invalidate": (
        lambda t: A.consensus_invalidate(t.claims, t.orders.where("o_orderkey % 6 = 0").select(F.col("o_orderkey").alias("evidence"))),
        """, h AS (SELECT *, evidence % 6 = 0 AND evidence IN (SELECT o_orderkey FROM orders) AS gone FROM claims),
        g AS (SELECT silo_id, subject, predicate, object, count(DISTINCT CASE WHEN NOT gone THEN evidence END) AS n_left, bool_or(gone) AS lost FROM h GROUP BY ALL)
        SELECT silo_id, subject, predicate, object, n_left, CASE WHEN n_left < 3 THEN 'tombstone' ELSE 'stale' END AS action FROM g WHERE lost""",
    ),
    "a7_synthesis_groups": (
        lambda t: A.synthesis_groups(t.claims, t.claims.where("claim_id % 3 = 0").select("claim_id")),
        "SELECT silo_id, subject, predicate, count(*) AS n_facts, count(DISTINCT evidence) AS n_evidence FROM claims WHERE claim_id % 3 <> 0 GROUP BY ALL HAVING count(*) >= 3 AND count(DISTINCT evidence) >= 3",
    ),
    "a9_centroid": (
        lambda t: A.centroid(t.vectors, "label").select("label", F.posexplode("centroid").alias("i", "v")).select("label", "i", F.round("v", 5).alias("v")),
        """, e AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM vectors)
        SELECT label, CAST(i AS INT) AS i, round(avg(CAST(v AS DOUBLE)), 5) AS v FROM e GROUP BY 1, 2""",
    ),
    "a10_belief_drift": (
        lambda t: r6(
            A.belief_drift(A.centroid(t.vectors.where("node_id % 3 <> 0"), "label"), A.centroid(t.vectors.where("node_id % 3 = 0"), "label"), t.vectors.groupBy("label").agg(F.count("*").alias("n")), "label"), "distance"
        ),
        """, e AS (SELECT label, node_id % 3 = 0 AS now, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM vectors),
        m AS (SELECT label, i, avg(CAST(v AS DOUBLE)) FILTER (now) AS b, avg(CAST(v AS DOUBLE)) FILTER (NOT now) AS a FROM e GROUP BY 1, 2),
        d AS (SELECT label, 1 - sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) AS x FROM m GROUP BY 1)
        SELECT label, round(x, 6) AS distance, CASE WHEN (SELECT count(*) FROM vectors v WHERE v.label = d.label) < 3 THEN 'too_few_facts' WHEN round(x, 9) > 0.15 THEN 'drifted' ELSE 'stable' END AS reason FROM d""",
    ),
    "a12_level_distribution": (
        lambda t: A.level_distribution(t.nodes),
        "SELECT CASE WHEN heat_score >= 0.66 THEN 'FULL' WHEN heat_score >= 0.33 THEN 'WARM' WHEN heat_score >= 0.1 THEN 'STRUCTURE' ELSE 'MINIMAL' END AS level, count(*) AS n FROM nodes GROUP BY 1",
    ),
    "a14_usage_summary": (
        lambda t: A.usage_summary(t.events.withColumn("ts", F.date_trunc("second", "ts")), ts("2024-01-15")),
        "SELECT event_type, count(*) AS n_calls, CAST(max(date_trunc('second', ts)) AS VARCHAR) AS last_used FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1",
    ),
    "a20_recount_corroboration": (
        lambda t: t.claims.groupBy("silo_id", "subject", "predicate", "object").agg(F.count_distinct("evidence").alias("n_evidence")),
        "SELECT silo_id, subject, predicate, object, count(DISTINCT evidence) AS n_evidence FROM claims GROUP BY ALL",
    ),
    "a21_reflection_suggested": (
        lambda t: r6(A.reflection_suggested(t.nodes), "avg_confidence"),
        "SELECT silo_id, round(avg(CASE WHEN coalesce(confidence, 0) = 0 THEN 1.0 ELSE confidence END), 6) AS avg_confidence, round(avg(CASE WHEN coalesce(confidence, 0) = 0 THEN 1.0 ELSE confidence END), 9) < 0.4 AS suggest FROM nodes GROUP BY 1",
    ),
    "a22_volatile_topics": (
        lambda t: A.volatile_topics(t.versions),
        """, w AS (SELECT chain_id, node_id, count(*) OVER (PARTITION BY chain_id) - 1 AS n, row_number() OVER (PARTITION BY chain_id ORDER BY valid_from DESC, node_id DESC) AS k FROM versions)
        SELECT chain_id, n AS n_superseded, node_id AS head FROM w WHERE k = 1 AND n >= 3""",
    ),
    "a23_knowledge_gaps": (
        lambda t: A.knowledge_gaps(t.events.select(F.concat(F.lit(" "), F.upper("event_type"), F.col("user_id") % 20).alias("text"), (F.col("event_id") % 3 == 0).alias("answered"), F.col("event_id").alias("asked")), 5),
        """SELECT sha256(lower(trim(' ' || upper(event_type) || CAST(user_id % 20 AS VARCHAR)))) AS query_hash, count(*) AS n_asked, min(event_id) AS first_asked, max(event_id) AS last_asked
        FROM events WHERE event_id % 3 <> 0 GROUP BY 1 HAVING count(*) >= 5""",
    ),
    "a24_top_cited": (lambda t: A.top_cited(t.edges), "SELECT dst, count(*) AS n_citations FROM edges GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"),
    "a25_silos_with_pending_work": (
        lambda t: A.silos_with_pending_work(t.nodes),
        """SELECT DISTINCT silo_id, 'embed' AS kind FROM nodes WHERE length(content) >= 10 AND quality IS NULL UNION SELECT silo_id, 'decay' FROM nodes WHERE layer = 'memory' AND age_hours > 1
        UNION SELECT silo_id, 'tombstone' FROM nodes WHERE state = 'SUPERSEDED'""",
    ),
    "a28_dashboard_metrics": (
        lambda t: A.dashboard_metrics(t.nodes),
        "SELECT count(*) AS total, count(*) FILTER (age_hours < 24) AS last_day, count(*) FILTER (age_hours < 168) AS last_week, "
        + ", ".join(f"count(*) FILTER (layer = '{x}') AS n_{x}" for x in ("memory", "knowledge", "wisdom", "intelligence")) + " FROM nodes",
    ),
    # windows
    "w2_top_per_group": (
        lambda t: P.keep_top(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank"),
        "SELECT o_custkey, o_orderkey, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3",
    ),
    "w5_keep_newest": (
        lambda t: W.keep_newest(t.nodes, "silo_id", [F.col("age_hours"), F.col("node_id")], 5).select("silo_id", "node_id"),
        "SELECT silo_id, node_id FROM (SELECT *, row_number() OVER (PARTITION BY silo_id ORDER BY age_hours, node_id) AS k FROM nodes) WHERE k > 5",
    ),
    "w6_resolve_conflicts": (
        lambda t: W.resolve_conflicts(_conflict_pairs(t)),
        f""", {PAIRS}, c AS (SELECT a, b, agent_a, agent_b, tier_a, tier_b, floor((62000 - hours_a) / 24) AS da, floor((62000 - hours_b) / 24) AS db, doc_a % 4 AS na, doc_b % 4 AS nb FROM pairs),
        s AS (SELECT *, round(CASE tier_a WHEN 'authoritative' THEN 1.0 WHEN 'validated' THEN 0.85 WHEN 'community' THEN 0.6 ELSE 0.4 END * ln(1 + greatest(1, na)) / (1 + da), 9) AS sa,
          round(CASE tier_b WHEN 'authoritative' THEN 1.0 WHEN 'validated' THEN 0.85 WHEN 'community' THEN 0.6 ELSE 0.4 END * ln(1 + greatest(1, nb)) / (1 + db), 9) AS sb FROM c),
        w AS (SELECT *, CASE WHEN sa = sb THEN CASE WHEN da = db THEN a < b WHEN agent_a = agent_b THEN da < db ELSE da > db END ELSE sa > sb END AS wins FROM s)
        SELECT CASE WHEN wins THEN a ELSE b END AS winner, CASE WHEN wins THEN b ELSE a END AS loser, CASE WHEN sa = sb THEN 'tie' ELSE 'score' END AS rationale FROM w""",
    ),
    # sets
    "u1_markers_by_silo": (
        lambda t: U.markers_by_silo(t.nodes.where("node_id % 17 = 0").select("node_id", "silo_id"), t.nodes.where("node_id % 19 = 0").select("node_id", "silo_id")),
        "SELECT node_id, silo_id, 'contradiction' AS kind FROM nodes WHERE node_id % 17 = 0 UNION ALL SELECT node_id, silo_id, 'stale_commitment' FROM nodes WHERE node_id % 19 = 0",
    ),
    "u2_markers_about": (
        lambda t: U.markers_about(t.nodes.select(F.col("node_id").alias("marker_id"), F.array(F.col("node_id") + 1, F.col("node_id") * 2).alias("about_ids")), t.labels.where("toxic = 1").select(F.col("doc_id").alias("id"))),
        """SELECT node_id AS marker_id FROM nodes WHERE node_id + 1 IN (SELECT doc_id FROM labels WHERE toxic = 1) OR node_id * 2 IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    ),
    "u5_stale_tags": (
        lambda t: U.stale_tags(t.part.select(F.col("p_type").alias("tag")), t.part.where("p_size > 49 and p_partkey < 400").select(F.col("p_type").alias("tag"))),
        "SELECT DISTINCT p_type AS tag FROM part EXCEPT SELECT p_type FROM part WHERE p_size > 49 AND p_partkey < 400",
    ),
    "u6_shared_members": (
        lambda t: U.shared(t.orders.select(F.col("o_custkey").alias("id")), t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("id")), "id"),
        "SELECT o_custkey AS id FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0",
    ),
    # lifecycle
    "l1_promote_claims": (
        lambda t: r6(L.promote_claims(t.claims), "confidence"),
        """, g AS (SELECT silo_id, subject, predicate, object, count(DISTINCT evidence) AS n FROM claims GROUP BY ALL)
        SELECT claim_id, c.silo_id, n AS n_evidence, round(least(1, confidence + 0.1 * (n - 2)), 6) AS confidence FROM claims c
        JOIN g ON c.silo_id = g.silo_id AND c.subject = g.subject AND c.predicate = g.predicate AND c.object = g.object WHERE n >= 3""",
    ),
    "l2_promote_rules": (
        lambda t: L.promote_rules(t.claims),
        """, w AS (SELECT *, greatest(0, least(1, confidence)) * CASE source_tier WHEN 'authoritative' THEN 1.0 WHEN 'validated' THEN 0.85 WHEN 'community' THEN 0.6 ELSE 0.4 END AS x FROM claims),
        g AS (SELECT silo_id, evidence, 1 - product(1 - x) AS j, bool_or(source_tier = 'authoritative') AS a, count(*) AS n FROM w GROUP BY 1, 2)
        SELECT claim_id, CASE WHEN source_tier = 'authoritative' AND round(confidence, 9) >= 0.7 THEN 'R1' WHEN n > 1 AND a AND round(j, 9) >= 0.8 THEN 'R2' ELSE 'none' END AS rule
        FROM claims c JOIN g ON c.silo_id = g.silo_id AND c.evidence = g.evidence""",
    ),
    "l5_decay_memory": (lambda t: r6(L.decay_memory(t.nodes), "confidence"), "SELECT node_id, round(greatest(0, least(1, confidence * pow(0.95, age_hours))), 6) AS confidence FROM nodes WHERE layer = 'memory' AND age_hours > 1"),
    "l6_expired_memory": (
        lambda t: L.expired_memory(t.nodes, {"ephemeral": 48, "standard": 400}),
        "SELECT node_id, decay_class, age_hours FROM nodes WHERE age_hours > CASE decay_class WHEN 'ephemeral' THEN 48 WHEN 'standard' THEN 400 END",
    ),
    "l10_review_weak_links": (
        lambda t: L.review_weak_links(t.nodes.select(F.col("node_id").alias("a"), (F.col("node_id") * 3).alias("b"), F.col("confidence").alias("weight"), F.col("heat_score").alias("heat"), "age_hours"), t.nodes).groupBy("action").agg(F.count("*").alias("n")),
        """, j AS (SELECT l.confidence AS weight, l.heat_score AS heat, l.age_hours, l.state AS sa, r.state AS sb FROM nodes l LEFT JOIN nodes r ON r.node_id = l.node_id * 3)
        SELECT CASE WHEN sa = 'TOMBSTONED' AND coalesce(sb = 'TOMBSTONED', true) THEN 'drop' WHEN sa = 'SUPERSEDED' OR sb = 'SUPERSEDED' THEN 'demote' WHEN weight >= 0.6 AND heat >= 0.3 THEN 'promote'
        WHEN age_hours > 720 THEN 'prune' ELSE 'keep' END AS action, count(*) AS n FROM j GROUP BY 1""",
    ),
    "l12_decay_patterns": (
        lambda t: r6(L.decay_patterns(t.nodes), "confidence"),
        """SELECT node_id, round(CASE WHEN age_hours > 168 THEN confidence * 0.9 ELSE confidence END, 6) AS confidence,
        CASE WHEN round(CASE WHEN age_hours > 168 THEN confidence * 0.9 ELSE confidence END, 9) < 0.1 THEN 'TOMBSTONED' ELSE 'ACTIVE' END AS state FROM nodes""",
    ),
    "l13_backfill_state": (
        lambda t: L.backfill_state(t.versions, t.versions.where("supersedes_id is not null").select(F.col("supersedes_id").alias("node_id"))),
        "SELECT node_id, CASE WHEN valid_to IS NOT NULL THEN 'SUPERSEDED' ELSE 'ACTIVE' END AS state FROM versions",
    ),
    "l14_confirm_markers": (
        lambda t: L.confirm_markers(t.nodes.select(F.col("node_id").alias("a"), (F.col("node_id") + 1).alias("b")), t.labels.select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"), (F.col("quality") == 1).alias("verdict"), ((F.col("doc_id") % 10) / 10).alias("certainty"))).groupBy("outcome").agg(F.count("*").alias("n")),
        "SELECT CASE WHEN quality = 1 AND node_id % 10 >= 7 THEN 'marker' WHEN quality IS NULL THEN 'pending' ELSE 'cleared' END AS outcome, count(*) AS n FROM nodes GROUP BY 1",
    ),
    "l15_retain": (
        lambda t: L.retain(t.events, "ts", ts("2024-02-01"), 10).groupBy("event_type").agg(F.count("*").alias("n")),
        "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-02-01' - INTERVAL 10 DAY GROUP BY 1",
    ),
    "l21_engagement": (
        lambda t: L.engagement(t.customer.select(F.col("c_custkey").alias("marker_id"), F.col("c_nationkey").alias("about")), t.events.groupBy(F.col("user_id").alias("marker_id")).agg(F.count("*").alias("n_touches")), 70),
        """, n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
        SELECT c_nationkey AS about, count(*) AS n_pending, CASE WHEN max(coalesce(n, 0)) >= 70 THEN 'hard' ELSE 'soft' END AS mode FROM customer LEFT JOIN n ON user_id = c_custkey GROUP BY 1""",
    ),
}
