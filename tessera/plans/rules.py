"""Queries whose rules have several parts: filters, validation, conflicts and supersession, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import filters as P
from tessera.operators import joins as J
from tessera.operators import similarity as M
from tessera.operators.chains import corroborate_semantic
from tessera.plans.analytic import SIM, knn
from tessera.plans.relational import HITS, MID, PAIRS, _fact_pairs, _hits, ts
from tessera.scratch import materialize
from tessera.sources.fixtures import Tables


def joined(c: str, name: str | None = None):
    """An array of ids as text, to compare."""
    return F.array_join(F.col(c).cast("array<string>"), ",").alias(name or c)


def dated(t: Tables):
    """Nodes with the time in which they hold, where they have one."""
    return t.nodes.join(t.versions.select("node_id", "valid_from", "valid_to"), "node_id", "left")


DATED = "dated AS (SELECT n.*, v.valid_from, v.valid_to FROM nodes n LEFT JOIN versions v ON v.node_id = n.node_id)"


def _subjects(t: Tables):
    """Benchmark passages, their first words and sources of documents, in capitals too."""
    first = t.benchmark.select(F.substring_index("text", " ", 2).alias("subject"))
    return first.union(t.benchmark.select(F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).union(t.documents.select("source")).distinct()


SUBJECTS = "subjects AS (SELECT array_to_string(string_split(text, ' ')[1:2], ' ') AS subject FROM benchmark UNION SELECT translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') FROM benchmark UNION SELECT source FROM documents)"


def _claim_filter(t: Tables):
    dropped = t.claims.where("claim_id % 50 = 1").select("subject", "predicate", "object")
    public = t.part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").cast("string").alias("name")).union(t.claims.where("object <> 'R'").select("object").distinct())
    allowed = t.part.where("p_partkey % 5 = 0").select(F.col("p_partkey").cast("string").alias("name"))
    return P.claim_filter(t.claims, dropped, ["O"], ["x"], public, allowed).select("claim_id", "rule")


def _conflicts(t: Tables):
    edges = t.edges.withColumns({"status": F.when(F.col("dst") % 3 == 0, "resolved").otherwise("unresolved"), "created_at": F.col("src") * 31 % 1000})
    nodes = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("content"), (F.col("s_suppkey") % 7).alias("agent_id"))
    nodes = nodes.union(t.part.select(-F.col("p_partkey"), "p_name", F.col("p_partkey") % 7))
    return J.list_conflicts(edges, nodes, 30, "unresolved", 3).select("src", "dst", "src_content", "dst_content")


def _tiers(t: Tables):
    rows = [("https://*.example.org/*", "authoritative", 5, None), ("http*://m.*", "community", 9, None), ("*example.com/en/*", "validated", 1, None), ("*/[a-m]*", "community", 1, 2)]
    rules = t.spark.createDataFrame(rows, "pattern string, tier string, priority int, silo_id long")
    nodes = t.pages.where("page_id % 4 = 0").select("page_id", F.when(F.col("page_id") % 8 == 0, "validated").otherwise("unknown").alias("tier"))
    return J.source_tier(t.pages.select("page_id", "url", (F.col("page_id") % 3).alias("silo_id")), rules, nodes)


def _orphans(t: Tables):
    nodes = t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 == 0, "TOMBSTONED").otherwise("ACTIVE").alias("state"))
    links = t.orders.select(F.col("o_orderkey").alias("link_id"), F.col("o_custkey").alias("a"), (F.col("o_custkey") * 5).alias("b"))
    steps = t.orders.select(F.col("o_orderkey").alias("step_id"), (F.col("o_custkey") * 3).alias("node_id"))
    docs = t.documents.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("chain_id"))
    return J.orphan_kinds(docs, t.labels.select(F.col("doc_id").alias("chain_id")), t.nodes.select(F.col("node_id").alias("id"), "age_hours"), t.labels.select((F.col("doc_id") * 2).alias("source_id")), steps, nodes, links)


def _links(t: Tables):
    nodes = t.supplier.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 2).alias("silo_id"), F.lit("ACTIVE").alias("state"))
    nodes = nodes.union(t.part.select(-F.col("p_partkey"), F.col("p_partkey") % 2, F.when(F.col("p_partkey") % 9 == 0, "TOMBSTONED").otherwise("ACTIVE")))
    ends = t.orders.select((F.col("o_custkey") % 120).alias("s"), (-(F.col("o_orderkey") % 2500)).alias("p")).distinct()
    new = ends.select(F.col("s").alias("src"), F.col("p").alias("dst"), F.lit("SUPPORTS").alias("edge_type")).union(ends.select("p", "s", F.lit("CAUSES")))
    return J.link_validate(new, nodes, t.edges)


def _replaced(t: Tables):
    # numbered within their evidence once: the new, the old, the recalled and the near are read from what is written
    c = t.claims.select("claim_id", "agent_id", "subject", "predicate", "object", "created_at", "evidence", (F.col("evidence") % 40).alias("session"))
    c = materialize(c, "claims-numbered")
    recalled = c.where("claim_id % 13 = 1").select((F.col("evidence") % 40 + 1).alias("session"), "claim_id")
    near = c.where("claim_id % 2 = 1").select("claim_id", (F.col("evidence") * 1000 + 1).alias("other"))
    return J.supersession_candidates(c.where(F.col("created_at") > ts(MID)), c.where(F.col("created_at") <= ts(MID)), recalled, near)


def _facts(t: Tables):
    return t.nodes.select("node_id", F.col("lang").alias("subject"), F.col("silo_id").alias("predicate"), F.col("layer").alias("object"))


CASES = {
    "p1_filter_hits": (
        lambda t: P.filter_hits(dated(t).withColumn("tags", F.array("lang", "decay_class")), ["knowledge", "wisdom"], 0.2, ["en", "durable"], False, ts(MID)).select("node_id"),
        f", {DATED} SELECT node_id FROM dated WHERE layer IN ('knowledge', 'wisdom') AND coalesce(confidence, 1) >= 0.2 AND (lang = 'en' OR decay_class = 'durable') AND state <> 'SUPERSEDED' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{MID}')",
    ),
    "p6_temporal_query": (
        lambda t: P.temporal_query(dated(t).withColumn("label", F.col("layer")), ts(MID), 25, "knowledge", t.nodes.where("confidence > 0.1")).select("node_id", F.col("valid_from").cast("string").alias("valid_from")),
        f""", {DATED} SELECT node_id, CAST(valid_from AS VARCHAR) AS valid_from FROM dated WHERE valid_from <= TIMESTAMP '{MID}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{MID}') AND length(content) > 0
        AND state <> 'TOMBSTONED' AND layer = 'knowledge' AND confidence > 0.1 ORDER BY dated.valid_from DESC, node_id LIMIT 25""",
    ),
    "p10_layer_threshold": (
        lambda t: P.layer_threshold(_hits(t), {"memory": 0.4}, rerank_floor=0.2).select("query_id", "node_id", "layer", "n_below"),
        f""", {HITS}, m AS (SELECT *, coalesce(score < greatest(CASE WHEN layer = 'memory' THEN 0.4 WHEN layer IN ('knowledge', 'wisdom') THEN 0.25 ELSE 0.15 END, 0.2), false) AS below FROM hits)
        SELECT query_id, node_id, layer, (SELECT count(*) FROM m b WHERE b.below AND b.layer = m.layer) AS n_below FROM m WHERE NOT below""",
    ),
    "p14_claim_filter": (
        _claim_filter,
        """, d AS (SELECT DISTINCT subject, predicate, object FROM claims WHERE claim_id % 50 = 1)
        SELECT claim_id, CASE WHEN d.subject IS NOT NULL THEN 'hard_drop' WHEN c.subject % 5 = 0 THEN NULL WHEN c.predicate = 'O' AND c.subject % 3 <> 0 AND c.subject IN (SELECT p_partkey FROM part) AND c.object <> 'R' THEN 'public_ends' END AS rule
        FROM claims c LEFT JOIN d ON d.subject = c.subject AND d.predicate = c.predicate AND d.object = c.object""",
    ),
    "j2_corroborate_semantic": (
        lambda t: corroborate_semantic(t.vectors.select(F.col("node_id").alias("claim_id"), F.col("label").alias("evidence")), M.tags_within(t.vectors, t.vectors, 0.3, "label")),
        f""", e AS (SELECT node_id AS claim_id, label AS evidence FROM vectors UNION ALL SELECT a.node_id, b.label FROM vectors a JOIN vectors b ON a.node_id <> b.node_id WHERE {SIM} >= 0.3)
        SELECT claim_id, count(DISTINCT evidence) AS n_evidence, count(DISTINCT evidence) >= 3 AS promote FROM e GROUP BY 1""",
    ),
    "j3_corroborate_freeform": (
        lambda t: corroborate_semantic(
            t.vectors.select(F.col("node_id").alias("claim_id"), F.col("label").alias("evidence")),
            M.tags_within(t.vectors.join(t.nodes.where("quality is null").select("node_id"), "node_id", "left_semi"), t.vectors, 0.3, "label"),
            t.nodes.where("quality is null").select(F.col("node_id").alias("claim_id")),
        ),
        f""", f AS (SELECT v.* FROM vectors v WHERE node_id IN (SELECT node_id FROM nodes WHERE quality IS NULL)),
        e AS (SELECT node_id AS claim_id, label AS evidence FROM f UNION ALL SELECT a.node_id, b.label FROM f a JOIN vectors b ON a.node_id <> b.node_id WHERE {SIM} >= 0.3)
        SELECT claim_id, count(DISTINCT evidence) AS n_evidence, count(DISTINCT evidence) >= 3 AS promote FROM e GROUP BY 1""",
    ),
    "j7_cross_agent_conflicts": (
        lambda t: M.cross_agent_conflicts(t.vectors, _facts(t), 10, 0.2, 0.3),
        f""", {knn('a.agent_id <> b.agent_id', 10, 0.2)}
        SELECT * FROM (SELECT query_id, n.node_id, score, CASE WHEN x.lang = y.lang AND x.silo_id = y.silo_id AND x.layer <> y.layer THEN 'structural' WHEN x.lang = y.lang THEN 'subject' WHEN va.label = vb.label AND score > 0.3 THEN 'semantic' END AS conflict
        FROM near n LEFT JOIN nodes x ON x.node_id = query_id LEFT JOIN nodes y ON y.node_id = n.node_id JOIN vectors va ON va.node_id = query_id JOIN vectors vb ON vb.node_id = n.node_id) WHERE conflict IS NOT NULL""",
    ),
    "j11_overlapping_pairs": (
        lambda t: M.overlapping_pairs(t.vectors, 0.3),
        f"SELECT a.node_id AS a, b.node_id AS b, {SIM} AS score FROM vectors a JOIN vectors b ON a.node_id < b.node_id WHERE {SIM} >= 0.3 ORDER BY score DESC, 1, 2 LIMIT 50",
    ),
    "j12_supersession_candidates": (
        _replaced,
        f""", c AS (SELECT *, evidence % 40 AS session FROM claims), o AS (SELECT * FROM c WHERE created_at <= TIMESTAMP '{MID}'), n AS (SELECT * FROM c WHERE created_at > TIMESTAMP '{MID}'),
        r AS (SELECT evidence % 40 + 1 AS asking, claim_id FROM claims WHERE claim_id % 13 = 1),
        one AS (SELECT asking, subject, arg_max(claim_id, (created_at, claim_id)) AS one FROM (SELECT DISTINCT asking, o.* FROM o JOIN r ON r.claim_id = o.claim_id) GROUP BY 1, 2),
        sp AS (SELECT agent_id, subject, predicate, claim_id AS k, object AS obj, session AS ses, created_at AS at FROM (SELECT *, row_number() OVER (PARTITION BY agent_id, subject, predicate ORDER BY created_at DESC, claim_id DESC) AS z FROM o) WHERE z = 1),
        s AS (SELECT agent_id, subject, claim_id AS k, object AS obj, session AS ses, created_at AS at FROM (SELECT *, row_number() OVER (PARTITION BY agent_id, subject ORDER BY created_at DESC, claim_id DESC) AS z FROM o) WHERE z = 1),
        j AS (SELECT n.*, one.one, sp.k AS k1, sp.obj AS obj1, s.k AS k2, coalesce(sp.k, s.k) AS old, CASE WHEN n.claim_id % 2 = 1 THEN n.evidence * 1000 + 1 END AS three,
          coalesce(CASE WHEN sp.k IS NOT NULL THEN sp.ses ELSE s.ses END = n.session, false) AS same, coalesce(abs(epoch(n.created_at) - epoch(CASE WHEN sp.k IS NOT NULL THEN sp.at ELSE s.at END)) < 300, false) AS recent
          FROM n LEFT JOIN one ON asking = n.session AND one.subject = n.subject LEFT JOIN sp ON sp.agent_id = n.agent_id AND sp.subject = n.subject AND sp.predicate = n.predicate
          LEFT JOIN s ON s.agent_id = n.agent_id AND s.subject = n.subject)
        SELECT claim_id, coalesce(one, old, three) AS supersedes, CAST(CASE WHEN one IS NOT NULL THEN 1 WHEN old IS NOT NULL THEN 2 ELSE 3 END AS INT) AS tier,
          CAST(round(CASE WHEN one IS NOT NULL THEN 0.95 WHEN old IS NULL THEN 0.5 ELSE CASE WHEN k1 IS NOT NULL THEN 0.9 ELSE 0.7 END + CASE WHEN same THEN 0.05 ELSE 0 END + CASE WHEN recent THEN 0.03 ELSE 0 END END, 6) AS DOUBLE) AS score,
          one IS NOT NULL OR (old IS NOT NULL AND coalesce(k1 IS NOT NULL AND obj1 <> object AND (same OR recent), false)) AS auto
        FROM j WHERE coalesce(one, old, three) IS NOT NULL""",
    ),
    "j19_list_conflicts": (
        _conflicts,
        """SELECT src, dst, s_name AS src_content, p_name AS dst_content FROM edges JOIN supplier ON s_suppkey = src JOIN part ON -p_partkey = dst
        WHERE edge_type = 'CONTRADICTS' AND dst % 3 <> 0 AND (s_suppkey % 7 = 3 OR p_partkey % 7 = 3) ORDER BY src * 31 % 1000 DESC, src, dst LIMIT 30""",
    ),
    "j21_independence": (
        lambda t: J.independence_groups(_fact_pairs(t), "subject"),
        f""", {PAIRS}, i AS (SELECT subject, CAST(least(1.0, 0.2 + CASE WHEN doc_a <> doc_b THEN 0.3 ELSE 0 END + CASE WHEN agent_a <> agent_b THEN 0.3 ELSE 0 END
        + CASE WHEN abs(hours_a - hours_b) > 24 THEN 0.2 ELSE 0 END + CASE WHEN tier_a <> tier_b THEN 0.2 ELSE 0 END) AS DOUBLE) AS x FROM pairs)
        SELECT subject, round(sum(x), 6) AS total, count(*) AS n_pairs, round(sum(x), 6) >= 2.0 AS passes FROM i GROUP BY 1""",
    ),
    "j22_source_tier": (
        _tiers,
        """, m AS (SELECT page_id, CASE WHEN page_id % 3 = 2 AND url GLOB '*/[a-m]*' THEN 'community' WHEN url GLOB 'http*://m.*' THEN 'community' WHEN url GLOB 'https://*.example.org/*' THEN 'authoritative' WHEN url GLOB '*example.com/en/*' THEN 'validated' END AS rule,
          CASE WHEN page_id % 8 = 0 THEN 'validated' WHEN page_id % 4 = 0 THEN 'unknown' END AS node FROM pages),
        k AS (SELECT *, CASE rule WHEN 'authoritative' THEN 3 WHEN 'validated' THEN 2 WHEN 'community' THEN 1 WHEN 'unknown' THEN 0 ELSE -1 END AS kr, CASE node WHEN 'validated' THEN 2 WHEN 'unknown' THEN 0 END AS kn FROM m)
        SELECT page_id, CASE WHEN kn >= kr THEN node ELSE coalesce(rule, 'unknown') END AS tier, CASE WHEN kn >= kr THEN 'node' WHEN rule IS NOT NULL THEN 'rule' ELSE 'none' END AS decided_by FROM k""",
    ),
    "j23_stale_commitments": (
        lambda t: J.stale_commitments(t.versions.where("supersedes_id is not null"), t.orders.select(F.col("o_custkey").alias("chain_id"), F.col("o_orderkey").alias("evidence_id"), F.col("o_orderdate").alias("seen"))).select("node_id", joined("evidence")),
        """SELECT v.node_id, array_to_string(list_sort(list(DISTINCT o_orderkey)), ',') AS evidence FROM versions v JOIN orders o ON o.o_custkey = v.chain_id AND o.o_orderdate > v.valid_from WHERE v.supersedes_id IS NOT NULL GROUP BY 1""",
    ),
    "j26_session_pairs": (
        lambda t: J.session_pairs(t.conversations.select(F.col("conv_id").alias("session"), F.col("turn").alias("chain"), F.col("turn").alias("created"))),
        "SELECT DISTINCT a.conv_id AS session, a.turn AS earlier, b.turn AS later FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn",
    ),
    "j28_orphans": (
        _orphans,
        """, live AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 5 <> 0)
        SELECT 'summary' AS kind, doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'source', node_id FROM nodes WHERE age_hours > 168 AND node_id NOT IN (SELECT doc_id * 2 FROM labels)
        UNION ALL SELECT 'step', o_orderkey FROM orders WHERE o_custkey * 3 NOT IN (SELECT c_custkey FROM customer)
        UNION ALL SELECT 'link', o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT id FROM live) AND o_custkey * 5 NOT IN (SELECT id FROM live)""",
    ),
    "j30_premises_exist": (
        lambda t: J.premises_exist(t.nodes.select(F.col("node_id").alias("holder"), (F.col("node_id") * 2).alias("ref"), "silo_id"), t.nodes),
        """SELECT h.node_id AS holder, h.node_id * 2 AS ref, CASE WHEN n.node_id IS NULL THEN 'missing' WHEN n.silo_id <> h.silo_id THEN 'wrong_silo' WHEN n.state = 'TOMBSTONED' THEN 'tombstoned' END AS violation
        FROM nodes h LEFT JOIN nodes n ON n.node_id = h.node_id * 2""",
    ),
    "j34_link_validate": (
        _links,
        """, k AS (SELECT DISTINCT o_custkey % 120 AS s, -(o_orderkey % 2500) AS p FROM orders), n AS (SELECT s AS src, p AS dst, 'SUPPORTS' AS edge_type, s, p FROM k UNION ALL SELECT p, s, 'CAUSES', s, p FROM k)
        SELECT src, dst, edge_type, CASE WHEN src = dst THEN 'self_loop' WHEN s NOT IN (SELECT s_suppkey FROM supplier) OR -p NOT IN (SELECT p_partkey FROM part) THEN 'missing_node' WHEN s % 2 <> (-p) % 2 THEN 'cross_silo' WHEN p % 9 = 0 OR s = 0 THEN 'deleted_node'
        WHEN EXISTS (SELECT 1 FROM edges e WHERE e.src = n.src AND e.dst = n.dst AND e.edge_type = n.edge_type) THEN 'duplicate'
        WHEN n.edge_type = 'CAUSES' AND EXISTS (SELECT 1 FROM edges e WHERE e.src = n.dst AND e.dst = n.src AND e.edge_type = 'CAUSES') THEN 'cycle'
        WHEN n.edge_type = 'CAUSES' AND EXISTS (SELECT 1 FROM edges e JOIN edges f ON e.dst = 0 AND f.src = 0 WHERE e.src = n.dst AND f.dst = n.src AND e.edge_type = 'CAUSES' AND f.edge_type = 'CAUSES') THEN 'cycle' END AS code FROM n""",
    ),
    "j36_entity_dedup": (
        lambda t: J.entity_dedup(
            t.part.select(F.col("p_partkey").alias("mention_id"), F.upper("p_brand").alias("name"), F.upper("p_type").alias("qualified_name")), t.part.where("p_size < 3").select(F.col("p_partkey").alias("entity_id"), F.col("p_brand").alias("name"), F.col("p_type").alias("qualified_name"))
        ),
        """, b AS (SELECT lower(p_brand) AS key, min(p_partkey) AS e FROM part WHERE p_size < 3 GROUP BY 1), q AS (SELECT lower(p_type) AS key, min(p_partkey) AS e FROM part WHERE p_size < 3 GROUP BY 1)
        SELECT p_partkey AS mention_id, coalesce(CAST(b.e AS VARCHAR), CAST(q.e AS VARCHAR), sha256(lower(p_brand))) AS entity FROM part LEFT JOIN b ON b.key = lower(p_brand) LEFT JOIN q ON q.key = lower(p_type)""",
    ),
    "j38_belief_coverage": (
        lambda t: J.belief_coverage(dated(t).withColumn("facts", F.array("node_id", F.col("node_id") * 2)), t.benchmark.select(F.col("text").alias("subject")).distinct(), ts(MID)).select("subject", "n_nodes", joined("facts")),
        f""", {DATED}, h AS (SELECT text AS subject, node_id FROM (SELECT DISTINCT text FROM benchmark) b LEFT JOIN dated d ON contains(lower(content), lower(text)) AND state <> 'TOMBSTONED' AND (valid_from IS NULL OR valid_from <= TIMESTAMP '{MID}') AND (valid_to IS NULL OR valid_to > TIMESTAMP '{MID}'))
        SELECT subject, count(node_id) AS n_nodes, coalesce(array_to_string(list_sort(list_distinct(flatten(list([node_id, node_id * 2]) FILTER (node_id IS NOT NULL)))), ','), '') AS facts FROM h GROUP BY 1""",
    ),
    "j38_similar_beliefs": (
        lambda t: J.similar_beliefs(dated(t).withColumn("facts", F.array("node_id", F.col("node_id") * 2)), _subjects(t), ts(MID), 5).select("subject", "rank", "node_id", F.round("confidence", 6).alias("confidence"), joined("facts")),
        f""", {DATED}, {SUBJECTS}, h AS (SELECT subject, node_id, coalesce(confidence, 1.0) AS c, row_number() OVER (PARTITION BY subject ORDER BY coalesce(confidence, 1.0) DESC, node_id) AS k FROM subjects JOIN dated ON contains(lower(content), lower(subject)) AND state <> 'TOMBSTONED' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{MID}'))
        SELECT subject, CAST(k AS INT) AS rank, node_id, round(c, 6) AS confidence, node_id || ',' || 2 * node_id AS facts FROM h WHERE k <= 5""",
    ),
    "j38_history_by_subject": (
        lambda t: J.history_by_subject(dated(t).withColumn("about", F.concat(F.lit("On "), "silo_id")), _subjects(t), 7).select("subject", "place", "node_id", F.col("valid_from").cast("string").alias("valid_from")),
        f""", {DATED}, {SUBJECTS}, h AS (SELECT subject, node_id, valid_from, row_number() OVER (PARTITION BY subject ORDER BY valid_from NULLS FIRST, node_id) AS k FROM subjects JOIN dated ON (contains(lower(content), lower(subject)) OR contains(lower('On ' || silo_id), lower(subject))) AND state <> 'TOMBSTONED')
        SELECT subject, CAST(k AS INT) AS place, node_id, CAST(valid_from AS VARCHAR) AS valid_from FROM h WHERE k <= 7""",
    ),
    "j39_validate_citations": (
        lambda t: J.validate_citations(
            t.claims.groupBy(F.col("subject").alias("finding"), F.col("evidence").alias("node_id")).agg(F.max(F.col("subject") % 3).alias("silo_id"), F.max("confidence").alias("confidence")),
            t.claims.where("evidence % 17 <> 0").select(F.col("subject").alias("finding"), F.col("evidence").alias("node_id")),
            t.orders.where("o_orderkey % 13 <> 0").select(F.col("o_orderkey").alias("node_id"), F.when(F.col("o_orderkey") % 11 == 0, 9).otherwise(None).alias("silo_id")).distinct(), 0.2,
        ).select("finding", "fault", joined("offenders")),
        """, c AS (SELECT subject AS finding, evidence, max(confidence) AS c FROM claims GROUP BY 1, 2),
        r AS (SELECT finding, evidence, CASE WHEN evidence % 17 = 0 THEN 1 WHEN evidence NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 13 <> 0) THEN 2 WHEN evidence % 11 = 0 THEN 3 WHEN c < 0.2 THEN 4 END AS k FROM c),
        m AS (SELECT finding, min(k) AS m FROM r GROUP BY 1)
        SELECT m.finding, CASE m WHEN 1 THEN 'hallucinated' WHEN 2 THEN 'invalid' WHEN 3 THEN 'cross_silo' WHEN 4 THEN 'low_confidence' END AS fault,
        coalesce(array_to_string(list_sort(list(DISTINCT evidence) FILTER (k = m)), ','), '') AS offenders FROM m JOIN r ON r.finding = m.finding GROUP BY m.finding, m""",
    ),
}
