"""Queries over ingest, extraction, findings, metrics and nudges, each over the whole of its rule, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.operators import chains as C
from tessera.operators import extraction as E
from tessera.operators import joins as J
from tessera.plans.analytic import knn
from tessera.plans.relational import MID, ts
from tessera.plans.rules import joined
from tessera.scratch import scratch_path
from tessera.sources import edge_accesses as EA
from tessera.sources.fixtures import Tables
from tessera.streaming import nudges as N
from tessera.streaming import streams as ST

_WIDE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(chr(0xFEE0 + ord(c)) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _batch(t: Tables):
    c, k = t.claims.where(F.col("created_at") > ts(MID)), F.col("claim_id")
    doc = F.when(k % 3 == 0, F.col("evidence") - k % 2)
    return c.withColumns({"position": k, "supersedes": F.when(k % 7 == 0, k - 1), "supersedes_at": F.when(k % 5 == 0, k - 1000), "supersedes_document": doc})


def _edge_log(t: Tables):
    """Three commits to the log, two readings with one cursor between them."""
    log, out, cursor = (scratch_path(t.spark, x) for x in ("edge-log", "edge-accesses", "edge-cursor"))
    a = t.lineitem.select(
        (F.col("l_suppkey") % 4).cast("string").alias("silo_id"), F.col("l_suppkey").alias("src"), (-F.col("l_partkey")).alias("dst"), F.col("l_returnflag").alias("edge_type"),
        F.lit("recall").alias("context"), F.col("l_shipdate").cast("timestamp").alias("ts"), (F.col("l_orderkey") % 3).alias("part"),
    )
    for numbers in ((0, 1), (2,)):
        for n in numbers:
            EA.append_commit(a.where(F.col("part") == n), log, n)
        live = EA.edge_access_source(t.spark, log)
        live.writeStream.format("parquet").option("path", out).option("checkpointLocation", cursor).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(live.schema).parquet(out).groupBy("silo_id", "src", "dst", "edge_type").agg(F.count("*").alias("n"), F.min("edge_id").alias("edge_id"))


def _turns(t: Tables):
    kind, e = F.col("event_type"), F.col("event_id")
    some = lambda *cases: F.array_compact(F.array(*[F.when(c, k) for c, k in cases]))
    wants = some((kind == "error", "pending_markers"), (e % 3 == 0, "stale_hypothesis"), (e % 4 == 1, "form_belief"), (e % 2 == 0, "relevant_context"), (e % 5 == 0, "open_reasoning"))
    ignored = some(((kind == "click") & (e % 3 == 1), "pending_markers"), ((kind == "click") & (e % 2 == 0), "relevant_context"))
    return t.events.select(F.col("user_id").alias("session"), "event_id", "ts", (kind == "purchase").alias("stored"), wants.alias("wants"), ignored.alias("ignored"))


_NUDGE_SQL = """WITH RECURSIVE t AS (SELECT user_id AS session, event_id, epoch_ms(ts) AS tms, event_type = 'purchase' AS stored,
  [event_type = 'error', event_id % 3 = 0, NULL, event_id % 4 = 1, event_id % 2 = 0, event_id % 5 = 0] AS w, [event_type = 'click' AND event_id % 3 = 1, false, false, false, event_type = 'click' AND event_id % 2 = 0, false] AS g FROM events),
l AS (SELECT *, CASE WHEN tms - lag(tms) OVER (PARTITION BY session ORDER BY tms, event_id) < 48 * 3600000 THEN 0 ELSE 1 END AS fresh FROM t),
p AS (SELECT *, sum(fresh) OVER (PARTITION BY session ORDER BY tms, event_id) AS life FROM l),
o AS (SELECT *, row_number() OVER (PARTITION BY session, life ORDER BY tms, event_id) AS n FROM p),
q AS (SELECT *, n - coalesce(max(CASE WHEN stored THEN n END) OVER (PARTITION BY session, life ORDER BY n), 0) AS gap FROM o),
k AS (SELECT *, unnest(range(6)) AS kind FROM q),
i AS (SELECT *, sum(CAST(g[kind + 1] AS INT)) OVER (PARTITION BY session, life, kind ORDER BY n) AS passed FROM k),
e AS MATERIALIZED (SELECT session, life, kind, n, event_id, gap FROM i WHERE passed < 3 AND CASE WHEN kind = 2 THEN gap > 3 ELSE w[kind + 1] END),
x AS MATERIALIZED (SELECT a.session, a.life, a.kind, a.n, a.event_id, a.gap, min(b.n) AS later FROM e a LEFT JOIN e b ON b.session = a.session AND b.life = a.life AND b.kind = a.kind AND b.n >= a.n + 3 GROUP BY ALL),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session, life, kind ORDER BY n) AS r FROM x) WHERE r = 1
  UNION ALL SELECT x.*, 1 FROM s JOIN x ON x.session = s.session AND x.life = s.life AND x.kind = s.kind AND x.n = s.later)
SELECT session, event_id, CAST(n AS INT) AS n_turn, ['pending_markers', 'stale_hypothesis', 'storage_gap', 'form_belief', 'relevant_context', 'open_reasoning'][kind + 1] AS kind, CAST(kind AS INT) AS priority, CAST(gap AS INT) AS gap
FROM (SELECT *, row_number() OVER (PARTITION BY session, life, n ORDER BY kind) AS place FROM s) WHERE place <= 3"""


def _types_sql() -> str:
    rows = [(w, c) for c, ws in E.TYPE_WORDS.items() for w in ws]
    words = ", ".join(f"('{w}', '{c}', {i})" for i, (w, c) in enumerate(rows))
    gram = "unnest(list_transform(range(1, length({0}) + 1), lambda i: substr('#' || {0} || '#', i, 3)))"
    return rf""", v AS (SELECT * FROM (VALUES {words}) AS v(word, type_class, place)),
    t AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[^\x20-\x7E]+|\x20+')) AS entity_type FROM documents), n AS (SELECT DISTINCT entity_type, lower(trim(entity_type)) AS norm FROM t),
    k0 AS (SELECT norm, unnest(list_filter(list_concat([norm], regexp_split_to_array(norm, '[^a-z0-9]+')), lambda w: w <> '')) AS word, generate_subscripts(list_filter(list_concat([norm], regexp_split_to_array(norm, '[^a-z0-9]+')), lambda w: w <> ''), 1) AS pos FROM (SELECT DISTINCT norm FROM n)),
    k AS MATERIALIZED (SELECT norm, arg_min(type_class, pos) AS known FROM k0 JOIN v ON v.word = k0.word GROUP BY 1),
    a AS MATERIALIZED (SELECT norm, gram, count(*) AS c FROM (SELECT norm, {gram.format('norm')} AS gram FROM (SELECT DISTINCT norm FROM n) WHERE norm NOT IN (SELECT norm FROM k)) GROUP BY 1, 2),
    b AS MATERIALIZED (SELECT word, gram, count(*) AS d FROM (SELECT word, {gram.format('word')} AS gram FROM v) GROUP BY 1, 2),
    la AS (SELECT norm, sqrt(sum(c * c)) AS la FROM a GROUP BY 1), lb AS (SELECT word, sqrt(sum(d * d)) AS lb FROM b GROUP BY 1),
    s AS (SELECT d.norm, type_class, place, round(d.dot / (la * lb), 9) AS score FROM (SELECT norm, word, sum(c * d) AS dot FROM a JOIN b ON a.gram = b.gram GROUP BY 1, 2) d JOIN la ON la.norm = d.norm JOIN lb ON lb.word = d.word JOIN v ON v.word = d.word),
    m AS (SELECT norm, arg_max(type_class, (score, -place)) AS alike FROM s WHERE score >= 0.15 GROUP BY 1)
    SELECT entity_type, coalesce(known, alike) AS type_class FROM n LEFT JOIN k ON k.norm = n.norm LEFT JOIN m ON m.norm = n.norm"""


CASES = {
    "s5_ingest_claims": (
        lambda t: C.ingest_claims(t.claims.where(F.col("created_at") <= ts(MID)), _batch(t)),
        f""", o AS (SELECT * FROM claims WHERE created_at <= TIMESTAMP '{MID}'), b AS MATERIALIZED (SELECT *, evidence IN (SELECT evidence FROM o) AS known FROM claims WHERE created_at > TIMESTAMP '{MID}'),
        x AS (SELECT claim_id, silo_id, subject, predicate, object, created_at, false AS fresh FROM (SELECT *, row_number() OVER (PARTITION BY silo_id, subject, predicate ORDER BY created_at DESC, claim_id DESC) AS k FROM o) WHERE k = 1
          UNION ALL SELECT claim_id, silo_id, subject, predicate, object, created_at, true FROM b WHERE NOT known AND claim_id % 7 <> 0),
        w AS (SELECT claim_id, fresh, object, lag(object) OVER z AS po, lag(claim_id) OVER z AS pc FROM x WINDOW z AS (PARTITION BY silo_id, subject, predicate ORDER BY fresh, created_at, claim_id)),
        d AS (SELECT b.claim_id, max(c.claim_id) AS doc FROM b JOIN b c ON c.evidence = b.evidence - b.claim_id % 2 AND c.claim_id < b.claim_id AND NOT c.known WHERE b.claim_id % 3 = 0 GROUP BY 1)
        SELECT b.claim_id, CASE WHEN b.known THEN 'skipped' ELSE 'created' END AS status,
          CASE WHEN NOT b.known THEN coalesce(CASE WHEN b.claim_id % 7 = 0 THEN b.claim_id - 1 END, CASE WHEN b.claim_id % 5 = 0 THEN e.claim_id END, d.doc, CASE WHEN w.po <> w.object THEN w.pc END) END AS supersedes
        FROM b LEFT JOIN b e ON e.claim_id = b.claim_id - 1000 AND NOT e.known LEFT JOIN d ON d.claim_id = b.claim_id LEFT JOIN w ON w.fresh AND w.claim_id = b.claim_id""",
    ),
    "s9_edge_access_source": (
        _edge_log,
        """SELECT CAST(l_suppkey % 4 AS VARCHAR) AS silo_id, l_suppkey AS src, -l_partkey AS dst, l_returnflag AS edge_type, count(*) AS n, sha256(l_returnflag || '|' || CAST(-l_partkey AS VARCHAR) || '|' || CAST(l_suppkey AS VARCHAR)) AS edge_id
        FROM lineitem GROUP BY ALL""",
    ),
    "j35_resolve_alias": (
        # surface forms in full-width capitals
        lambda t: J.resolve_alias(t.documents.select("doc_id", F.translate(F.upper("lang"), *_WIDE).alias("surface")), t.documents.select(F.col("lang").alias("alias"), F.col("doc_id").alias("entity_id"))).select("doc_id", "entity_id"),
        "SELECT doc_id, CASE WHEN lang IS NOT NULL THEN min(doc_id) OVER (PARTITION BY lang) END AS entity_id FROM documents",
    ),
    "j40_dedup_or_corroborate": (
        lambda t: E.dedup_or_corroborate(
            t.vectors.where("node_id % 4 = 0").select("node_id", F.expr("node_id DIV 48").alias("source_id"), (-F.col("node_id")).alias("place"), (F.col("node_id") % 10 / 10).alias("raw_confidence"), "embedding"),
            t.vectors.where("node_id % 4 <> 0"),
            E.extraction_sources(t.nodes.select("node_id", "content", "heat_score", F.when(F.col("node_id") % 6 == 5, F.when(F.col("node_id") % 4 == 1, "v0").otherwise("v1")).alias("extracted_version")), "v1", 200, 0.5), 0.45,
        ).withColumn("confidence", F.round("confidence", 6)),
        f""", {knn('a.node_id % 4 = 0 AND b.node_id % 4 <> 0', 1, 0.45)}, s AS (SELECT node_id FROM nodes WHERE (length(coalesce(content, '')) >= 200 OR heat_score >= 0.5) AND NOT (node_id % 6 = 5 AND node_id % 4 <> 1)),
        c AS (SELECT node_id, node_id // 48 AS source_id, row_number() OVER (PARTITION BY node_id // 48 ORDER BY node_id DESC) AS nth FROM vectors WHERE node_id % 4 = 0 AND node_id // 48 IN (SELECT node_id FROM s))
        SELECT c.node_id, source_id, n.node_id AS target, CASE WHEN n.node_id IS NULL THEN 'claim' ELSE 'CORROBORATES' END AS outcome, CASE WHEN n.node_id IS NULL THEN round(0.6 * 0.75 * (c.node_id % 10) / 10, 6) END AS confidence,
          CASE WHEN n.node_id IS NOT NULL THEN CAST(0.3 AS DOUBLE) END AS independence FROM c LEFT JOIN near n ON n.query_id = c.node_id WHERE nth <= 10""",
    ),
    "a29_findings_by_quality": (
        lambda t: C.findings_by_quality(t.nodes.select("node_id", F.col("layer").alias("level"), F.col("confidence").alias("quality")), 7).select("level", "node_id", "place"),
        "SELECT level, node_id, CAST(place AS INT) AS place FROM (SELECT layer AS level, node_id, row_number() OVER (PARTITION BY layer ORDER BY confidence DESC, node_id) AS place FROM nodes) WHERE place <= 7",
    ),
    "a29_child_summaries": (
        lambda t: E.child_summaries(
            t.nation.select(F.col("n_nationkey").alias("child"), F.col("n_regionkey").alias("parent")), t.customer.select(F.col("c_custkey").alias("finding"), F.col("c_nationkey").alias("child")),
            t.customer.select(F.col("c_custkey").alias("finding"), F.col("c_mktsegment").alias("summary"), F.when(F.col("c_custkey") % 3 == 0, "extraction").alias("origin"), (F.col("c_custkey") % 5 == 0).alias("published")),
        ),
        "SELECT n_regionkey AS parent, n_nationkey AS child, c_custkey AS finding, c_mktsegment AS summary FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 3 = 0 OR c_custkey % 5 = 0",
    ),
    "t16_belief_hints": (
        lambda t: E.belief_hints(t.claims, t.claims.where("claim_id % 3 = 0").select("claim_id"), t.claims.where("claim_id % 11 = 1").select("claim_id")).select("silo_id", "subject", "predicate", "n_facts", "message", joined("node_ids")),
        """, g AS (SELECT silo_id, subject, predicate, count(*) AS n_facts, array_to_string(list_sort(list(claim_id))[1:5], ',') AS node_ids FROM claims WHERE claim_id % 3 <> 0 GROUP BY 1, 2, 3 HAVING count(*) >= 3 AND count(DISTINCT evidence) >= 3),
        h AS (SELECT *, count(*) OVER (PARTITION BY silo_id) AS n FROM claims WHERE claim_id % 11 = 1)
        SELECT silo_id, subject, predicate, n_facts, n_facts || ' corroborating facts about ''' || predicate || '''. Consider forming a belief.' AS message, node_ids FROM g
        WHERE EXISTS (SELECT 1 FROM h WHERE n >= 3 AND h.silo_id = g.silo_id AND h.subject = g.subject AND h.predicate = g.predicate)""",
    ),
    "f19_is_hard_query": (
        lambda t: t.documents.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), X.is_hard_query("text").alias("hard")).union(t.conversations.select(F.lit("turn"), F.col("conv_id") * 100000 + F.col("turn"), X.is_hard_query("text"))),
        r""", q AS (SELECT 'document' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'turn', conv_id * 100000 + turn, text FROM conversations),
        w AS (SELECT kind, id, regexp_replace(lower(text), '^[\x09-\x0D ]+|[\x09-\x0D ]+$', '', 'g') AS t FROM q),
        v AS (SELECT *, list_transform(list_filter(regexp_split_to_array(t, '[\x09-\x0D ]+'), lambda x: x <> ''), lambda x: regexp_replace(x, '[!-/:-@\[-`{-~]+$', '')) AS ws FROM w)
        SELECT kind, id, contains(t, '?') OR contains(t, 'true or false') OR coalesce(ws[1] IN ('what', 'where', 'when', 'how', 'which', 'who', 'why', 'true', 'is', 'are', 'does', 'do', 'can', 'should'), false)
        OR (len(ws) <= 5 AND list_has_any(ws, ['rejected', 'approved', 'denied', 'accepted', 'failed', 'succeeded', 'postponed', 'cancelled', 'confirmed', 'dismissed', 'granted', 'abandoned', 'dropped', 'removed', 'added', 'changed', 'decided']))
        OR regexp_matches(t, '^(my|our) [^\n]+$') OR regexp_matches(t, '^(is|are|was|were) [^\n]+ (approved|rejected|denied)$') AS hard FROM v""",
    ),
    "f20_type_class": (
        lambda t: E.type_classes(t.documents.select(F.explode(F.split("text", r"[^\x20-\x7E]+|\x20+")).alias("entity_type")), "entity_type", E.type_vocabulary(t.spark)),
        _types_sql(),
    ),
    "st5_metric_buckets": (
        lambda t: ST.metric_buckets(
            t.events.select("ts", (F.col("user_id") % 3).alias("silo_id"), F.col("event_type").alias("metric"), F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("value"), (F.col("value") > 50).alias("is_error"), F.when(F.col("event_id") % 4 == 0, 3).alias("times"))
        ).withColumn("bucket", F.col("bucket").cast("string")),
        """, m AS (SELECT *, CASE WHEN event_id % 9 <> 0 THEN value END AS v, CASE WHEN event_id % 4 = 0 THEN 3 ELSE 1 END AS times FROM events)
        SELECT CAST(date_trunc('minute', ts) AS VARCHAR) AS bucket, user_id % 3 AS silo_id, event_type AS metric, CAST(sum(times) AS BIGINT) AS n, CAST(sum(CASE WHEN value > 50 THEN times ELSE 0 END) AS BIGINT) AS n_errors, round(coalesce(sum(v), 0), 6) AS total,
          round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95, max(v) AS most FROM m GROUP BY 1, 2, 3""",
    ),
    "st9_nudges": (lambda t: N.nudges(_turns(t), N.Rules(gap=3, hours=48)), _NUDGE_SQL),
}
