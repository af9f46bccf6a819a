"""Queries over chains, sessions, ingest and history with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import aggregates as A
from tessera.operators import chains as C
from tessera.operators import graph as G
from tessera.operators import joins as J
from tessera.operators import scans as S
from tessera.operators import windows as W
from tessera.operators.similarity import nearest
from tessera.plans.analytic import _prior, _tree, knn, stopped
from tessera.plans.relational import MID, r6, ts
from tessera.scratch import materialize, scratch_path
from tessera.sources.fixtures import Tables
from tessera.streaming import streams as ST



def _steps(t: Tables):
    return t.versions.select("chain_id", F.col("node_id").alias("place"), (F.col("confidence") * 2).alias("confidence"))


def _label_runs(t: Tables):
    a = t.vectors.select("node_id", "label")
    return a.unionByName(t.vectors.select("node_id", F.when(F.col("node_id") % 9 == 0, -1).otherwise(F.col("label")).alias("label")))


def _round_trip(t: Tables):
    """One tenant out of an export of all."""
    path = scratch_path(t.spark, "export")
    S.silo_export(t.nodes.select("node_id", "silo_id", "layer"), path)
    return S.silo_import(t.spark, path, "src1").select("node_id", "layer")


def _streamed(t: Tables, apply, out: str, schema: str):
    """What a stream over the events, as files in a folder, writes when it has read them all."""
    source, sink = scratch_path(t.spark, "events"), scratch_path(t.spark, out)
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(source)
    live = apply(ST.access_source(t.spark, source, e.schema))
    live.writeStream.format("parquet").option("path", sink).option("checkpointLocation", scratch_path(t.spark, "cursor")).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(schema).parquet(sink)


def _gauges(t: Tables):
    """Two hourly runs of the gauges, appended."""
    path = scratch_path(t.spark, "gauges")
    for hour in (0, 1):
        A.storage_gauges(t.nodes).select(F.lit(hour).alias("hour"), "silo_id", "n_nodes", "content_bytes").write.mode("append").parquet(path)
    return t.spark.read.parquet(path)


def _ppr_channel_sql(rounds: int) -> str:
    text = """, e1 AS (SELECT src, dst, sum(weight) AS w FROM edges WHERE weight > 0 GROUP BY 1, 2), e0 AS (SELECT src, dst, sum(w) AS w FROM (SELECT * FROM e1 UNION ALL SELECT dst, src, w FROM e1) GROUP BY 1, 2),
    e AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM e0), s AS (SELECT q, id, 1.0 / count(*) OVER (PARTITION BY q) AS r FROM (SELECT DISTINCT src % 10 AS q, src AS id FROM edges)), k0 AS (SELECT q, id, r AS rank FROM s)"""
    for i in range(1, rounds + 1):
        text += f""", m{i} AS MATERIALIZED (SELECT q, dst AS id, sum(rank * p) AS m FROM k{i - 1} JOIN e ON id = src GROUP BY 1, 2),
        t{i} AS (SELECT q, sum(m) AS m FROM m{i} GROUP BY 1), b{i} AS (SELECT s.q, id, r * (1 - 0.85 * coalesce(m, 0)) AS b FROM s LEFT JOIN t{i} ON t{i}.q = s.q),
        k{i} AS MATERIALIZED (SELECT coalesce(m.q, b.q) AS q, coalesce(m.id, b.id) AS id, 0.85 * coalesce(m, 0) + coalesce(b, 0) AS rank FROM m{i} m FULL JOIN b{i} b ON m.q = b.q AND m.id = b.id)"""
    text += f", z AS (SELECT q AS query_id, id AS node_id, round(rank, 6) AS score FROM k{rounds})"
    return text + " SELECT query_id, node_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM z) WHERE rank <= 10"


def _restart_sql(rounds: int) -> str:
    """Rounds enough for these tables, where one node (0) is its own neighbour."""
    text = """, n AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges), e0 AS (SELECT src, dst, sum(CASE edge_type WHEN 'SUPPORTS' THEN weight ELSE -weight END) AS w FROM edges WHERE edge_type IN ('SUPPORTS', 'CONTRADICTS') GROUP BY 1, 2),
    e AS MATERIALIZED (SELECT src, dst, w / CASE WHEN sum(w) OVER (PARTITION BY src) > 0 THEN sum(w) OVER (PARTITION BY src) ELSE 1 END AS p FROM e0), q AS (SELECT DISTINCT src FROM edges WHERE src % 10 = 0),
    t AS MATERIALIZED (SELECT id, CASE WHEN src IS NULL THEN 0.0 ELSE 1.0 / count(src) OVER () END AS t FROM n LEFT JOIN q ON src = id), x0 AS (SELECT id, t.t AS x FROM t)"""
    for i in range(1, rounds + 1):
        text += f", x{i} AS MATERIALIZED (SELECT t.id, 0.15 * t.t + 0.85 * coalesce(m, 0) AS x FROM t LEFT JOIN (SELECT dst, sum(x * p) AS m FROM x{i - 1} JOIN e ON id = src GROUP BY 1) f ON f.dst = t.id)"
    return text + stopped(rounds, 1e-6, "rank", 1, 9)


def _local(t: Tables):
    e = materialize(t.edges, "edges")
    kinds = e.withColumn("edge_type", F.when(F.col("edge_type") == "CAUSES", "SYNTHESIZED_FROM").otherwise(F.col("edge_type")))
    return r6(C.propagate_local(_prior(t, e), kinds, e.where("src % 10 = 3").select(F.col("src").alias("id"))), "confidence")


def _local_sql(depth: int, rounds: int) -> str:
    text = """, ids AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges), u AS MATERIALIZED (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), n0 AS (SELECT DISTINCT src AS target, src AS id FROM edges WHERE src % 10 = 3)"""
    for i in range(1, depth + 1):
        text += f", n{i} AS MATERIALIZED (SELECT * FROM n{i - 1} UNION SELECT target, dst FROM n{i - 1} JOIN u ON src = id)"
    text += f""", p AS MATERIALIZED (SELECT target, id, abs(id) % 10 / 10.0 AS c FROM n{depth}),
    e0 AS (SELECT a.target, src, dst, CASE edge_type WHEN 'CONTRADICTS' THEN -1.0 ELSE 1.0 END AS sign, weight AS w FROM edges JOIN p a ON a.id = src JOIN p b ON b.id = dst AND b.target = a.target),
    e AS MATERIALIZED (SELECT target, src, dst, sign * w / sum(w) OVER (PARTITION BY target, dst, sign) AS w FROM e0), x0 AS (SELECT target, id, c AS x FROM p)"""
    for i in range(1, rounds + 1):
        text += f""", x{i} AS MATERIALIZED (SELECT p.target, p.id, CASE WHEN f.s IS NULL THEN c ELSE greatest(0, least(1, 0.2 * c + 0.8 * f.s)) END AS x
        FROM p LEFT JOIN (SELECT e.target, dst, sum(w * x) AS s FROM x{i - 1} x JOIN e ON x.id = src AND x.target = e.target GROUP BY 1, 2) f ON f.dst = p.id AND f.target = p.target)"""
    return text + f" SELECT x.target, x.id, round(x, 6) AS confidence FROM x{rounds} x JOIN p ON p.id = x.id AND p.target = x.target WHERE abs(round(x - c, 9)) > 0.1"


CASES = {
    "s9_access_source": (
        lambda t: _streamed(t, lambda s: s.select("user_id", "event_type"), "accesses", "user_id long, event_type string").groupBy("user_id").agg(F.count("*").alias("n")),
        "SELECT user_id, count(*) AS n FROM events GROUP BY 1",
    ),
    "s11_storage_gauges_sink": (
        _gauges,
        "SELECT CAST(h AS INT) AS hour, silo_id, count(*) AS n_nodes, CAST(sum(octet_length(encode(content))) AS BIGINT) AS content_bytes FROM nodes, (SELECT unnest([0, 1]) AS h) GROUP BY 1, 2",
    ),
    "j24_support_candidates": (
        lambda t: C.support_candidates(t.vectors, F.col("node_id") % 7 == 0, 5, 0.3),
        f", {knn('a.node_id % 7 = 0', 5, 0.3)} SELECT query_id, node_id, score FROM near",
    ),
    "j32_beliefs_referencing": (
        lambda t: C.beliefs_referencing(t.edges, t.part.where("p_size < 5").select((-F.col("p_partkey")).alias("id"))),
        "SELECT src, count(DISTINCT dst) AS n FROM edges WHERE dst IN (SELECT -p_partkey FROM part WHERE p_size < 5) GROUP BY 1",
    ),
    "j33_reflections_for": (
        lambda t: C.newest_about(t.nodes.where("layer = 'intelligence'"), t.nodes.select((F.col("node_id") % 10).alias("target"), "node_id"), 3),
        "SELECT target, node_id, CAST(place AS INT) AS place FROM (SELECT node_id % 10 AS target, node_id, row_number() OVER (PARTITION BY node_id % 10 ORDER BY age_hours, node_id) AS place FROM nodes WHERE layer = 'intelligence') WHERE place <= 3",
    ),
    "j37_pending_for_facts": (
        lambda t: C.pending_for_facts(t.orders.select(F.col("o_custkey").alias("belief_id"), F.col("o_orderkey").alias("fact_id"), F.col("o_orderdate").alias("expires_at")), t.orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("fact_id")), ts("2000-01-01")),
        "SELECT DISTINCT o_custkey AS belief_id FROM orders WHERE o_orderdate > TIMESTAMP '2000-01-01' AND o_orderkey % 3 = 0",
    ),
    "w7_key_sentences": (lambda t: W.key_sentences(t.nodes), None),
    "w8_cold_chains": (
        lambda t: C.cold_chains(t.nodes.select("node_id", "age_hours", (F.col("node_id") % 23).alias("n_accesses")), 100, 20).select("node_id"),
        "SELECT node_id FROM nodes WHERE age_hours > 100 ORDER BY node_id % 23, node_id LIMIT 20",
    ),
    "w9_compactable_chains": (
        lambda t: W.oldest_first(t.nodes, F.col("state") == "SUPERSEDED", [F.desc("age_hours"), F.col("node_id")], 10).select("node_id", "age_hours"),
        "SELECT node_id, age_hours FROM nodes WHERE state = 'SUPERSEDED' ORDER BY age_hours DESC, node_id LIMIT 10",
    ),
    "u4_node_as_of": (
        lambda t: C.node_as_of(t.versions.where("valid_to is null").select("chain_id", "node_id", "valid_from", "valid_to"), t.versions.where("valid_to is not null").select("chain_id", "node_id", "valid_from", "valid_to"), ts(MID)),
        f"SELECT chain_id, arg_max(node_id, (valid_from, node_id)) AS node_id FROM versions WHERE valid_from <= TIMESTAMP '{MID}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{MID}') GROUP BY 1",
    ),
    "g4_propagate_local": (
        _local,
        _local_sql(2, 20),
    ),
    "g19_erasure_impact": (
        lambda t: C.erasure_impact(_tree(t), t.orders.where("o_orderkey = 5").select(F.col("o_orderkey").alias("id")), 5),
        """SELECT DISTINCT o_orderkey AS id, CAST(CASE 5 WHEN o_orderkey // 3 THEN 1 WHEN o_orderkey // 9 THEN 2 WHEN o_orderkey // 27 THEN 3 WHEN o_orderkey // 81 THEN 4 WHEN o_orderkey // 243 THEN 5 END AS INT) AS hops FROM orders
        WHERE 5 IN (o_orderkey // 3, o_orderkey // 9, o_orderkey // 27, o_orderkey // 81, o_orderkey // 243)""",
    ),
    "l11_expire_markers": (
        lambda t: C.expired_split(t.versions.select("node_id", "valid_to"), "valid_to", ts(MID)).groupBy("expired").agg(F.count("*").alias("n")),
        f"SELECT coalesce(valid_to < TIMESTAMP '{MID}', false) AS expired, count(*) AS n FROM versions GROUP BY 1",
    ),
    "l17_embed_backfill": (lambda t: C.embed_backfill(t.nodes, C.hashing_encoder()).select("node_id", F.size("embedding").cast("long").alias("n")), "SELECT node_id, CAST(64 AS BIGINT) AS n FROM nodes"),
    "l18_extract_mentions": (
        lambda t: C.extract_mentions(t.nodes),
        """, m AS (SELECT node_id, unnest(regexp_extract_all(content, '\\b[A-Z][a-z]+(?:\\s[A-Z][a-z]+)+')) AS surface FROM nodes) SELECT node_id, surface, count(*) AS n FROM m GROUP BY 1, 2""",
    ),
    "l19_spo_backfill": (
        lambda t: C.spo_backfill(t.claims.withColumn("object", F.when(F.col("claim_id") % 8 == 0, None).otherwise(F.col("object")))).select("claim_id"),
        "SELECT claim_id FROM claims WHERE claim_id % 8 = 0",
    ),
    "t7_ppr_channel": (
        lambda t: G.ppr_channel(t.edges, t.edges.select((F.col("src") % 10).alias("query_id"), F.col("src").alias("id")).distinct().withColumn("weight", F.lit(1.0)), 10),
        _ppr_channel_sql(10),
    ),
    "j25_session_conflicts": (
        lambda t: J.session_conflicts(t.events.select(F.col("event_id").alias("hypothesis"), F.col("user_id").alias("session"), F.col("event_type").alias("target"))),
        "SELECT event_id AS hypothesis, n - 1 AS n_others FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events) WHERE n > 1",
    ),
    "t15_breakthrough_hints": (
        lambda t: C.breakthrough_hints(t.benchmark.select(F.col("item_id").alias("query_id"), "text"), t.benchmark.select(F.col("item_id").alias("solved_id"), F.col("item_id").alias("asked"), F.col("text").alias("solved_text")), least=0.3),
        None,
    ),
    "g2_pagerank_restart": (
        # many ranks lie halfway between two numbers of six places
        lambda t: G.pagerank_restart(t.edges.select(F.col("src").alias("id")).union(t.edges.select("dst")), t.edges, t.edges.where("src % 10 = 0").select(F.col("src").alias("id"))).select("id", F.round("rank", 9).alias("rank")),
        _restart_sql(15),
    ),
}
