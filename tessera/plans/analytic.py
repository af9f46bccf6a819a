"""Queries with their oracle SQL: scalar functions, similarity, retrieval, graph, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.operators import graph as G
from tessera.operators import lifecycle as L
from tessera.operators import retrieval as R
from tessera.operators import similarity as M
from tessera.operators.filters import keep_top
from tessera.plans.relational import r6, ts
from tessera.sources.fixtures import Tables
from tessera.streaming import streams as ST

SIM = "CAST(round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS DOUBLE)"


def knn(where: str, k: int, least: float, extra: str = "a.node_id <> b.node_id") -> str:
    return f"""near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM (
      SELECT a.node_id AS query_id, b.node_id, {SIM} AS score FROM vectors a JOIN vectors b ON {extra} WHERE {where}) WHERE score >= {least}) WHERE rank <= {k})"""


def _queries(t: Tables):
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


TOKENS = """
terms AS (SELECT node_id, token, count(*) AS tf FROM (SELECT node_id, unnest(regexp_split_to_array(lower(coalesce(content, '')), '[^\\p{L}\\p{N}]+')) AS token FROM nodes) WHERE token <> '' GROUP BY 1, 2),
asked AS (SELECT DISTINCT query_id, token FROM (SELECT item_id AS query_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS token FROM benchmark) WHERE token <> '')"""
BM25 = f"""{TOKENS},
lens AS (SELECT node_id, sum(tf) AS length FROM terms GROUP BY 1), st AS (SELECT count(*) AS n, avg(length) AS mean FROM lens),
dfs AS (SELECT token, count(*) AS df FROM terms GROUP BY 1),
raw AS (SELECT query_id, terms.node_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
  FROM terms JOIN asked ON terms.token = asked.token JOIN dfs ON dfs.token = terms.token JOIN lens ON lens.node_id = terms.node_id, st GROUP BY 1, 2)"""


def top(source: str, k: int) -> str:
    return f"SELECT query_id, node_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM {source}) WHERE rank <= {k}"


GRAMS = "list_distinct(list_transform(range(1, CAST(length({c}) + 2 AS BIGINT)), lambda i: substr('  ' || lower({c}) || ' ', CAST(i AS INT), 3)))"
TEXT = f"""lex AS (SELECT query_id, node_id, score / max(score) OVER (PARTITION BY query_id) AS share FROM raw),
gx AS MATERIALIZED (SELECT node_id, {GRAMS.format(c="coalesce(content, '')")} AS x FROM nodes), gy AS MATERIALIZED (SELECT item_id AS query_id, {GRAMS.format(c='text')} AS y FROM benchmark),
sims AS MATERIALIZED (SELECT query_id, node_id, CAST(n AS DOUBLE) / (a + c - n) AS sim FROM (SELECT query_id, node_id, len(list_intersect(x, y)) AS n, len(x) AS a, len(y) AS c FROM gx, gy)),
txt AS (SELECT s.query_id, s.node_id, round(0.7 * coalesce(share, 0) + 0.3 * sim, 6) AS score FROM sims s LEFT JOIN lex ON lex.query_id = s.query_id AND lex.node_id = s.node_id WHERE share IS NOT NULL OR sim > 0.1)"""


def recall_nodes(t: Tables):
    """Nodes with the time in which they hold, their number of sources and whether they are stale."""
    v = t.versions.select("node_id", "valid_from", "valid_to")
    return t.nodes.join(v, "node_id", "left").withColumns({"n_sources": F.col("node_id") % 4, "stale": F.col("node_id") % 5 == 0})


def recall_edges(t: Tables):
    """Affinities to walk along, and contradictions."""
    near = M.affinity_edges(t.vectors, 3, 0.3).select("src", "dst", F.lit("RELATED_TO").alias("edge_type"), "weight")
    return near.union(t.nodes.where("node_id % 3 = 0").select(F.col("node_id").alias("src"), (F.col("node_id") + 20).alias("dst"), F.lit("CONTRADICTS"), F.lit(1.0)))


def _recall(t: Tables):
    q = _queries(t).join(t.vectors.select(F.col("node_id").alias("query_id"), "embedding"), "query_id")
    q = q.withColumns({"start": F.make_timestamp_ntz(F.lit(1994), F.col("query_id").cast("int") % 12 + 1, F.lit(1), F.lit(0), F.lit(0), F.lit(0)), "end": ts("1997-03-01")})
    return R.recall(q, recall_nodes(t), t.vectors, recall_edges(t), 10, overrides={"memory": 0.2})


def _recall_sql(k: int, rounds: int) -> str:
    live = lambda text: text.replace("FROM nodes)", "FROM live)")
    near = knn("a.node_id IN (SELECT item_id FROM benchmark) AND b.node_id IN (SELECT node_id FROM live)", 2 * k, -1).replace("near AS", "near AS MATERIALIZED")
    aff = knn("true", 3, 0.3).replace("near AS", "aff AS MATERIALIZED")
    text = f""", lv AS (SELECT n.*, v.valid_from, v.valid_to FROM nodes n LEFT JOIN versions v ON v.node_id = n.node_id WHERE state = 'ACTIVE'), live AS MATERIALIZED (SELECT * FROM lv), {near}, {aff}, {live(BM25).replace("FROM nodes", "FROM live")}, {TEXT.replace("FROM nodes", "FROM live")},
    five AS (SELECT DISTINCT query_id, unnest(ws) AS token FROM (SELECT item_id AS query_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 3)[1:5] AS ws FROM benchmark)),
    qs AS (SELECT item_id AS query_id, make_timestamp(1994, item_id % 12 + 1, 1, 0, 0, 0) AS s, TIMESTAMP '1997-03-01' AS e, embedding FROM benchmark JOIN vectors ON node_id = item_id),
    grp AS (SELECT g.query_id, node_id, CAST(count(*) AS DOUBLE) AS score FROM terms JOIN five g ON g.token = terms.token JOIN qs ON qs.query_id = g.query_id GROUP BY 1, 2),
    tmp AS (SELECT query_id, node_id, round(CASE WHEN layer = 'memory' THEN pow(0.5, date_diff('second', valid_from, e) / 86400 / 7) ELSE 1.0 END, 6) AS score FROM qs JOIN live ON valid_from BETWEEN s AND e),
    e0 AS (SELECT src, dst, sum(w) AS w FROM (SELECT query_id AS src, node_id AS dst, score AS w FROM aff WHERE score > 0 UNION ALL SELECT node_id, query_id, score FROM aff WHERE score > 0) GROUP BY 1, 2),
    e AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM e0), s AS MATERIALIZED (SELECT query_id AS q, node_id AS id, 1.0 / count(*) OVER (PARTITION BY query_id) AS r FROM near WHERE rank <= 5), k0 AS (SELECT q, id, r AS rank FROM s)"""
    for i in range(1, rounds + 1):
        text += f""", m{i} AS MATERIALIZED (SELECT q, dst AS id, sum(rank * p) AS m FROM k{i - 1} JOIN e ON id = src GROUP BY 1, 2), u{i} AS (SELECT q, sum(m) AS m FROM m{i} GROUP BY 1),
        b{i} AS (SELECT s.q, id, r * (1 - 0.85 * coalesce(m, 0)) AS b FROM s LEFT JOIN u{i} ON u{i}.q = s.q),
        k{i} AS MATERIALIZED (SELECT coalesce(m.q, b.q) AS q, coalesce(m.id, b.id) AS id, 0.85 * coalesce(m, 0) + coalesce(b, 0) AS rank FROM m{i} m FULL JOIN b{i} b ON m.q = b.q AND m.id = b.id)"""
    text += f""", ppr AS (SELECT q AS query_id, id AS node_id, round(rank, 6) AS score FROM k{rounds}),
    ch AS (SELECT query_id, node_id, 'd' AS c, rank FROM near UNION ALL SELECT query_id, node_id, 't', rank FROM ({top('(SELECT * FROM txt WHERE query_id IN (SELECT query_id FROM qs))', 2 * k)}) UNION ALL SELECT query_id, node_id, 'g', rank FROM ({top('grp', 2 * k)})
      UNION ALL SELECT query_id, node_id, 'p', rank FROM ({top('ppr', 2 * k)}) UNION ALL SELECT query_id, node_id, 'm', rank FROM ({top('tmp', 2 * k)})),
    n AS (SELECT query_id, count(DISTINCT c) AS n FROM ch GROUP BY 1), f AS (SELECT ch.query_id, node_id, round(sum(1.0 / (60 + rank)) / (any_value(n) / 61.0), 9) AS score FROM ch JOIN n ON n.query_id = ch.query_id GROUP BY 1, 2),
    ft AS MATERIALIZED (SELECT * FROM ({top('f', max(2 * k, 50))}) WHERE node_id IN (SELECT node_id FROM live)),
    rr AS (SELECT ft.query_id, ft.node_id, round(list_cosine_similarity(CAST(qs.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS r FROM ft JOIN qs ON qs.query_id = ft.query_id JOIN vectors v ON v.node_id = ft.node_id),
    bm AS (SELECT query_id, max(r) AS b FROM rr GROUP BY 1),
    bl AS (SELECT ft.query_id, ft.node_id, round(CASE WHEN r IS NULL OR b <= 0 THEN score ELSE score * (0.5 + 0.5 * r / b) END, 9) AS score FROM ft LEFT JOIN rr ON rr.query_id = ft.query_id AND rr.node_id = ft.node_id LEFT JOIN bm ON bm.query_id = ft.query_id),
    bt AS ({top('bl', 2 * k)}), con AS MATERIALIZED (SELECT node_id AS a, node_id + 20 AS b FROM nodes WHERE node_id % 3 = 0 UNION SELECT node_id + 20, node_id FROM nodes WHERE node_id % 3 = 0),
    x1 AS (SELECT bt.query_id, l.*, score * CASE WHEN coalesce(valid_to <= TIMESTAMP '1997-03-01', false) THEN 0.3 ELSE 1.0 END * (1 + 0.05 * (l.node_id % 4)) AS sc, EXISTS (SELECT 1 FROM con WHERE con.a = l.node_id AND con.b IN (SELECT node_id FROM live)) AS unresolved FROM bt JOIN live l ON l.node_id = bt.node_id),
    x2 AS (SELECT *, CASE WHEN layer = 'memory' THEN sc * 0.7 + 0.3 * CASE WHEN age_hours <= 0 THEN 1.0 ELSE greatest(0.25, exp(-0.5 * pow(age_hours / 24 / 90, 2))) END WHEN layer = 'knowledge' THEN sc * (1 + 0.2 * log10(1 + node_id % 4)) WHEN layer = 'wisdom' AND node_id % 5 = 0 THEN sc * 0.5 ELSE sc END AS sl FROM x1),
    x3 AS (SELECT query_id, node_id, layer, round(CASE WHEN layer IN ('knowledge', 'wisdom') THEN sl * (0.7 + 0.3 * greatest(0, least(1, coalesce(confidence, 1)))) ELSE sl END * CASE WHEN unresolved THEN 0.5 ELSE 1.0 END, 6) AS score FROM x2),
    h AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM x3), a0 AS (SELECT query_id, node_id FROM h WHERE false)"""
    for i in range(1, 2 * k + 1):
        text += f", a{i} AS MATERIALIZED (SELECT * FROM a{i - 1} UNION ALL SELECT query_id, node_id FROM h WHERE rank = {i} AND NOT EXISTS (SELECT 1 FROM a{i - 1} s JOIN con ON con.a = s.node_id WHERE s.query_id = h.query_id AND con.b = h.node_id))"
    text += f""", z AS (SELECT h.query_id, h.node_id, h.score FROM h JOIN a{2 * k} s ON s.query_id = h.query_id AND s.node_id = h.node_id WHERE score >= CASE WHEN layer = 'memory' THEN 0.2 WHEN layer IN ('knowledge', 'wisdom') THEN 0.25 ELSE 0.15 END),
    zt AS ({top('z', k)}), ql AS (SELECT query_id, round(avg(score), 9) AS s FROM zt GROUP BY 1)"""
    return text + " SELECT zt.*, CASE WHEN s > 0.6 THEN 'high' WHEN s >= 0.4 THEN 'partial' WHEN s > 0 THEN 'low' ELSE 'none' END AS quality FROM zt JOIN ql ON ql.query_id = zt.query_id"


def _paths_sql(most: int) -> str:
    text = """, u AS MATERIALIZED (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), ab AS (SELECT s_suppkey AS a, s_suppkey + 1 AS b FROM supplier UNION SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT s_suppkey, -s_suppkey FROM supplier),
    r0 AS (SELECT a, b, a AS id, 0 AS hops FROM ab WHERE a IN (SELECT src FROM u))"""
    for i in range(1, most + 1):
        text += f""", f{i} AS (SELECT DISTINCT r.a, r.b, u.dst AS id, {i} AS hops FROM r{i - 1} r JOIN u ON u.src = r.id WHERE r.hops = {i - 1}),
        r{i} AS MATERIALIZED (SELECT * FROM r{i - 1} UNION ALL SELECT f.* FROM f{i} f WHERE NOT EXISTS (SELECT 1 FROM r{i - 1} r WHERE r.a = f.a AND r.b = f.b AND r.id = f.id))"""
    text += f", p0 AS (SELECT a, b, hops AS place, id FROM r{most} WHERE id = b)"
    for i in range(1, most + 1):
        text += f", p{i} AS (SELECT p.a, p.b, p.place - 1 AS place, min(r.id) AS id FROM p{i - 1} p JOIN u ON u.src = p.id JOIN r{most} r ON r.a = p.a AND r.b = p.b AND r.id = u.dst AND r.hops = p.place - 1 GROUP BY 1, 2, 3)"
    return text + " " + " UNION ALL ".join(f"SELECT a, b, CAST(place AS INT) AS place, id AS node_id FROM p{i}" for i in range(most + 1))


def _time_queries(t: Tables):
    return t.nation.select(F.col("n_nationkey").cast("long").alias("query_id"), F.make_timestamp_ntz(F.lit(1996), F.col("n_nationkey").cast("int") % 12 + 1, F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("start"), F.lit("1997-03-01").cast("timestamp_ntz").alias("end"))


def _phrases(t: Tables):
    words = ["today", "yesterday", "last 3 days", "past 2 weeks", "5 days ago", "this month", "last year", "since monday", "on friday", "7d", "2w", "no time here"]
    return t.nation.select("n_nationkey", F.element_at(F.array(*[F.lit(w) for w in words]), F.col("n_nationkey") % len(words) + 1).alias("text"))


def _heat_edges(t: Tables):
    return t.edges.select("src", "dst", "edge_type", F.when(F.col("src") % 3 == 0, None).otherwise(F.round("weight", 4)).alias("edge_heat"))


def _heated(t: Tables):
    """Suppliers with heat, parts without."""
    own = t.supplier.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 10 / 10).alias("heat"))
    return own.union(t.part.select(-F.col("p_partkey"), F.lit(None).cast("double")))


def _layered(t: Tables):
    ids = t.edges.select(F.col("src").alias("id")).union(t.edges.select("dst")).distinct()
    return ids.withColumn("layer", F.element_at(F.array(F.lit("memory"), F.lit("wisdom"), F.lit("knowledge")), (F.abs("id") % 3 + 1).cast("int")))


def _prior(t: Tables, edges=None):
    e = t.edges if edges is None else edges
    ids = e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id"))).distinct()
    return ids.select("id", ((F.abs("id") % 10) / 10).alias("credibility"))


def _dtw_pairs(t: Tables):
    seq = t.vectors.where("node_id < 60").groupBy((F.col("node_id") % 12).alias("g")).agg(F.transform(F.sort_array(F.collect_list(F.struct("node_id", "embedding"))), lambda x: F.slice(x["embedding"], 1, 4).cast("array<double>")).alias("s"))
    return seq.alias("x").join(seq.alias("y"), F.col("x.g") + 1 == F.col("y.g")).select(F.col("x.g").alias("id"), F.col("x.s").alias("a"), F.col("y.s").alias("b"))


def _dominance(t: Tables):
    pairs = t.orders.select(F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b")).where("a <> b").distinct()
    ids = pairs.select(F.col("a").alias("node_id")).union(pairs.select("b")).distinct()
    return L.dominated(pairs, ids.withColumn("place", F.col("node_id") % 97 * 10_000_000 + F.col("node_id")))


def _ppr_sql(rounds: int, seeds: str = "src % 10 = 0", tolerance: float = 1e-6) -> str:
    """All rounds; the first that moves less than the tolerance is the result, else the last."""
    text = """, e0 AS (SELECT src, dst, sum(weight) AS w FROM edges WHERE weight > 0 GROUP BY 1, 2), e AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM e0),
    s AS MATERIALIZED (SELECT src AS id, 1.0 / count(*) OVER () AS r FROM (SELECT DISTINCT src FROM edges WHERE SEEDS)), k0 AS (SELECT id, r AS rank FROM s)""".replace("SEEDS", seeds)
    for i in range(1, rounds + 1):
        text += f""", m{i} AS MATERIALIZED (SELECT dst AS id, sum(rank * p) AS m FROM k{i - 1} JOIN e ON id = src GROUP BY 1),
        k{i} AS MATERIALIZED (SELECT coalesce(m{i}.id, s.id) AS id, 0.85 * coalesce(m, 0) + coalesce(r, 0) * (1 - 0.85 * (SELECT coalesce(sum(m), 0) FROM m{i})) AS rank FROM m{i} FULL JOIN s ON m{i}.id = s.id)"""
    text += ", steps AS (" + " UNION ALL ".join(f"SELECT {i} AS i, sum(abs(coalesce(a.rank, 0) - coalesce(b.rank, 0))) AS d FROM k{i} a FULL JOIN k{i - 1} b ON a.id = b.id" for i in range(1, rounds + 1)) + ")"
    text += f", stop AS (SELECT coalesce(min(i) FILTER (d < {tolerance}), {rounds}) AS i FROM steps), every AS (" + " UNION ALL ".join(f"SELECT {i} AS i, * FROM k{i}" for i in range(1, rounds + 1)) + ")"
    return text + " SELECT id, round(rank, 6) AS rank FROM every WHERE i = (SELECT i FROM stop)"


def stopped(rounds: int, tolerance: float, value: str, back: int = 0, digits: int = 6) -> str:
    """Of x0 .. x<rounds> (``id, x``) the first that moved no x by the tolerance (or ``back`` before it), else the last."""
    steps = " UNION ALL ".join(f"SELECT {i} AS i, max(abs(a.x - b.x)) AS d FROM x{i} a JOIN x{i - 1} b ON a.id = b.id" for i in range(1, rounds + 1))
    every = " UNION ALL ".join(f"SELECT {i} AS i, id, x FROM x{i}" for i in range(rounds + 1))
    return f", steps AS ({steps}), every AS ({every}) SELECT id, round(x, {digits}) AS {value} FROM every WHERE i = (SELECT coalesce(min(i) FILTER (d < {tolerance}) - {back}, {rounds}) FROM steps)"


def _propagate_sql(rounds: int) -> str:
    """Rounds enough for these tables, where one node (0) is its own neighbour."""
    text = """, ids AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges), p AS (SELECT id, abs(id) % 10 / 10.0 AS c FROM ids),
    e0 AS (SELECT src, dst, edge_type, max(weight) AS w FROM edges WHERE edge_type IN ('SUPPORTS', 'CONTRADICTS') GROUP BY 1, 2, 3),
    e AS MATERIALIZED (SELECT src, dst, CASE edge_type WHEN 'SUPPORTS' THEN 1.0 ELSE -1.0 END * w / sum(w) OVER (PARTITION BY dst, edge_type) AS w FROM e0), x0 AS (SELECT id, c AS x FROM p)"""
    for i in range(1, rounds + 1):
        text += f""", x{i} AS MATERIALIZED (SELECT p.id, CASE WHEN f.s IS NULL THEN c ELSE greatest(0, least(1, 0.2 * c + 0.8 * f.s)) END AS x
        FROM p LEFT JOIN (SELECT dst, sum(w * x) AS s FROM x{i - 1} JOIN e ON id = src GROUP BY 1) f ON f.dst = p.id)"""
    return text + stopped(rounds, 1e-6, "confidence")


def _labels_sql(rounds: int) -> str:
    text = ", u AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), l0 AS (SELECT DISTINCT src AS id, src AS label FROM u)"
    for i in range(1, rounds + 1):
        text += f""", v{i} AS (SELECT src, label, count(*) AS n FROM u JOIN l{i - 1} ON id = dst GROUP BY 1, 2),
        l{i} AS (SELECT src AS id, label FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, label) AS k FROM v{i}) WHERE k = 1)"""
    return text + f" SELECT id, label FROM l{rounds}"


def _diffuse_sql(depth: int) -> str:
    text = """, w AS (SELECT src, dst, CASE edge_type WHEN 'SUPPORTS' THEN 0.9 WHEN 'CONTRADICTS' THEN 0.95 ELSE 0.8 END * coalesce(CASE WHEN src % 3 = 0 THEN NULL ELSE round(weight, 4) END, 0.5) * 0.7 AS w FROM edges),
    e AS (SELECT src, dst, max(w) AS w FROM (SELECT * FROM w UNION ALL SELECT dst, src, w FROM w) GROUP BY 1, 2),
    b0 AS (SELECT s_suppkey AS id, s_suppkey % 10 / 10.0 AS heat FROM supplier WHERE s_suppkey % 10 / 10.0 >= 0.5)"""
    for i in range(1, depth + 1):
        text += f", b{i} AS (SELECT id, max(heat) AS heat FROM (SELECT * FROM b{i - 1} UNION ALL SELECT dst, heat * w FROM b{i - 1} JOIN e ON id = src WHERE heat * w >= 0.01) GROUP BY 1)"
    return text + f" SELECT id, round(heat, 6) AS heat FROM b{depth} WHERE id NOT IN (SELECT id FROM b0)"



def _tree(t: Tables):
    return t.orders.where("o_orderkey > 0").select(F.col("o_orderkey").alias("src"), F.expr("o_orderkey div 3").alias("dst"), F.lit("DERIVED_FROM").alias("edge_type"))


CASES = {
    # scalar functions
    "f1_cosine": (
        lambda t: t.vectors.alias("a").join(t.vectors.alias("b"), F.col("a.node_id") + 1 == F.col("b.node_id")).select(F.col("a.node_id").alias("node_id"), F.round(X.cosine("a.embedding", "b.embedding"), 6).alias("score")),
        f"SELECT a.node_id, {SIM} AS score FROM vectors a JOIN vectors b ON a.node_id + 1 = b.node_id",
    ),
    "f2_freshness": (lambda t: r6(t.nodes.select("node_id", X.freshness(F.col("age_hours") / 24 - 3).alias("f")), "f"), "SELECT node_id, round(CASE WHEN age_hours / 24 - 3 <= 0 THEN 1.0 ELSE greatest(0.25, exp(-0.5 * pow((age_hours / 24 - 3) / 30, 2))) END, 6) AS f FROM nodes"),
    "f3_half_life": (lambda t: r6(t.nodes.select("node_id", X.half_life(F.col("age_hours") / 24, 7.0).alias("f")), "f"), "SELECT node_id, round(pow(0.5, age_hours / 24 / 7), 6) AS f FROM nodes"),
    "f4_heat_contribution": (lambda t: r6(t.events.select("event_id", X.heat_contribution("value").alias("h")), "h"), "SELECT event_id, round(least(1, ln(1 + value) / ln(10001)), 6) AS h FROM events"),
    "f5_tier_level": (
        lambda t: t.nodes.select("node_id", X.tier("heat_score").alias("tier"), X.level("heat_score").alias("level")),
        "SELECT node_id, CASE WHEN heat_score >= 0.66 THEN 'HOT' WHEN heat_score >= 0.33 THEN 'WARM' ELSE 'COLD' END AS tier, CASE WHEN heat_score >= 0.66 THEN 'FULL' WHEN heat_score >= 0.33 THEN 'WARM' WHEN heat_score >= 0.1 THEN 'STRUCTURE' ELSE 'MINIMAL' END AS level FROM nodes",
    ),
    "f6_decay_multiplier": (
        lambda t: t.nodes.groupBy(X.decay_multiplier(F.when(F.col("layer") == "knowledge", "Fact").when(F.col("layer") == "wisdom", "Commitment").otherwise("Claim")).alias("m")).agg(F.count("*").alias("n")),
        "SELECT CAST(CASE layer WHEN 'knowledge' THEN 2.0 WHEN 'wisdom' THEN 3.0 ELSE 1.0 END AS DOUBLE) AS m, count(*) AS n FROM nodes GROUP BY 1",
    ),
    "f7_credibility": (
        lambda t: r6(t.claims.select("claim_id", X.credibility("source_tier", F.when(F.col("claim_id") % 2 == 0, "direct").otherwise("experimental"), "confidence", F.col("evidence") % 5).alias("c")), "c"),
        """SELECT claim_id, round(CASE source_tier WHEN 'authoritative' THEN 1.0 WHEN 'validated' THEN 0.85 WHEN 'community' THEN 0.6 ELSE 0.4 END * CASE WHEN claim_id % 2 = 0 THEN 1.0 ELSE 0.6 END
        * greatest(0, least(1, confidence)) * (1 - exp(-0.5 * greatest(1, evidence % 5))), 6) AS c FROM claims""",
    ),
    "f8_memory_decay": (lambda t: r6(t.nodes.select("node_id", X.memory_decay("confidence", "age_hours").alias("c")), "c"), "SELECT node_id, round(greatest(0, least(1, confidence * pow(0.95, age_hours))), 6) AS c FROM nodes"),
    "f9_tombstone_eligible": (
        lambda t: t.nodes.select("node_id", X.tombstone_eligible("decay_class", "age_hours", "heat_score").alias("gone")),
        "SELECT node_id, CASE decay_class WHEN 'ephemeral' THEN age_hours >= 24 WHEN 'standard' THEN age_hours >= 168 AND heat_score < 0.3 WHEN 'durable' THEN age_hours >= 720 AND heat_score < 0.2 ELSE false END AS gone FROM nodes",
    ),
    "f10_effective_confidence": (lambda t: r6(t.claims.select("claim_id", X.effective_confidence(F.when(F.col("claim_id") % 5 == 0, None).otherwise(F.col("confidence") * 3 - 0.5)).alias("c")), "c"), "SELECT claim_id, round(greatest(0, least(1, coalesce(CASE WHEN claim_id % 5 = 0 THEN NULL ELSE confidence * 3 - 0.5 END, 1))), 6) AS c FROM claims"),
    "f11_content_id": (lambda t: t.claims.select("claim_id", X.content_id("subject", "predicate", "object").alias("id")), "SELECT claim_id, sha256(concat_ws('|', CAST(subject AS VARCHAR), predicate, object)) AS id FROM claims"),
    "f12_pair_id": (lambda t: t.edges.select("src", "dst", "edge_type", X.pair_id("src", "dst", "link").alias("id")), "SELECT src, dst, edge_type, sha256(concat_ws('|', 'link', CAST(least(src, dst) AS VARCHAR), CAST(greatest(src, dst) AS VARCHAR))) AS id FROM edges"),
    "f13_glob_match": (lambda t: t.pages.select("page_id", "url", F.explode(F.array(F.lit("http://m.*"), F.lit("*/en/*"))).alias("g")).withColumn("r", X.glob_regex("g")).groupBy("page_id").agg(F.bool_or(F.expr("rlike(url, r)")).alias("hit")), "SELECT page_id, url GLOB 'http://m.*' OR url GLOB '*/en/*' AS hit FROM pages"),
    "f15_trigram_similarity": (
        lambda t: r6(t.part.select("p_partkey", X.trigram_similarity("p_brand", "p_type").alias("s")), "s"),
        """SELECT p_partkey, round(CAST(len(list_intersect(x, y)) AS DOUBLE) / len(list_distinct(list_concat(x, y))), 6) AS s FROM (SELECT p_partkey,
        list_distinct(list_transform(range(1, CAST(length(p_brand) + 2 AS BIGINT)), lambda i: substr('  ' || lower(p_brand) || ' ', CAST(i AS INT), 3))) AS x,
        list_distinct(list_transform(range(1, CAST(length(p_type) + 2 AS BIGINT)), lambda i: substr('  ' || lower(p_type) || ' ', CAST(i AS INT), 3))) AS y FROM part)""",
    ),
    "f14_text_ratio": (lambda t: r6(M.text_ratio(t.benchmark.alias("a").join(t.benchmark.alias("b"), F.col("a.item_id") + 1 == F.col("b.item_id")).select(F.col("a.item_id").alias("id"), F.col("a.text").alias("a"), F.col("b.text").alias("b"))), "ratio"), None),
    "f18_time_range": (
        lambda t: _phrases(t).select("n_nationkey", X.time_range("text", ts("2024-01-31 12:00:00")).alias("r")).select("n_nationkey", F.col("r.start").cast("string").alias("start"), F.col("r.end").cast("string").alias("end")),
        """SELECT n_nationkey, CASE n_nationkey % 12 WHEN 0 THEN '2024-01-31 00:00:00' WHEN 1 THEN '2024-01-30 00:00:00' WHEN 2 THEN '2024-01-28 12:00:00' WHEN 3 THEN '2024-01-17 12:00:00' WHEN 4 THEN '2024-01-26 00:00:00'
        WHEN 5 THEN '2024-01-01 00:00:00' WHEN 6 THEN '2023-01-01 00:00:00' WHEN 7 THEN '2024-01-29 00:00:00' WHEN 8 THEN '2024-01-26 00:00:00' WHEN 9 THEN '2024-01-24 12:00:00' WHEN 10 THEN '2024-01-17 12:00:00' END AS start,
        CASE n_nationkey % 12 WHEN 1 THEN '2024-01-31 00:00:00' WHEN 4 THEN '2024-01-27 00:00:00' WHEN 6 THEN '2024-01-01 00:00:00' WHEN 8 THEN '2024-01-27 00:00:00' WHEN 11 THEN NULL ELSE '2024-01-31 12:00:00' END AS "end" FROM nation""",
    ),
    "f21_json_props": (lambda t: t.events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")), "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "f21_typed_props": (
        lambda t: t.events.select("event_id", *X.typed_props(
            F.when(F.col("event_id") % 50 == 0, '{"k": ').when(F.col("event_id") % 77 == 0, None).otherwise(F.concat(
                F.lit('{"k": '), F.when(F.col("event_id") % 9 == 0, F.lit('"x"')).otherwise(F.col("user_id").cast("string")), F.lit(', "kind": "'), "event_type", F.lit('", "score": '), F.col("value").cast("string"),
                F.lit(', "step": {"n": '), (F.col("event_id") % 7).cast("string"), F.lit(', "done": '), (F.col("event_id") % 2 == 0).cast("string"), F.lit('}, "tags": ["a", "'), "event_type", F.lit('"]}'))),
            {"k": ("$.k", "bigint"), "kind": ("$.kind", "string"), "score": ("$.score", "double"), "n": ("$.step.n", "bigint"), "done": ("$.step.done", "boolean"), "tag": ("$.tags[1]", "string"), "none": ("$.step.none", "string")},
        )),
        """, e AS (SELECT *, event_id % 50 > 0 AND event_id % 77 > 0 AS ok FROM events)
        SELECT event_id, CASE WHEN ok AND event_id % 9 > 0 THEN user_id END AS k, CASE WHEN ok THEN event_type END AS kind, CASE WHEN ok THEN value END AS score, CASE WHEN ok THEN event_id % 7 END AS n,
          CASE WHEN ok THEN event_id % 2 = 0 END AS done, CASE WHEN ok THEN event_type END AS tag, CAST(NULL AS VARCHAR) AS none, ok AS valid FROM e""",
    ),
    "f22_inline_summary": (
        lambda t: t.versions.groupBy("chain_id").agg(F.sort_array(F.collect_list(F.struct("node_id", F.col("node_id").cast("string").alias("text")))).alias("s")).select("chain_id", X.inline_summary("s").alias("summary")),
        "SELECT chain_id, string_agg(CAST(node_id AS VARCHAR), ' -> ' ORDER BY node_id) AS summary FROM versions GROUP BY 1",
    ),
    "f23_tier_from_uri": (lambda t: t.pages.groupBy(X.tier_from_uri("url").alias("tier")).agg(F.count("*").alias("n")), "SELECT CASE WHEN contains(url, 'arxiv') THEN 'authoritative' WHEN url <> '' THEN 'validated' ELSE 'community' END AS tier, count(*) AS n FROM pages GROUP BY 1"),
    "f24_canonical_url": (
        lambda t: t.pages.select("page_id", X.canonical_url("url").alias("url")),
        """, p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages), q AS (SELECT page_id, lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) AS s, lower(regexp_extract(u, '^[A-Za-z]+://([^/?]*)', 1)) AS h,
        rtrim(regexp_extract(u, '^[A-Za-z]+://[^/?]*([^?]*)', 1), '/') AS path, list_sort(list_filter(regexp_split_to_array(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z]+|gclid|fbclid|ref|mc_[a-z]+)(=|$)'))) AS a FROM p)
        SELECT page_id, s || '://' || regexp_replace(h, '^www\\.', '') || path || CASE WHEN len(a) > 0 THEN '?' || array_to_string(a, '&') ELSE '' END AS url FROM q""",
    ),
    # similarity
    "t1_dense_topk": (
        lambda t: M.nearest(t.vectors.where("node_id % 20 = 0"), t.vectors, 10).select("query_id", "node_id", "score"),
        f", {knn('a.node_id % 20 = 0', 10, -1)} SELECT query_id, node_id, score FROM near",
    ),
    "j8_contradiction_candidates": (lambda t: M.contradiction_candidates(t.vectors, 20, 0.4), f", {knn('true', 20, 0.4)} SELECT query_id, node_id, score FROM near"),
    "j9_affinity_edges": (lambda t: M.affinity_edges(t.vectors, 3, 0.3), f", {knn('true', 3, 0.3)} SELECT query_id AS src, node_id AS dst, score AS weight FROM near"),
    "j10_weak_links": (
        lambda t: M.weak_links(t.vectors, t.vectors.where("node_id % 3 = 0").select(F.col("node_id").alias("src"), (F.col("node_id") + 1).alias("dst")), 6, 0.3, 4),
        f""", {knn('true', 6, 0.3)}, f AS (SELECT * FROM near WHERE NOT EXISTS (SELECT 1 FROM vectors v WHERE v.node_id % 3 = 0 AND v.node_id = least(query_id, near.node_id) AND v.node_id + 1 = greatest(query_id, near.node_id))),
        p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS place FROM f)
        SELECT least(query_id, node_id) AS a, greatest(query_id, node_id) AS b, round(max(score * 0.5), 6) AS weight FROM p WHERE place <= 4 - CASE WHEN query_id % 3 = 0 THEN 1 ELSE 0 END GROUP BY 1, 2""",
    ),
    "w12_suggest_tags": (
        lambda t: M.suggest_tags(t.vectors.where("node_id % 2 = 1"), t.vectors.where("node_id % 10 = 0"), 0.1, 5),
        f", {knn('a.node_id % 2 = 1 AND b.node_id % 10 = 0', 5, 0.1)} SELECT query_id AS node_id, node_id AS tag_id, score FROM near",
    ),
    # retrieval
    "t2_sparse_topk": (lambda t: R.bm25(_queries(t), t.nodes, 10), f", {BM25} {top('raw', 10)}"),
    "t5_grep_channel": (
        lambda t: R.grep_channel(_queries(t), t.nodes, 10),
        f""", {TOKENS}, five AS (SELECT DISTINCT query_id, unnest(ws) AS token FROM (SELECT item_id AS query_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 3)[1:5] AS ws FROM benchmark)),
        raw AS (SELECT query_id, node_id, CAST(count(*) AS DOUBLE) AS score FROM terms JOIN five ON five.token = terms.token GROUP BY 1, 2) {top('raw', 10)}""",
    ),
    "t6_temporal_channel": (
        lambda t: R.temporal_channel(_time_queries(t), t.versions.withColumn("layer", F.when(F.col("node_id") % 9 > 0, "memory").otherwise("wisdom")), 10),
        """, q AS (SELECT CAST(n_nationkey AS BIGINT) AS query_id, make_timestamp(1996, n_nationkey % 12 + 1, 1, 0, 0, 0) AS s, TIMESTAMP '1997-03-01' AS e FROM nation),
        raw AS (SELECT query_id, node_id, round(CASE WHEN node_id % 9 > 0 THEN pow(0.5, date_diff('second', valid_from, e) / 86400 / 7) ELSE 1.0 END, 6) AS score FROM q JOIN versions ON valid_from BETWEEN s AND e) """ + top("raw", 10),
    ),
    "t3_hybrid_fusion": (
        lambda t: R.fuse({"bm25": R.bm25(_queries(t), t.nodes, 20), "grep": R.grep_channel(_queries(t), t.nodes, 20)}, 10).select("query_id", "node_id", "score", "rank"),
        f""", {BM25}, five AS (SELECT DISTINCT query_id, unnest(ws) AS token FROM (SELECT item_id AS query_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 3)[1:5] AS ws FROM benchmark)),
        g AS (SELECT query_id, node_id, CAST(count(*) AS DOUBLE) AS score FROM terms JOIN five ON five.token = terms.token GROUP BY 1, 2),
        ch AS (SELECT query_id, node_id, 'a' AS c, rank FROM ({top('raw', 20)}) UNION ALL SELECT query_id, node_id, 'b', rank FROM ({top('g', 20)})),
        n AS (SELECT query_id, count(DISTINCT c) AS n FROM ch GROUP BY 1), f AS (SELECT ch.query_id, node_id, round(sum(1.0 / (60 + rank)) / (any_value(n) / 61.0), 9) AS score FROM ch JOIN n ON n.query_id = ch.query_id GROUP BY 1, 2) {top('f', 10)}""",
    ),
    "t3_hybrid_topk": (
        lambda t: R.hybrid_topk(
            _queries(t).join(t.vectors.select(F.col("node_id").alias("query_id"), "embedding"), "query_id").select("query_id", F.when(F.col("query_id") % 4 == 0, "").otherwise(F.col("text")).alias("text"), "embedding"),
            t.nodes, t.vectors, 10,
        ),
        f""", {knn('a.node_id IN (SELECT item_id FROM benchmark)', 20, -1)}, {BM25.replace("FROM benchmark)", "FROM benchmark WHERE item_id % 4 > 0 AND item_id IN (SELECT node_id FROM vectors))")},
        ch AS (SELECT query_id, node_id, 'a' AS c, rank FROM ({top('raw', 20)}) UNION ALL SELECT query_id, node_id, 'b', rank FROM near),
        n AS (SELECT query_id, count(DISTINCT c) AS n FROM ch GROUP BY 1), f AS (SELECT ch.query_id, node_id, round(sum(1.0 / (60 + rank)) / (any_value(n) / 61.0), 9) AS score FROM ch JOIN n ON n.query_id = ch.query_id GROUP BY 1, 2)
        SELECT z.*, NOT z.query_id IN (SELECT query_id FROM raw) AS fallback FROM ({top('f', 10)}) z""",
    ),
    "t8_rerank_blend": (
        lambda t: r6(R.rerank_blend(t.nodes.select((F.col("node_id") % 5).alias("query_id"), "node_id", F.col("confidence").alias("score")), t.labels.select((F.col("doc_id") % 5).alias("query_id"), F.col("doc_id").alias("node_id"), ((F.col("doc_id") % 17) / 17).alias("rescore"))), "score").select("query_id", "node_id", "score"),
        """, j AS (SELECT node_id % 5 AS query_id, node_id, confidence AS score, CASE WHEN quality IS NULL AND toxic IS NULL THEN NULL ELSE node_id % 17 / 17 END AS r FROM nodes), m AS (SELECT query_id, max(r) AS b FROM j GROUP BY 1)
        SELECT j.query_id, node_id, round(round(CASE WHEN r IS NULL OR b <= 0 THEN score ELSE score * (0.5 + 0.5 * r / b) END, 9), 6) AS score FROM j JOIN m ON m.query_id = j.query_id""",
    ),
    "t10_layer_scoring": (
        lambda t: r6(t.nodes.select("node_id", R.layer_scoring(F.col("heat_score"), F.col("layer"), F.col("age_hours") / 24, F.col("node_id") % 9, F.col("node_id") % 2 == 0).alias("score")), "score"),
        """SELECT node_id, round(CASE WHEN layer = 'memory' THEN heat_score * 0.7 + CASE WHEN age_hours <= 0 THEN 1.0 ELSE greatest(0.25, exp(-0.5 * pow(age_hours / 24 / 90, 2))) END * 0.3 WHEN layer = 'knowledge' THEN heat_score * (1 + 0.2 * log10(1 + node_id % 9))
          WHEN layer = 'wisdom' AND node_id % 2 = 0 THEN heat_score * 0.5 ELSE heat_score END, 6) AS score FROM nodes""",
    ),
    "t11_epistemic_fusion": (
        lambda t: r6(t.nodes.select("node_id", R.epistemic_fusion(F.col("heat_score"), F.col("layer"), F.col("confidence"), F.col("node_id") % 5 == 0).alias("score")), "score"),
        """SELECT node_id, round(CASE WHEN layer IN ('knowledge', 'wisdom') THEN heat_score * (0.7 + 0.3 * confidence) ELSE heat_score END * CASE WHEN node_id % 5 = 0 THEN 0.5 ELSE 1 END, 6) AS score FROM nodes""",
    ),
    "t12_freshness_heat_rescore": (
        lambda t: r6(t.nodes.select("node_id", R.freshness_heat_rescore(F.col("heat_score"), F.col("age_hours") / 24, F.col("heat_score")).alias("score")), "score"),
        """SELECT node_id, round(heat_score * (0.7 + 0.3 * CASE WHEN age_hours <= 0 THEN 1.0 ELSE greatest(0.25, exp(-0.5 * pow(age_hours / 24 / 30, 2))) END) * (0.9 + 0.1 * heat_score), 6) AS score FROM nodes""",
    ),
    "t9_epistemic_boost": (
        lambda t: r6(t.nodes.select("node_id", R.epistemic_boost(F.col("heat_score"), F.col("state") == "SUPERSEDED", F.col("node_id") % 9).alias("score")), "score"),
        """SELECT node_id, round(heat_score * CASE WHEN state = 'SUPERSEDED' THEN 0.3 ELSE 1 END * (1 + 0.05 * least(node_id % 9, 5)), 6) AS score FROM nodes""",
    ),
    "t4_text_channel": (lambda t: R.text_channel(_queries(t), t.nodes, 10), f", {BM25}, {TEXT} {top('txt', 10)}"),
    "t13_recall": (_recall, _recall_sql(10, 10)),
    "t17_ranking_eval": (
        lambda t: R.ranking_eval(
            keep_top(t.nodes.select((F.col("node_id") % 5).alias("query_id"), "node_id", F.col("heat_score").alias("score")), ["query_id"], [F.desc("score"), F.col("node_id")], 50),
            t.nodes.select((F.col("node_id") % 5).alias("query_id"), F.col("node_id").alias("expected_id"), (F.col("node_id") + 50).alias("lower_id"), (F.col("node_id") + 35).alias("absent_id")), 10,
        ).groupBy("query_id", "found", "above", "absent").agg(F.count("*").alias("n"), F.sum("at").alias("at")),
        """, k AS (SELECT * FROM (SELECT node_id % 5 AS query_id, node_id, row_number() OVER (PARTITION BY node_id % 5 ORDER BY heat_score DESC, node_id) AS rank FROM nodes) WHERE rank <= 50),
        x AS (SELECT n.node_id % 5 AS query_id, e.rank AS er, l.rank AS lr, a.rank AS ar FROM nodes n LEFT JOIN k e ON e.query_id = n.node_id % 5 AND e.node_id = n.node_id LEFT JOIN k l ON l.query_id = n.node_id % 5 AND l.node_id = n.node_id + 50
          LEFT JOIN k a ON a.query_id = n.node_id % 5 AND a.node_id = n.node_id + 35)
        SELECT query_id, coalesce(er <= 10, false) AS found, er IS NOT NULL AND (lr IS NULL OR er < lr) AS above, coalesce(ar > 10, true) AS absent, count(*) AS n, CAST(sum(coalesce(er, 0)) AS BIGINT) AS at FROM x GROUP BY 1, 2, 3, 4""",
    ),
    # graph
    "g1_personalized_pagerank": (lambda t: r6(G.personalized_pagerank(t.edges, t.edges.where("src % 10 = 0").select(F.col("src").alias("id")).distinct().withColumn("weight", F.lit(1.0))), "rank"), _ppr_sql(50)),
    "g3_propagate_confidence": (lambda t: r6(G.propagate_confidence(_prior(t), t.edges), "confidence"), _propagate_sql(20)),
    "g5_diffuse_heat": (lambda t: r6(G.diffuse_heat(t.supplier.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 10 / 10).alias("heat")), _heat_edges(t)), "heat"), _diffuse_sql(3)),
    "g5_heat_levels": (
        lambda t: r6(r6(G.heat_levels(_heated(t).withColumn("propagated", F.when(F.col("id") % 3 < 0, 0.25)), G.diffuse_heat(_heated(t), _heat_edges(t))), "propagated"), "effective"),
        f"""{_diffuse_sql(3).rpartition(" SELECT id, round")[0]}, r AS (SELECT * FROM b3 WHERE id NOT IN (SELECT id FROM b0)), n AS (SELECT s_suppkey AS id, s_suppkey % 10 / 10.0 AS own, CAST(NULL AS DOUBLE) AS old FROM supplier UNION ALL SELECT -p_partkey, NULL, CASE WHEN p_partkey % 3 > 0 THEN 0.25 END FROM part),
        j AS (SELECT n.id, coalesce(r.heat, old * 0.5) AS p, least(1, coalesce(own, 0) + coalesce(r.heat, old * 0.5, 0)) AS f FROM n LEFT JOIN r ON r.id = n.id)
        SELECT id, round(p, 6) AS propagated, round(f, 6) AS effective, CASE WHEN round(f, 9) >= 0.66 THEN 'FULL' WHEN round(f, 9) >= 0.33 THEN 'WARM' WHEN round(f, 9) >= 0.1 THEN 'STRUCTURE' ELSE 'MINIMAL' END AS level FROM j""",
    ),
    "g6_neighborhood": (
        lambda t: G.neighborhood(t.edges, t.edges.where("src = 3").select(F.col("src").alias("id")), 2),
        """, u AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), h1 AS (SELECT DISTINCT dst AS id FROM u WHERE src = 3), h2 AS (SELECT DISTINCT dst AS id FROM u JOIN h1 ON src = id)
        SELECT id, CAST(min(h) AS INT) AS hops FROM (SELECT CAST(3 AS BIGINT) AS id, 0 AS h UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2) GROUP BY 1""",
    ),
    "g6_subgraph": (
        lambda t: G.subgraph(t.edges, _layered(t), t.edges.where("src % 10 = 3").select(F.col("src").alias("id")), 2, ["SUPPORTS", "CAUSES"], ["memory", "wisdom"])[1],
        """, n AS (SELECT DISTINCT id FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges) WHERE abs(id) % 3 < 2), s AS (SELECT DISTINCT src AS id FROM edges WHERE src % 10 = 3), ok AS (SELECT id FROM n UNION SELECT id FROM s),
        e AS MATERIALIZED (SELECT DISTINCT src, dst, edge_type FROM edges WHERE edge_type IN ('SUPPORTS', 'CAUSES') AND src IN (SELECT id FROM ok) AND dst IN (SELECT id FROM ok)), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
        h1 AS (SELECT id FROM s UNION SELECT dst FROM u JOIN s ON id = src), h2 AS (SELECT id FROM h1 UNION SELECT dst FROM u JOIN h1 ON id = src) SELECT * FROM e WHERE src IN (SELECT id FROM h2) AND dst IN (SELECT id FROM h2)""",
    ),
    "u3_two_hop_edges": (
        lambda t: G.two_hop_edges(t.edges, t.edges.where("src = 3").select(F.col("src").alias("id"))),
        ", near AS (SELECT CAST(3 AS BIGINT) AS id UNION SELECT dst FROM edges WHERE src = 3 UNION SELECT src FROM edges WHERE dst = 3) SELECT DISTINCT src, dst, edge_type FROM edges WHERE src IN (SELECT id FROM near) OR dst IN (SELECT id FROM near)",
    ),
    "g7_shortest_path": (lambda t: G.shortest_path(t.edges, 1, 7), None),
    "g7_shortest_paths": (lambda t: G.shortest_paths(t.edges, t.supplier.select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 1).alias("b")).union(t.supplier.select("s_suppkey", F.col("s_suppkey"))).union(t.supplier.select(F.col("s_suppkey"), -F.col("s_suppkey"))), 4), _paths_sql(4)),
    "g8_version_chain": (
        lambda t: G.version_roots(t.versions),
        """SELECT node_id, first_value(node_id) OVER w AS root, CAST(row_number() OVER w - 1 AS INT) AS place FROM versions WINDOW w AS (PARTITION BY chain_id ORDER BY valid_from, node_id)""",
    ),
    "g9_resolve_head": (
        lambda t: G.resolve_head(t.versions, t.versions.where("node_id % 3 = 0").select("node_id"), ts("1998-01-01")),
        """, v AS (SELECT chain_id, arg_max(node_id, (valid_from, node_id)) AS head FROM versions WHERE valid_from <= TIMESTAMP '1998-01-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1998-01-01') GROUP BY 1)
        SELECT node_id, head FROM versions LEFT JOIN v ON v.chain_id = versions.chain_id WHERE node_id % 3 = 0""",
    ),
    "g11_would_cycle": (
        lambda t: G.would_cycle(_tree(t), t.orders.where("o_orderkey % 50 = 0").select(F.expr("o_orderkey div 9").alias("src"), F.col("o_orderkey").alias("dst")).union(t.orders.where("o_orderkey % 50 = 1").select(F.col("o_orderkey").alias("src"), (F.col("o_orderkey") + 1).alias("dst")))),
        """WITH n AS (SELECT DISTINCT o_orderkey // 9 AS src, o_orderkey AS dst FROM orders WHERE o_orderkey % 50 = 0 UNION SELECT o_orderkey, o_orderkey + 1 FROM orders WHERE o_orderkey % 50 = 1)
        SELECT src, dst, src = dst OR src IN (SELECT unnest([dst // 3, dst // 9, dst // 27, dst // 81, dst // 243, dst // 729, dst // 2187, dst // 6561, dst // 19683, dst // 59049])) AND EXISTS (SELECT 1 FROM orders WHERE o_orderkey = dst) AS cycle FROM n""",
    ),
    "g15_invalidate_derived": (
        lambda t: G.invalidate_derived(_tree(t).select(F.col("src").alias("edge_id"), F.col("dst").alias("from_id")), t.orders.where("o_orderkey = 5").select(F.col("o_orderkey").alias("id"))),
        "SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderkey // 3 = 5 OR o_orderkey // 9 = 5 OR o_orderkey // 27 = 5",
    ),
    "g17_cascade_staleness": (
        lambda t: G.cascade_staleness(_tree(t), t.orders.where("o_orderkey = 5").select(F.col("o_orderkey").alias("id")), t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n_supports")), 3),
        """WITH r AS (SELECT DISTINCT o_orderkey AS id, CASE 5 WHEN o_orderkey // 3 THEN 1 WHEN o_orderkey // 9 THEN 2 WHEN o_orderkey // 27 THEN 3 END AS hops FROM orders)
        SELECT id, CAST(hops AS INT) AS hops, CASE WHEN (SELECT count(*) FROM orders WHERE o_custkey = id) < 3 THEN 'tombstone' ELSE 'stale' END AS action FROM r WHERE hops IS NOT NULL""",
    ),
    "g20_label_propagation": (lambda t: G.label_propagation(t.edges), _labels_sql(5)),
    "j14_drop_dominated": (_dominance, None),
    # streams, in batch
    "st1_heat": (
        lambda t: r6(ST.merge_heat(t.nodes.select("node_id", F.col("heat_score").alias("heat")), ST.heat_contributions(t.access_events), 3.5), "heat"),
        """, g AS (SELECT node_id, least(1, ln(1 + sum(CASE access_type WHEN 'read' THEN 1.0 ELSE 0.5 END)) / ln(10001)) AS g FROM access_events GROUP BY 1),
        m AS (SELECT coalesce(n.node_id, g.node_id) AS node_id, least(1, coalesce(heat_score, 0) * pow(0.5, 0.5) + coalesce(g, 0)) AS heat FROM nodes n FULL JOIN g ON g.node_id = n.node_id)
        SELECT node_id, round(heat, 6) AS heat, CASE WHEN heat >= 0.66 THEN 'HOT' WHEN heat >= 0.33 THEN 'WARM' ELSE 'COLD' END AS tier FROM m""",
    ),
    "st2_edge_heat": (lambda t: r6(ST.edge_heat(t.access_events), "heat"), "SELECT node_id, access_type, round(least(1, ln(1 + count(*)) / ln(10001)), 6) AS heat FROM access_events GROUP BY 1, 2"),
    "st3_dedup_access": (lambda t: ST.first_in_window(t.access_events).select("node_id", "entry_id"), "SELECT node_id, min(entry_id) AS entry_id FROM access_events GROUP BY node_id, floor(epoch(date_trunc('second', ts)) / 300)"),
    "st4_touch_count": (
        lambda t: ST.touch_counts(t.access_events),
        "SELECT entry_id, count(*) OVER (PARTITION BY node_id ORDER BY CAST(epoch(date_trunc('second', ts)) AS BIGINT) RANGE BETWEEN 1800 PRECEDING AND CURRENT ROW) AS n_touches FROM access_events",
    ),
    "st6_reflection_budget": (
        lambda t: ST.reflection_budget(t.events, 3),
        "SELECT event_id, CAST(place AS INT) AS place FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS place FROM events) WHERE place <= 3",
    ),
    "st7_sessionize": (
        lambda t: ST.sessionize(t.access_events, "6 hours").groupBy("node_id").agg(F.count("*").alias("n_sessions"), F.max("n_events").alias("longest")),
        """, g AS (SELECT node_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY node_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM access_events),
        c AS (SELECT node_id, sum(s) OVER (PARTITION BY node_id ORDER BY ts) AS k FROM g), z AS (SELECT node_id, k, count(*) AS n FROM c GROUP BY 1, 2) SELECT node_id, count(*) AS n_sessions, max(n) AS longest FROM z GROUP BY 1""",
    ),
    "st11_engagement_heat": (lambda t: ST.engagement_heat(t.events), "SELECT user_id, CAST(sum(CASE event_type WHEN 'view' THEN 0.5 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 0 END) AS DOUBLE) AS heat FROM events GROUP BY 1"),
    "st12_pending_trigger": (lambda t: ST.pending_trigger(t.events, "user_id", 65), "SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 65"),
    "st10_incremental_detect": (
        lambda t: ST.incremental(t.claims, ts("2000-01-01"), lambda df: df.groupBy("subject").agg(F.count("*").alias("n"))),
        "SELECT subject, count(*) AS n FROM claims WHERE created_at > TIMESTAMP '2000-01-01' GROUP BY 1",
    ),
}
