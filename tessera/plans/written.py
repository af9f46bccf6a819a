"""Queries over extraction, encoding and the writing of findings, each over the whole of its rule, with their oracle SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from tessera.operators import knowledge as K
from tessera.plans.rules import joined
from tessera.scratch import materialize
from tessera.sources.fixtures import Tables

_PATTERN = "([A-Z][a-z]+) ([a-z]+) ([a-z]+)"
_read = partial(K.pattern_relations, pattern=_PATTERN)
_RELATIONS = f"""r AS (SELECT node_id, regexp_extract(hit, '{_PATTERN}', 1) AS subject, regexp_extract(hit, '{_PATTERN}', 2) AS predicate, regexp_extract(hit, '{_PATTERN}', 3) AS object, place
  FROM (SELECT node_id, unnest(h) AS hit, generate_subscripts(h, 1) AS place FROM (SELECT node_id, regexp_extract_all(content, '{_PATTERN}') AS h FROM texts)))"""


def _claims(t: Tables):
    docs = t.nodes.select("node_id", "content", (F.col("node_id") % 5 == 0).alias("extracted"))
    words = t.nation.select(F.initcap("n_name").alias("name"), F.col("n_nationkey").alias("entity_id"))
    names = t.documents.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Z]?[a-z]+"), F.lit(0))).alias("name")).distinct()
    names = materialize(names, "names")  # the texts are cut once and not for each table made of their names
    aliases = names.where("length(name) % 3 = 0").select(F.upper("name").alias("alias"), F.length("name").alias("entity_id"))
    entities = names.where("length(name) % 3 = 1").select((F.length("name") + 100).alias("entity_id"), "name", "name")
    entities = entities.toDF("entity_id", "name", "qualified_name").union(words.select("entity_id", "name", "name"))
    public = names.where("length(name) % 2 = 0").select("name")
    dropped = names.where("length(name) = 5").select(F.col("name").alias("subject"), F.lit("and").alias("predicate"), F.col("name").alias("object"))
    ruled, mentions, _ = K.extract_claims(docs, _read, aliases, entities, dropped, ["and", "of", "in", "to", "the"], ["is"], public)
    end = lambda c: mentions.select("claim_id", F.col("name").alias(c), F.when(F.length("entity") == 64, "new").otherwise(F.col("entity")).alias(f"{c}_entity"))
    return ruled.join(end("subject"), ["claim_id", "subject"], "left").join(end("object"), ["claim_id", "object"], "left").drop("claim_id")


_CLAIMS_SQL = rf""", texts AS (SELECT node_id, content FROM nodes WHERE node_id % 5 <> 0), {_RELATIONS},
c AS (SELECT DISTINCT node_id, subject, predicate, object, CAST(0.5 AS DOUBLE) AS confidence FROM r),
names AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Z]?[a-z]+')) AS name FROM documents),
e AS (SELECT lower(name) AS k, min(id) AS id FROM (SELECT name, length(name) + 100 AS id FROM names WHERE length(name) % 3 = 1 UNION ALL SELECT n_name, n_nationkey FROM nation) GROUP BY 1),
w AS (SELECT lower(name) AS k FROM names WHERE length(name) % 2 = 0), d AS (SELECT lower(name) AS k FROM names WHERE length(name) = 5),
x AS (SELECT *, CASE WHEN predicate = 'and' AND lower(subject) = lower(object) AND lower(subject) IN (SELECT k FROM d) THEN 'hard_drop' WHEN predicate <> 'is' AND predicate IN ('and', 'of', 'in', 'to', 'the')
  AND lower(subject) IN (SELECT k FROM w) AND lower(object) IN (SELECT k FROM w) THEN 'public_ends' END AS rule FROM c),
n AS (SELECT name, CASE WHEN length(name) % 3 = 0 THEN CAST(length(name) AS VARCHAR) ELSE coalesce(CAST(e.id AS VARCHAR), 'new') END AS entity FROM names LEFT JOIN e ON e.k = lower(names.name))
SELECT node_id, subject, predicate, object, confidence, rule, CASE WHEN rule IS NULL THEN a.entity END AS subject_entity, CASE WHEN rule IS NULL THEN b.entity END AS object_entity
FROM x LEFT JOIN n a ON a.name = subject LEFT JOIN n b ON b.name = object"""


def _filled(t: Tables):
    n, k = t.nodes, F.col("node_id")
    claims = n.select(k.alias("claim_id"), F.when(k % 13 != 0, F.lit(1)).alias("silo_id"), F.when(k % 4 != 0, F.col("state")).alias("state"), "content", F.when(k % 3 == 0, "s").alias("subject"), F.when(k % 2 == 0, "p").alias("predicate"), F.lit("o").alias("object"))
    return K.spo_fill(claims, _read).select("claim_id", "subject", "predicate", "object", "filled")


def _vectors(t: Tables):
    v, marked = K.embed_pending(t.nodes.select("node_id", "content", F.when(F.col("node_id") % 4 != 0, F.col("node_id") % 4 == 1).alias("embedded")), K.word_encoder())
    values = v.select("node_id", F.posexplode("embedding").alias("place", "value")).where("value <> 0")
    return marked.where("embedded").select("node_id").join(values, "node_id", "left").select("node_id", "place", F.round(F.col("value").cast("double"), 5).alias("value"))


def _edges(t: Tables):
    k = F.col("l_orderkey")
    e = t.lineitem.groupBy(k.alias("finding"), F.col("l_partkey").alias("edge")).agg(F.min("l_suppkey").alias("src"), F.max("l_linenumber").alias("line"), F.min("l_returnflag").alias("edge_type"), F.max("l_discount").alias("confidence"))
    kinds = F.array(*map(F.lit, ("truck", "ship", "rail", "air freight", "zzqx")))
    e = e.withColumns({"dst_type": F.get(kinds, F.col("line") % 5), "dst": F.col("edge"), "silo_id": F.col("finding") % 2, "supporting": F.when(F.col("edge") % 3 == 0, F.array(F.col("finding"))), "src_type": F.when(F.col("src") % 4 != 0, "Person").otherwise("")})
    e = materialize(e, "proposed-edges")  # aggregated from line items once and not for each use
    seen = e.select("finding", F.explode(F.array("src", "dst", "finding")).alias("node_id")).where("node_id % 17 <> 0")
    nodes = t.orders.where("o_orderkey % 13 <> 0").select(F.col("o_orderkey").alias("node_id"), F.when(F.col("o_orderkey") % 11 == 0, 1).otherwise(0).alias("silo_id"))
    allowed = t.spark.createDataFrame([("Agent", "A", "*"), ("*", "N", "Artifact"), ("Agent", "R", "Location")], "src_class string, edge_type string, dst_class string")
    vocabulary = t.spark.createDataFrame([("person", "Agent", 0), ("truck", "Artifact", 1), ("ship", "Artifact", 2), ("rail", "Location", 3), ("air", "Location", 4)], "word string, type_class string, place int")
    return e, seen, nodes, allowed, vocabulary


def _faults(t: Tables):
    e, seen, nodes, allowed, vocabulary = _edges(t)
    return K.validate_edges(e, seen, nodes, allowed, vocabulary, 0.03).select("finding", "edge", F.col("dst_type").alias("kind"), "fault", joined("offenders"))


def _written(t: Tables):
    e, seen, nodes, allowed, vocabulary = _edges(t)
    faults = K.validate_edges(e, seen, nodes, allowed, vocabulary, 0.03)
    k = F.col("o_orderkey")
    new = t.orders.select(k.alias("group"), k.alias("finding"), (k % 2).alias("silo_id"), F.when(k % 7 == 0, "silo").otherwise("cluster").alias("scope"), F.col("o_orderpriority").alias("body"), (k % 4).alias("n_sentences"), (k % 6).alias("size"))
    current = t.orders.where("o_orderkey % 3 <> 0").select(k.alias("group"), F.col("o_orderstatus").alias("body"), F.col("o_custkey").cast("string").alias("claims"), (k % 5 + 1).alias("version"))
    cites = t.lineitem.select(F.col("l_orderkey").alias("finding"), F.col("l_linenumber").alias("claim"), F.col("l_suppkey").alias("node_id"), F.when(F.col("l_linenumber") % 2 == 0, "primary").otherwise("supporting").alias("kind"))
    now, past = K.write_findings(current, new, ["group"], cites, faults, seen.union(cites.select("finding", "node_id")), nodes)
    none = F.lit(None)
    return now.select(F.lit("now").alias("part"), "group", "version", "body", "claims", F.round("quality", 6).alias("quality"), "n_edges").union(
        past.select(F.lit("was"), "group", "version", "body", "claims_hash", none.cast("double"), none.cast("long"))
    )


_EDGES_SQL = """e AS (SELECT l_orderkey AS finding, l_partkey AS edge, min(l_suppkey) AS src, max(l_linenumber) % 5 AS kind, min(l_returnflag) AS et, max(l_discount) AS conf FROM lineitem GROUP BY 1, 2),
i AS (SELECT DISTINCT finding, edge, unnest(CASE WHEN edge % 3 = 0 THEN [src, edge, finding] ELSE [src, edge] END) AS id FROM e),
o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS silo FROM orders WHERE o_orderkey % 13 <> 0),
k AS (SELECT finding, edge, i.id, CASE WHEN i.id % 17 = 0 THEN 1 WHEN o.id IS NULL THEN 2 WHEN o.silo <> finding % 2 THEN 3 END AS rank FROM i LEFT JOIN o ON o.id = i.id),
b AS (SELECT finding, edge, min(rank) AS rank, array_to_string(list_sort(list(DISTINCT id)), ',') AS offenders FROM k WHERE rank IS NOT NULL GROUP BY 1, 2),
f AS (SELECT e.*, CASE WHEN conf < 0.03 THEN 'low_confidence' WHEN src % 4 = 0 OR NOT (et = 'A' OR et = 'N' AND kind < 2 OR et = 'R' AND kind IN (2, 3)) THEN 'schema_violation' END AS early, rank, offenders FROM e LEFT JOIN b ON b.finding = e.finding AND b.edge = e.edge),
faults AS MATERIALIZED (SELECT finding, edge, ['truck', 'ship', 'rail', 'air freight', 'zzqx'][kind + 1] AS kind, coalesce(early, CASE rank WHEN 1 THEN 'hallucinated' WHEN 2 THEN 'invalid' WHEN 3 THEN 'cross_silo' END) AS fault, CASE WHEN early IS NULL THEN coalesce(offenders, '') ELSE '' END AS offenders FROM f)"""

CASES = {
    "l17_embed_pending": (
        _vectors,
        r""", w AS (SELECT node_id, unnest(list_filter(regexp_split_to_array(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D ]+'), lambda w: w <> '')) AS w FROM nodes WHERE node_id % 4 <> 1),
        c AS (SELECT node_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS place, count(*) AS c FROM w GROUP BY 1, 2),
        v AS (SELECT node_id, CAST(place AS INT) AS place, CAST(c / sqrt(sum(c * c) OVER (PARTITION BY node_id)) AS FLOAT) AS value FROM c)
        SELECT n.node_id, place, round(CAST(value AS DOUBLE), 5) AS value FROM nodes n LEFT JOIN v ON v.node_id = n.node_id WHERE n.content IS NOT NULL OR n.node_id % 4 = 1""",
    ),
    "l18_extract_claims": (_claims, _CLAIMS_SQL),
    "l19_spo_fill": (
        _filled,
        f""", texts AS (SELECT node_id, content FROM nodes WHERE node_id % 6 <> 0 AND node_id % 13 <> 0 AND content <> '' AND (node_id % 4 = 0 OR state = 'ACTIVE')), {_RELATIONS},
        f AS (SELECT node_id, arg_min(subject, place) AS s, arg_min(predicate, place) AS p, arg_min(object, place) AS o FROM r GROUP BY 1)
        SELECT n.node_id AS claim_id, CASE WHEN f.s IS NOT NULL THEN f.s WHEN n.node_id % 3 = 0 THEN 's' END AS subject, CASE WHEN f.s IS NOT NULL THEN f.p WHEN n.node_id % 2 = 0 THEN 'p' END AS predicate, coalesce(f.o, 'o') AS object, f.s IS NOT NULL AS filled
        FROM nodes n LEFT JOIN f ON f.node_id = n.node_id""",
    ),
    "l22_write_findings": (
        _written,
        f"""WITH {_EDGES_SQL}, x AS (SELECT DISTINCT l_orderkey AS finding, l_linenumber AS claim, l_suppkey AS id FROM lineitem),
        y AS (SELECT DISTINCT finding, claim FROM x LEFT JOIN o ON o.id = x.id WHERE o.id IS NULL OR o.silo <> finding % 2), h AS (SELECT x.* FROM x ANTI JOIN y ON y.finding = x.finding AND y.claim = x.claim),
        t AS (SELECT finding, count(DISTINCT claim) AS n, count(DISTINCT claim) FILTER (claim % 2 = 0) AS prim, count(DISTINCT id) AS cited, array_to_string(list_sort(list(DISTINCT claim)), ',') AS claims FROM h GROUP BY 1),
        g AS (SELECT finding, count(*) AS n_edges FROM faults WHERE fault IS NULL GROUP BY 1),
        s AS (SELECT o_orderkey AS k, o_orderpriority AS body, coalesce(n, 0) AS n, coalesce(prim, 0) AS prim, coalesce(cited, 0) AS cited, coalesce(claims, '') AS claims, coalesce(n_edges, 0) AS n_edges FROM orders LEFT JOIN t ON t.finding = o_orderkey LEFT JOIN g ON g.finding = o_orderkey WHERE n > 0 OR o_orderkey % 7 = 0)
        SELECT 'now' AS part, k AS "group", CASE WHEN k % 3 <> 0 THEN k % 5 + 2 ELSE 1 END AS version, body, claims,
          round(CASE WHEN n > 0 THEN 0.25 * least(n / 5, 1) + 0.30 * least(cited / greatest(k % 6, 1), 1) + 0.15 * least(n_edges / 2, 1) + 0.20 * prim / n + 0.10 * least(n / greatest(k % 4, 1) / 2, 1) ELSE 0 END, 6) AS quality, n_edges FROM s
        UNION ALL SELECT 'now', o_orderkey, o_orderkey % 5 + 1, o_orderstatus, CAST(o_custkey AS VARCHAR), NULL, NULL FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey NOT IN (SELECT k FROM s)
        UNION ALL SELECT 'was', o_orderkey, o_orderkey % 5 + 1, o_orderstatus, sha256(CAST(o_custkey AS VARCHAR)), NULL, NULL FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey IN (SELECT k FROM s)""",
    ),
    "j39_validate_edges": (_faults, f"WITH {_EDGES_SQL} SELECT * FROM faults"),
}
