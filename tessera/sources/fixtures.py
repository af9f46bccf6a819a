"""The model's tables, derived from star-schema, text and event tables.

Each derivation is one SQL text that Spark and DuckDB both read; integer arithmetic only, no clock.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

DERIVED = {
    "claims": """
  SELECT l_orderkey * 1000 + ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,
           l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax) AS claim_id,
         CAST(l_suppkey % 4 AS INT) AS silo_id, l_partkey AS subject, l_linestatus AS predicate, l_returnflag AS object,
         l_orderkey AS evidence, l_suppkey AS agent_id, l_shipdate AS created_at,
         CASE l_linenumber % 4 WHEN 0 THEN 'authoritative' WHEN 1 THEN 'validated' WHEN 2 THEN 'community' ELSE 'unknown' END AS source_tier,
         l_discount * 10 AS confidence
  FROM lineitem""",
    "versions": """
  SELECT o_orderkey AS node_id, o_custkey AS chain_id, o_orderdate AS valid_from,
         LEAD(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to,
         LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS supersedes_id,
         o_totalprice / 1000000.0 AS confidence
  FROM orders""",
    "edges": """
  SELECT l_suppkey AS src, -l_partkey AS dst,
         CASE l_returnflag WHEN 'A' THEN 'SUPPORTS' WHEN 'R' THEN 'CONTRADICTS' ELSE 'CAUSES' END AS edge_type,
         AVG(1.0 - l_discount) AS weight
  FROM lineitem GROUP BY 1, 2, 3""",
    "access_events": """
  SELECT event_id AS entry_id, user_id AS node_id,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'write' ELSE 'read' END AS access_type, ts
  FROM events""",
    "nodes": """
  SELECT d.doc_id AS node_id, d.text AS content, d.lang AS lang, d.source AS silo_id,
         CASE d.doc_id % 4 WHEN 0 THEN 'memory' WHEN 1 THEN 'knowledge' WHEN 2 THEN 'wisdom' ELSE 'intelligence' END AS layer,
         CASE d.doc_id % 3 WHEN 0 THEN 'ephemeral' WHEN 1 THEN 'standard' ELSE 'durable' END AS decay_class,
         CASE WHEN d.doc_id % 11 = 0 THEN 'TOMBSTONED' WHEN d.doc_id % 7 = 0 THEN 'SUPERSEDED' ELSE 'ACTIVE' END AS state,
         CAST(d.doc_id % 100 AS DOUBLE) / 100 AS heat_score, CAST(d.doc_id % 7 AS DOUBLE) / 7 AS confidence,
         CAST(d.doc_id % 720 AS INT) AS age_hours, d.doc_id % 13 AS agent_id, l.quality AS quality, l.toxic AS toxic
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "vectors": """
  SELECT vec_id AS node_id, embedding, label, CAST(vec_id % 13 AS INT) AS agent_id FROM embeddings""",
}


def needed(sql: str) -> list[str]:
    return [name for name in DERIVED if re.search(rf"\b{name}\b", sql)]


def with_derived(sql: str) -> str:
    """``sql`` with the derived tables that it names put before it; one that starts with a comma goes on with tables of its own."""
    names = needed(sql)
    ctes = ",\n".join(f"{n} AS ({DERIVED[n]})" for n in names)
    body = sql.strip()
    if body.startswith(","):
        return f"WITH {ctes}{body}" if names else f"WITH {body[1:]}"
    if not names:
        return sql
    recursive = re.match(r"(?i)WITH\s+RECURSIVE\s+", body)
    plain = re.match(r"(?i)WITH\s+", body)
    if recursive:
        return f"WITH RECURSIVE {ctes},\n{body[recursive.end():]}"
    return f"WITH {ctes},\n{body[plain.end():]}" if plain else f"WITH {ctes}\n{body}"


class Tables:
    """The given tables and the derived ones, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in DERIVED:
            return self.sql(DERIVED[name])
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        """A query over given tables, which are passed as frames: no view is left in the session."""
        names = [n for n in TABLES if re.search(rf"\bFROM {n}\b|\bJOIN {n}\b", text)]
        for n in names:
            text = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", text)
        return self.spark.sql(text, **{n: getattr(self, n) for n in names})
