"""Scans, point lookups, idempotent writes and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a broadcast table may have.
BROADCAST_ROWS = 20_000


def in_blocks(df: DataFrame, key: str, rows: int = BROADCAST_ROWS) -> list[DataFrame]:
    """A table of unknown size, for a join without an equality, as broadcasts of about ``rows`` rows each.

    The size is counted first; one block is the usual case. Each further block scans the other side once more.
    """
    n = max(1, -(-df.count() // rows))
    return [F.broadcast(df if n == 1 else df.where(F.pmod(F.xxhash64(key), F.lit(n)) == i)) for i in range(n)]


def spread(df: DataFrame) -> DataFrame:
    """A table on which each row is much work, over all cores even where it has few bytes."""
    cores = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def semi(df: DataFrame, ids: DataFrame, on: str | list[str], how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose key is in ``ids``; Spark broadcasts ``ids`` where its size allows."""
    keys = [on] if isinstance(on, str) else on
    return df.join(ids.select(*keys).distinct(), keys, how)


def list_active(nodes: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """ACTIVE nodes with content, newest first, one page; each row has the count of all."""
    live = nodes.where("state = 'ACTIVE' and length(trim(content)) > 0")
    total = live.agg(F.count("*").alias("total"))
    page = live.orderBy("age_hours", "node_id").offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(total)).select("node_id", "silo_id", "age_hours", "total")


def get_nodes(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    return semi(nodes, ids, "node_id")


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest version of each key; an update wins a tie with the base. Null keys are a key; a row's columns may have any name."""
    row = lambda df, new: df.select(F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("row"), F.lit(new).alias("new"))
    both = row(base, 0).union(row(updates, 1))
    best = both.groupBy(*[F.col(f"row.`{k}`").alias(f"key{i}") for i, k in enumerate(keys)]).agg(F.max_by("row", F.struct(F.col(f"row.`{version}`"), F.col("new"))).alias("row"))
    return best.select("row.*")


def ingest_observations(nodes: DataFrame, batch: DataFrame, conflict_mode: str = "skip") -> DataFrame:
    """The batch with a status: created, skipped or error where its ``document_id`` exists or repeats in the batch."""
    known = nodes.select(F.col("document_id").alias("known_id")).distinct()
    first = Window.partitionBy("document_id").orderBy("position")
    seen = batch.join(known, F.col("document_id") == F.col("known_id"), "left").withColumn("n", F.row_number().over(first))
    clash = F.col("document_id").isNotNull() & (F.col("known_id").isNotNull() | (F.col("n") > 1))
    return seen.withColumn("status", F.when(clash, "skipped" if conflict_mode == "skip" else "error").otherwise("created")).drop("known_id", "n")


def pending_embedding(nodes: DataFrame, embedded: DataFrame, least: int = 10, most: int = 8000) -> DataFrame:
    """Nodes without a vector and with enough text, cut to what the encoder reads."""
    todo = nodes.where(F.length("content") >= least).join(embedded.select("node_id").distinct(), "node_id", "left_anti")
    return todo.select("node_id", F.substring("content", 1, most).alias("content"))


def lookup_by_uri(pages: DataFrame, uris: DataFrame) -> DataFrame:
    return semi(pages.where("url is not null"), uris, "url")


def silo_export(tables: dict[str, DataFrame], path: str) -> None:
    """A folder a table, in it one a tenant, and how many rows each tenant has of each table."""
    counts = None
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy("silo_id").parquet(f"{path}/{name}")
        n = df.groupBy("silo_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "silo_id", "n")
        counts = n if counts is None else counts.unionByName(n)
    counts.write.mode("overwrite").parquet(f"{path}/row_counts")


def silo_import(spark, path: str, silo: str | None = None) -> dict[str, DataFrame]:
    """What was exported, or one tenant of it (only its folders are read); an error where rows are missing."""
    wanted = spark.read.parquet(f"{path}/row_counts")
    names = [r["name"] for r in wanted.select("name").distinct().collect()]
    out = {}
    for name in names:
        df = spark.read.parquet(f"{path}/{name}")
        want = wanted.where(F.col("name") == name)
        if silo is not None:
            df, want = df.where(F.col("silo_id") == silo), want.where(F.col("silo_id") == silo)
        n, m = df.count(), want.agg(F.sum("n")).first()[0] or 0
        if n != m:
            raise ValueError(f"{name}: {n} rows of {m} came back")
        out[name] = df
    return out


def graph_export(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row a source with its name and its participants in order of role, as ``member:role``, all of them."""
    member = F.struct(F.col("edge_type").alias("role"), F.col("dst").alias("member"))
    g = edges.groupBy("src").agg(F.array_sort(F.collect_set(member)).alias("m"))
    named = g.select("src", F.size("m").cast("long").alias("n"), F.transform("m", lambda x: F.concat_ws(":", x["member"].cast("string"), x["role"])).alias("members"))
    return named.join(nodes.select(F.col("id").alias("src"), "name"), "src")
