"""Rank fusion, supersession within a batch, timelines, conflict resolution and ordered selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import exprs
from tessera.operators.similarity import ratio_of


def rrf_fuse(ranked: DataFrame, k: int = 60, top: int = 20) -> DataFrame:
    """Reciprocal rank fusion of ``query_id, channel, node_id, rank``: the sum of 1 / (k + rank) over what the query's channels could give at most.

    ``contributions`` maps each channel that found the node to its part of the sum.
    """
    channels = ranked.groupBy("query_id").agg(F.count_distinct("channel").alias("n_channels"))
    part = F.struct("channel", (1 / (F.lit(k) + F.col("rank"))).alias("part"))
    score = ranked.groupBy("query_id", "node_id").agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("sum"), F.count("*").alias("n_hits"), F.map_from_entries(F.array_sort(F.collect_list(part))).alias("contributions"))
    fused = score.join(channels, "query_id").withColumn("score", F.round(F.col("sum") / (F.col("n_channels") / (k + 1)), 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("query_id", "node_id", "score", "n_hits", "rank", "contributions")


def batch_supersession(batch: DataFrame, existing: DataFrame | None = None, mode: str = "supersede") -> DataFrame:
    """New rows whose object differs from the one before in their (silo, subject, predicate), and what becomes of them.

    Order: time (nulls last), document, position; existing rows come before. ``mode``: ``supersede`` names what is
    replaced, by node where it exists already (``node:id``), else by its document, else by its position in the batch;
    ``skip`` and ``error`` leave that open.
    """
    new = batch.withColumn("is_new", F.lit(True))
    both = new if existing is None else new.unionByName(existing.withColumn("is_new", F.lit(False)))
    at = F.coalesce("created_at", F.lit("9999-12-31").cast("timestamp_ntz"))
    w = Window.partitionBy("silo_id", "subject", "predicate").orderBy("is_new", at, F.col("document_id").asc_nulls_last(), "position", "claim_id")
    seen = F.struct("object", "is_new", "document_id", "position", "claim_id")
    prev = both.withColumn("prev", F.lag(seen).over(w)).where("is_new and prev.object <> object")
    text = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    target = F.when(~F.col("prev.is_new"), text("node", "prev.claim_id")).otherwise(F.coalesce(text("document", "prev.document_id"), text("position", "prev.position")))
    status = {"supersede": "superseding", "skip": "skipped", "error": "error"}[mode]
    return prev.select("claim_id", F.lit(status).alias("status"), (target if mode == "supersede" else F.lit(None).cast("string")).alias("supersedes"))


def belief_timeline(versions: DataFrame) -> DataFrame:
    """Per version of a chain (repeated ids once), in the order in which they began, its place, status and the trend of the chain's confidence."""
    one = versions.groupBy("chain_id", "node_id").agg(F.min("valid_from").alias("valid_from"), F.max("confidence").alias("confidence"))
    order = [F.col("valid_from").asc_nulls_last(), F.col("node_id")]
    w, chain = Window.partitionBy("chain_id").orderBy(*order), Window.partitionBy("chain_id")
    d = one.withColumns({"place": F.row_number().over(w), "n_versions": F.count("*").over(chain), "step": F.col("confidence") - F.lag("confidence").over(w)})
    d = d.withColumns({"up": F.coalesce(F.bool_and(F.col("step") > 0).over(chain), F.lit(False)), "down": F.coalesce(F.bool_and(F.col("step") < 0).over(chain), F.lit(False)), "largest": F.max(F.abs("step")).over(chain)})
    trend = F.when(F.col("up"), "increasing").when(F.col("down"), "decreasing").when(F.round("largest", 9) > 0.2, "volatile").otherwise("stable")
    return d.select("chain_id", "node_id", "place", F.when(F.col("place") == F.col("n_versions"), "current").otherwise("superseded").alias("status"), trend.alias("trend"))


def keep_newest(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """What lies beyond the newest n of each key: to be tombstoned."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") > n)


def resolve_conflicts(pairs: DataFrame) -> DataFrame:
    """The winner of each pair by tier weight x ln(1 + max(1, corroboration)) / (1 + days).

    On a tie the newer claim of one agent wins, the older of two, then the smaller id.
    """
    score = lambda s: exprs.lookup({"authoritative": 1.0, "validated": 0.85, "community": 0.6, "unknown": 0.4}, f"tier_{s}", 0.4) * F.log(
        1 + F.greatest(F.lit(1), F.col(f"n_{s}"))
    ) / (1 + F.col(f"days_{s}"))
    a, b = F.round(score("a"), 9), F.round(score("b"), 9)
    same = F.col("agent_a") == F.col("agent_b")
    newer_a = F.when(F.col("days_a") == F.col("days_b"), F.col("a") < F.col("b")).when(same, F.col("days_a") < F.col("days_b")).otherwise(F.col("days_a") > F.col("days_b"))
    wins = F.when(a == b, newer_a).otherwise(a > b)
    return pairs.select(
        F.when(wins, F.col("a")).otherwise(F.col("b")).alias("winner"), F.when(wins, F.col("b")).otherwise(F.col("a")).alias("loser"),
        F.when(a == b, "tie").otherwise("score").alias("rationale"),
    )


def key_sentences(nodes: DataFrame, budget: int = 512) -> DataFrame:
    """The best sentences of each text that fit a budget, in their order.

    Sentences are scored by place, cue words, specifics, capitalised words and length; a greedy
    fill over them, best first, is an ordered fold inside the row. A text is cut once: what a lambda names from outside is computed anew for each sentence.
    """
    text = F.col("content")
    once = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))
    score = lambda s, at: (
        0.3 * (1 - F.abs(at - 0.5) * 2) + F.when(s.rlike(r"(?i)\b(found|discovered|key|important|actually|because)\b"), 0.25).otherwise(0)
        + F.when(s.rlike(r"`[^`]+`|/[\w/]+\.\w+|\d+"), 0.2).otherwise(0) + F.least(F.lit(0.15), F.regexp_count(s, F.lit(r"\b[A-Z][a-z]+\b")) * 0.05)
        + F.when(F.length(s).between(20, 150), 0.1).otherwise(0)
    )
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<i:int,s:string>>").alias("picked"))
    step = lambda acc, x: F.when(
        acc["used"] + F.when(F.size(acc["picked"]) > 0, 1).otherwise(0) + F.length(x["s"]) <= budget,
        F.struct((acc["used"] + F.when(F.size(acc["picked"]) > 0, 1).otherwise(0) + F.length(x["s"])).alias("used"), F.concat(acc["picked"], F.array(F.struct(x["i"].alias("i"), x["s"].alias("s")))).alias("picked")),
    ).otherwise(acc)

    def best(parts: Column) -> Column:
        scored = F.array_sort(F.transform(parts, lambda s, i: F.struct((-F.round(score(s, i / F.size(parts)), 9)).alias("rank"), i.alias("i"), s.alias("s"))))
        picked = F.aggregate(scored, start, step, lambda acc: F.array_join(F.transform(F.array_sort(acc["picked"]), lambda x: x["s"]), " "))
        return once(picked, lambda p: F.when(p == "", F.substring(F.get(parts, 0), 1, budget)).otherwise(p))

    full = F.when(F.length(text) <= budget, text).otherwise(once(F.split(text, r"(?<=[.!?])\s+"), best))
    return nodes.select("node_id", full.alias("summary"))


def oldest_first(df: DataFrame, where: Column, order: list, k: int) -> DataFrame:
    return df.where(where).orderBy(*order).limit(k)


def stuck_sessions(turns: DataFrame, minutes: int = 5, alike: float = 0.7) -> DataFrame:
    """Turns (``user_id, event_id, ts, text, is_write``) of users whose last three came within minutes, with no write, all of them like the last by text ratio."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    d = turns.withColumns({"t2": F.lag("ts", 2).over(w), "a": F.lag("text", 1).over(w), "b": F.lag("text", 2).over(w), "wrote": F.max(F.col("is_write").cast("int")).over(w.rowsBetween(-2, 0))})
    near = d.where((F.col("ts") <= F.col("t2") + F.make_dt_interval(mins=F.lit(minutes))) & (F.col("wrote") == 0))
    return near.where((ratio_of("text", "a") >= alike) & (ratio_of("text", "b") >= alike)).select("user_id", "event_id")


def prewarm_queue(nodes: DataFrame, propagated: DataFrame, warmed: DataFrame, k: int = 100, cutoff_hours: int = 24) -> DataFrame:
    """The k hottest live nodes that are FULL or WARM by effective heat (own plus propagated, at most 1) and weren't warmed since the cutoff."""
    heat = F.least(F.lit(1.0), F.col("heat_score") + F.coalesce("heat", F.lit(0.0)))
    j = nodes.where("state = 'ACTIVE'").join(propagated.select("node_id", "heat"), "node_id", "left").withColumn("effective", F.round(heat, 6))
    recent = warmed.where(F.col("warmed_hours") <= cutoff_hours).select("node_id").distinct()
    hot = j.where(exprs.level("effective").isin("FULL", "WARM")).join(recent, "node_id", "left_anti")
    return hot.orderBy(F.desc("effective"), "node_id").limit(k).select("node_id", "effective")
