"""Lifecycle transforms: tables in, tables or change logs out, always as of a given moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import exprs
from tessera.operators.aggregates import noisy_or
from tessera.operators.graph import cascade_staleness, would_cycle
from tessera.operators.joins import corroborate_exact, session_pairs
from tessera.operators.windows import keep_newest
from tessera.schema import TIER_WEIGHT
from tessera.scratch import materialize


def promote_claims(claims: DataFrame, least: int = 3) -> DataFrame:
    """Claims with enough distinct evidence become facts: confidence min(1, c + .1 (n - 2)).

    The evidence is counted once a (subject, predicate, object) and joined back.
    """
    n = corroborate_exact(claims, least).where("promote")
    return n.select("claim_id", "silo_id", "n_evidence", F.least(F.lit(1.0), F.col("confidence") + 0.1 * (F.col("n_evidence") - 2)).alias("confidence"))


def promote_rules(claims: DataFrame) -> DataFrame:
    """Per claim which rule promotes it: R1 an authoritative source and confidence .7, R2 joint confidence .8 with one, else none.

    Joint confidence is the noisy-or over the claim's evidence group of confidence x tier weight.
    """
    weighed = claims.withColumn("w", exprs.clamp("confidence") * exprs.lookup(TIER_WEIGHT, "source_tier", 0.4))
    g = weighed.groupBy("silo_id", "evidence").agg(noisy_or("w").alias("joint"), F.max((F.col("source_tier") == "authoritative").cast("int")).alias("any_authority"), F.count("*").alias("n"))
    j = claims.join(g, ["silo_id", "evidence"])
    rule = (
        F.when((F.col("source_tier") == "authoritative") & (F.round("confidence", 9) >= 0.7), "R1")
        .when((F.col("n") > 1) & (F.col("any_authority") == 1) & (F.round("joint", 9) >= 0.8), "R2").otherwise("none")
    )
    return j.select("claim_id", rule.alias("rule"))


def demote_facts(facts: DataFrame, edges: DataFrame, supports: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """Facts whose evidence has fallen below the bar (confidence max(.1, c - .1)), and (G17) what becomes of all that stands on them.

    ``edges``: ``src`` stands on ``dst``, a claim; ``supports``: ``id, n_supports``.
    """
    low = corroborate_exact(facts, least).where("not promote")
    low = low.select("claim_id", "n_evidence", F.greatest(F.lit(0.1), F.col("confidence") - 0.1).alias("confidence"))
    return low, cascade_staleness(edges, low.select(F.col("claim_id").alias("id")), supports, least=least)


def apply_supersession(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes with the losers of ``winner, loser`` superseded, ended and pointing at their winner, and the new edges.

    A pair applies where both are ACTIVE, differ and the winner isn't already behind the loser (a cycle); of several winners the
    smallest is taken. ``nodes``: ``node_id, state, valid_to``; ``edges``: SUPERSEDES edges so far.
    """
    live = nodes.where("state = 'ACTIVE'").select("node_id")
    end = lambda c: live.select(F.col("node_id").alias(c))
    p = pairs.where("winner <> loser").join(end("winner"), "winner", "left_semi").join(end("loser"), "loser", "left_semi")
    p = p.groupBy("loser").agg(F.min("winner").alias("winner"))
    walked = would_cycle(edges.where("edge_type = 'SUPERSEDES'"), p.select(F.col("winner").alias("src"), F.col("loser").alias("dst")))
    p = p.join(walked.where("not cycle").select(F.col("src").alias("winner"), F.col("dst").alias("loser")), ["winner", "loser"], "left_semi")
    # two that would supersede each other at once: the smaller stays
    both = p.select(F.col("winner").alias("loser"), F.col("loser").alias("winner"))
    p = p.join(both, ["winner", "loser"], "left_anti").unionByName(p.join(both, ["winner", "loser"], "left_semi").where("winner < loser"))
    j = nodes.join(p.select(F.col("loser").alias("node_id"), F.col("winner").alias("superseded_by")), "node_id", "left")
    hit = F.col("superseded_by").isNotNull()
    done = j.withColumns({"state": F.when(hit, "SUPERSEDED").otherwise(F.col("state")), "valid_to": F.when(hit, now).otherwise(F.col("valid_to"))})
    return done, p.select(F.col("winner").alias("src"), F.col("loser").alias("dst"), F.lit("SUPERSEDES").alias("edge_type"))


def decay_memory(nodes: DataFrame) -> DataFrame:
    idle = nodes.where("layer = 'memory' and age_hours > 1")
    return idle.select("node_id", exprs.memory_decay("confidence", "age_hours").alias("confidence"))


def expired_memory(nodes: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Nodes older than their class's hard limit in hours; classes without one never expire."""
    return nodes.where(F.col("age_hours") > exprs.lookup(limits, "decay_class")).select("node_id", "decay_class", "age_hours")


def retention_sweep(nodes: DataFrame, summaries: DataFrame, chains: DataFrame, keep: int = 100, grace_hours: int = 7 * 24) -> DataFrame:
    """``id, action``: tombstone what its class's rule says, what lies beyond each silo's newest ``keep`` (W5), and summaries without a chain; delete what has been a tombstone past the grace."""
    live = nodes.where("state <> 'TOMBSTONED'")
    rule = live.where(exprs.tombstone_eligible("decay_class", "age_hours", "heat_score")).select(F.col("node_id").alias("id"))
    beyond = keep_newest(live, "silo_id", [F.col("age_hours"), F.col("node_id")], keep).select(F.col("node_id").alias("id"))
    orphan = summaries.join(chains.select("chain_id").distinct(), "chain_id", "left_anti").select("id")
    tomb = rule.union(beyond).distinct().withColumn("action", F.lit("tombstone"))
    gone = nodes.where((F.col("state") == "TOMBSTONED") & (F.col("age_hours") > grace_hours)).select(F.col("node_id").alias("id"), F.lit("delete").alias("action"))
    return tomb.unionByName(gone).unionByName(orphan.withColumn("action", F.lit("tombstone_summary")))


def forget(nodes: DataFrame, ids: DataFrame, now: Column, window_minutes: int = 60) -> DataFrame:
    """The nodes with those asked for as tombstones that can be taken back until ``restorable_until``."""
    asked = ids.select("node_id").distinct().withColumn("asked", F.lit(True))
    hit = F.coalesce(F.col("asked"), F.lit(False)) & (F.col("state") != "TOMBSTONED")
    j = nodes.join(asked, "node_id", "left").withColumn("restorable_until", F.when(hit, now + F.make_dt_interval(mins=F.lit(window_minutes))))
    return j.withColumns({"state_before": F.when(hit, F.col("state")), "state": F.when(hit, "TOMBSTONED").otherwise(F.col("state"))}).drop("asked")


def erase(nodes: DataFrame, edges: DataFrame, ids: DataFrame, cascade: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is left of nodes and edges without the ids (``cascade``: and without the nodes that point at them), and one audit row."""
    asked = ids.select("id").distinct()
    gone = asked
    if cascade:
        gone = asked.union(edges.join(asked.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))).distinct()
    kept_nodes = nodes.join(gone, nodes.node_id == gone.id, "left_anti")
    kept_edges = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    there = nodes.select(F.col("node_id").alias("id")).distinct()
    n = lambda df, as_: df.agg(F.count("*").alias(as_))
    status = F.when(F.col("n_found") == F.col("n_asked"), "completed").when(F.col("n_found") > 0, "partial").otherwise("failed")
    audit = n(asked, "n_asked").crossJoin(n(asked.join(there, "id", "left_semi"), "n_found")).crossJoin(n(gone.join(there, "id", "left_semi"), "n_erased"))
    return kept_nodes, kept_edges.select(*edges.columns), audit.withColumn("status", status)


def review_weak_links(links: DataFrame, nodes: DataFrame, promote_weight: float = 0.6, promote_heat: float = 0.3, prune_hours: int = 30 * 24) -> DataFrame:
    """Each link's action: drop if both ends are dead, demote if one is superseded, promote, prune, keep."""
    end = lambda c: nodes.select(F.col("node_id").alias(c), F.col("state").alias(f"{c}_state"))
    j = links.join(end("a"), "a", "left").join(end("b"), "b", "left")
    dead = lambda c: F.coalesce(F.col(f"{c}_state") == "TOMBSTONED", F.lit(True))
    action = (
        F.when(dead("a") & dead("b"), "drop").when((F.col("a_state") == "SUPERSEDED") | (F.col("b_state") == "SUPERSEDED"), "demote")
        .when((F.col("weight") >= promote_weight) & (F.col("heat") >= promote_heat), "promote").when(F.col("age_hours") > prune_hours, "prune").otherwise("keep")
    )
    return j.select("a", "b", action.alias("action"))


def expire(df: DataFrame, column: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """What has expired and what hasn't (no time: never)."""
    gone = F.coalesce(F.col(column) < now, F.lit(False))
    return df.where(gone), df.where(~gone)


def decay_patterns(patterns: DataFrame, idle_hours: int = 7 * 24) -> DataFrame:
    """Patterns unseen for long lose a tenth, and die below .1."""
    c = F.when(F.col("age_hours") > idle_hours, F.col("confidence") * 0.9).otherwise(F.col("confidence"))
    return patterns.select("node_id", c.alias("confidence"), F.when(F.round(c, 9) < 0.1, "TOMBSTONED").otherwise("ACTIVE").alias("state"))


def backfill_state(nodes: DataFrame, superseded: DataFrame) -> DataFrame:
    s = superseded.select("node_id").distinct().withColumn("old", F.lit(True))
    return nodes.join(s, "node_id", "left").select("node_id", F.when(F.col("old"), "SUPERSEDED").otherwise("ACTIVE").alias("state"))


def confirm_markers(candidates: DataFrame, verdicts: DataFrame, least: float = 0.7) -> DataFrame:
    """Candidates that a verdict table confirms surely enough; each is counted once."""
    j = candidates.join(verdicts, ["a", "b"], "left")
    ok = F.coalesce(F.col("verdict") & (F.col("certainty") >= least), F.lit(False))
    return j.select("a", "b", F.when(ok, "marker").when(F.col("verdict").isNull(), "pending").otherwise("cleared").alias("outcome"))


def retain(df: DataFrame, column: str, now: Column, days: int) -> DataFrame:
    return df.where(F.col(column) >= now - F.make_dt_interval(days=F.lit(days)))


def compact_chains(steps: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """Chains of enough steps as one summary row (a stable id, the steps' number and their texts in order), and the chains that become tombstones for it."""
    g = steps.groupBy("chain_id").agg(F.count("*").alias("n_steps"), F.sort_array(F.collect_list(F.struct("place", "text"))).alias("steps"))
    s = g.where(F.col("n_steps") >= least).select("chain_id", "n_steps", exprs.content_id("chain_id", exprs.inline_summary("steps")).alias("summary_id"), exprs.inline_summary("steps").alias("summary"))
    return s, s.select("chain_id", F.lit("TOMBSTONED").alias("state"), F.col("summary_id").alias("replaced_by"))


def close_sessions(sessions: DataFrame, chains: DataFrame, now: Column, idle_minutes: int = 30) -> tuple[DataFrame, DataFrame]:
    """Open sessions idle for longer than the bound, and (J26) the earlier to later pairs of their chains.

    ``sessions``: ``session, last_seen, open``; ``chains``: ``session, chain, created``.
    """
    closed = sessions.where(F.col("open") & (F.col("last_seen") < now - F.make_dt_interval(mins=F.lit(idle_minutes))))
    return closed, session_pairs(chains.join(closed.select("session"), "session", "left_semi"))


def engagement(markers: DataFrame, touches: DataFrame, hard_at: int) -> DataFrame:
    """Per set of markers how many are pending and the mode: hard where one was touched often enough."""
    j = markers.join(touches, "marker_id", "left")
    g = j.groupBy("about").agg(F.count("*").alias("n_pending"), F.max(F.coalesce("n_touches", F.lit(0))).alias("most"))
    return g.select("about", "n_pending", F.when(F.col("most") >= hard_at, "hard").otherwise("soft").alias("mode"))


def upsert_findings(current: DataFrame, new: DataFrame, keys: list[str], citations: DataFrame, seen: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The findings after new ones came in, versions raised, and the history rows of those replaced, with a hash of their body.

    Of a new finding only claims whose citations hold (J39: seen, existing) survive; without any it is rejected and the current one stays.
    ``citations``: ``finding, node_id, silo_id, confidence`` by the new rows' ``finding``.
    What new and current findings come to is written once, and the results are read from there.
    """
    held = citations.join(seen, ["finding", "node_id"], "left_semi").join(nodes.select("node_id").distinct(), "node_id", "left_semi").groupBy("finding").agg(F.count("*").alias("n_claims"))
    good = materialize(new.join(held, "finding").select(*keys, "body", "n_claims", F.lit(True).alias("fresh")), "findings-held")
    j = materialize(good.join(current.select(*keys, F.col("version").alias("old_version"), F.col("body").alias("old_body")), keys, "full"), "findings")
    raised = j.where("fresh").select(*keys, "body", "n_claims", (F.coalesce("old_version", F.lit(0)) + 1).alias("version"))
    kept = j.where("fresh is null").select(*keys, F.col("old_body").alias("body"), F.lit(None).cast("long").alias("n_claims"), F.col("old_version").alias("version"))
    history = j.where("fresh and old_version is not null").select(*keys, F.col("old_version").alias("version"), exprs.content_id("old_body").alias("body_hash"))
    return raised.unionByName(kept), history


def dominated(pairs: DataFrame, rank: DataFrame) -> DataFrame:
    """Of contradicting hits those that a survivor of higher rank drops, to a fixed point.

    ``pairs``: ``a, b``; ``rank``: ``node_id, place`` (smaller is better, no ties). Each round what
    nothing better contradicts survives, and what it contradicts goes.
    """
    r = rank.select("node_id", "place")
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    e = both.join(r.select(F.col("node_id").alias("a"), F.col("place").alias("pa")), "a").join(r.select(F.col("node_id").alias("b"), F.col("place").alias("pb")), "b")
    e = materialize(e.where("pa < pb").select("a", "b"), "dominance")  # a beats b
    dropped = None
    while not e.isEmpty():
        safe = e.select("a").distinct().join(e.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        out = materialize(e.join(safe, "a", "left_semi").select(F.col("b").alias("node_id")).distinct(), "dropped")
        dropped = out if dropped is None else dropped.union(out)
        gone = out.withColumnRenamed("node_id", "a")
        e = materialize(e.join(safe, "a", "left_anti").join(gone, "a", "left_anti").join(out.withColumnRenamed("node_id", "b"), "b", "left_anti"), "dominance")
    return dropped if dropped is not None else r.select("node_id").limit(0)


def newest(df: DataFrame, key: str, order: list) -> DataFrame:
    return df.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("n = 1").drop("n")


def cancel_forget(nodes: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Forgotten nodes asked for get their state back while the window is open; after it nothing changes."""
    asked = ids.select("node_id").distinct().withColumn("asked", F.lit(True))
    back = F.coalesce(F.col("asked"), F.lit(False)) & F.coalesce(F.col("restorable_until") > now, F.lit(False))
    j = nodes.join(asked, "node_id", "left").withColumn("back", back)
    return j.withColumns({"state": F.when(F.col("back"), F.col("state_before")).otherwise(F.col("state")), "restorable_until": F.when(F.col("back"), None).otherwise(F.col("restorable_until"))}).drop("asked", "back")


def hard_delete(nodes: DataFrame, edges: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without what was forgotten and whose window has closed."""
    gone = nodes.where(F.col("restorable_until") <= now).select(F.col("node_id").alias("id"))
    kept = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(gone, nodes.node_id == gone.id, "left_anti"), kept.select(*edges.columns)
