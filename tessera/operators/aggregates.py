"""Aggregations: consensus, synthesis groups, belief confidence and drift, gauges and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import exprs


def noisy_or(c: Column | str) -> Column:
    """1 - prod(1 - clamp(c)); nothing gives 0."""
    return F.coalesce(1 - F.product(1 - exprs.clamp(c)), F.lit(0.0))


def corroboration_weight(claims: DataFrame, keys: list[str]) -> DataFrame:
    """Each source weighs 1 + .5 (sqrt(n) - 1) for its n claims; the sum saturates as 1 - exp(-.5 x)."""
    per = claims.groupBy(*keys, "agent_id").agg(F.count("*").alias("n"))
    return per.groupBy(*keys).agg((1 - F.exp(-0.5 * F.sum(1 + 0.5 * (F.sqrt("n") - 1)))).alias("weight"))


def consensus_candidates(claims: DataFrame, heat: DataFrame, chains: int = 2, agents: int = 2) -> DataFrame:
    """Groups with enough chains and agents, their mean confidence (null counts .5) and priority: (1 - confidence) x the subject's heat x ln(min(agents, 5) + 1)."""
    g = claims.groupBy("silo_id", "subject", "predicate").agg(
        F.count_distinct("evidence").alias("n_chains"), F.count_distinct("agent_id").alias("n_agents"), F.avg(F.coalesce("confidence", F.lit(0.5))).alias("avg_confidence")
    )
    g = g.where((F.col("n_chains") >= chains) & (F.col("n_agents") >= agents)).join(heat.select("subject", "heat"), "subject", "left")
    return g.withColumn("priority", (1 - F.col("avg_confidence")) * F.coalesce("heat", F.lit(0.0)) * F.log(F.least(F.col("n_agents"), F.lit(5)) + 1)).drop("heat")


def consensus_promote(claims: DataFrame, agents: int = 2, least: float = 0.7) -> DataFrame:
    g = claims.groupBy("silo_id", "subject").agg(F.count_distinct("agent_id").alias("n_agents"), noisy_or("confidence").alias("joint"))
    reason = F.when(F.col("n_agents") < agents, "too_few_agents").when(F.round("joint", 9) < least, "low_confidence").otherwise("promote")
    return g.withColumn("outcome", reason)


def consensus_invalidate(facts: DataFrame, dead: DataFrame, least: int = 3) -> DataFrame:
    """What becomes of facts that lose chains: too few left are tombstoned, the rest stale."""
    hit = facts.join(dead.select("evidence").distinct().withColumn("gone", F.lit(1)), "evidence", "left")
    g = hit.groupBy("silo_id", "subject", "predicate", "object").agg(F.count_distinct(F.when(F.col("gone").isNull(), F.col("evidence"))).alias("n_left"), F.max("gone").alias("lost"))
    return g.where("lost = 1").select("silo_id", "subject", "predicate", "object", "n_left", F.when(F.col("n_left") < least, "tombstone").otherwise("stale").alias("action"))


def synthesis_groups(facts: DataFrame, synthesized: DataFrame, facts_least: int = 3, evidence_least: int = 3) -> DataFrame:
    """(subject, predicate) groups of facts not yet in a belief with enough facts and distinct evidence."""
    free = facts.join(synthesized.select("claim_id"), "claim_id", "left_anti")
    g = free.groupBy("silo_id", "subject", "predicate").agg(F.count("*").alias("n_facts"), F.count_distinct("evidence").alias("n_evidence"))
    return g.where((F.col("n_facts") >= facts_least) & (F.col("n_evidence") >= evidence_least))


def belief_confidence(facts: DataFrame, now: Column, gate: float = 0.6, days: int = 7) -> DataFrame:
    """Groups whose joint confidence passes the gate, as proposals with the time at which they expire."""
    g = facts.groupBy("silo_id", "subject", "predicate").agg(noisy_or("confidence").alias("confidence"))
    return g.where(F.round("confidence", 9) >= gate).withColumn("expires_at", now + F.make_dt_interval(days=F.lit(days)))


def centroid(vectors: DataFrame, key: str) -> DataFrame:
    """The element-wise mean of each group's vectors: one partial sum a group, position and task."""
    parts = vectors.select(key, F.posexplode("embedding").alias("i", "v"))
    mean = parts.groupBy(key, "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return mean.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("centroid"))


def belief_drift(stored: DataFrame, current: DataFrame, counts: DataFrame, key: str, most: float = 0.15, least: int = 3) -> DataFrame:
    """Cosine distance of stored and current centroids, and why a belief is or isn't revised."""
    a, b = stored.select(key, F.col("centroid").alias("stored")), current.select(key, F.col("centroid").alias("now"))
    j = a.join(b, key).join(counts, key).withColumn("distance", 1 - exprs.cosine("stored", "now"))
    reason = F.when(F.col("n") < least, "too_few_facts").when(F.round("distance", 9) > most, "drifted").otherwise("stable")
    return j.select(key, "distance", reason.alias("reason"))


def merge_beliefs_numeric(pairs: DataFrame) -> DataFrame:
    """Two beliefs as one: confidence weighted by facts, the union of facts, an id from the sorted sources, and the sources to mark stale."""
    n_a, n_b = F.size("facts_a"), F.size("facts_b")
    union = F.array_union("facts_a", "facts_b")
    return pairs.select(
        "a", "b", ((F.col("confidence_a") * n_a + F.col("confidence_b") * n_b) / (n_a + n_b)).alias("confidence"), F.size(union).cast("long").alias("n_facts"), exprs.pair_id("a", "b", "merge").alias("id"),
        F.sort_array(F.array("a", "b")).alias("stale"),
    )


def level_distribution(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(exprs.level("heat_score").alias("level")).agg(F.count("*").alias("n"))


def storage_gauges(nodes: DataFrame, edges: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """Per silo its nodes, by layer too, active ones and bytes of content; edges by their source's silo; vectors."""
    count = lambda c: F.count_if(c)
    layers = ("memory", "knowledge", "wisdom", "intelligence")
    g = nodes.groupBy("silo_id").agg(
        F.count("*").alias("n_nodes"), *[count(F.col("layer") == x).alias(f"n_{x}") for x in layers], count(F.col("state") == "ACTIVE").alias("n_active"),
        F.sum(F.octet_length("content")).cast("long").alias("content_bytes"),
    )
    of = nodes.select("silo_id", "node_id")
    for name, df, key in (("n_edges", edges, "src"), ("n_vectors", vectors, "node_id")):
        if df is not None:
            n = df.select(F.col(key).alias("node_id")).join(of, "node_id").groupBy("silo_id").agg(F.count("*").alias(name))
            g = g.join(n, "silo_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return g


def usage_summary(events: DataFrame, since: Column) -> DataFrame:
    return events.where(F.col("ts") >= since).groupBy("event_type").agg(F.count("*").alias("n_calls"), F.max("ts").cast("string").alias("last_used"))


def status_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per silo and state the nodes, the edges that start at them, and bytes of content."""
    g = nodes.groupBy("silo_id", "state").agg(F.count("*").alias("n_nodes"), F.sum(F.octet_length("content")).cast("long").alias("content_bytes"))
    e = edges.select(F.col("src").alias("node_id")).join(nodes.select("node_id", "silo_id", "state"), "node_id").groupBy("silo_id", "state").agg(F.count("*").alias("n_edges"))
    return g.join(e, ["silo_id", "state"], "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))


def retrieval_quality(hits: DataFrame) -> DataFrame:
    """Per query the mean score and what it says: high above .6, partial from .4, low, none; at most partial where a channel fell back; with advice.

    ``hits``: ``query_id, score, fallback``.
    """
    g = hits.groupBy("query_id").agg(F.round(F.avg("score"), 9).alias("avg_score"), F.bool_or(F.coalesce("fallback", F.lit(False))).alias("fallback"))
    q = F.when((F.col("avg_score") > 0.6) & ~F.col("fallback"), "high").when(F.col("avg_score") >= 0.4, "partial").when(F.col("avg_score") > 0, "low").otherwise("none")
    advice = exprs.lookup({"high": "", "partial": "narrow the query or ask for more hits", "low": "rephrase the query", "none": "nothing is known: store it first"}, "quality")
    return g.withColumn("quality", q).withColumn("suggestion", advice).drop("fallback")


def consolidate_conclusions(rows: DataFrame, key: str) -> DataFrame:
    """Per context with two active conclusions or more and none consolidated yet the most confident one, raised with the number that agree."""
    live = rows.where("state = 'ACTIVE'")
    g = live.groupBy(key).agg(F.count("*").alias("n"), F.avg("confidence").alias("mean"), F.min_by("node_id", F.struct(-F.col("confidence"), "node_id")).alias("node_id"))
    g = g.where("n >= 2").join(rows.where("consolidated").select(key).distinct(), key, "left_anti")
    return g.select(key, "node_id", "n", F.least(F.lit(1.0), F.col("mean") + F.least(F.lit(0.1), 0.02 * F.col("n"))).alias("confidence"))


def finding_quality(findings: DataFrame) -> DataFrame:
    """.25 density + .30 coverage + .15 relations + .20 primary share + .10 summary density, each in [0, 1]; rejected where no claim survives outside the silo scope."""
    c = exprs.clamp
    score = 0.25 * c("density") + 0.30 * c("coverage") + 0.15 * c("relations") + 0.20 * c("primary_share") + 0.10 * c("summary_density")
    return findings.withColumns({"quality": score, "rejected": (F.col("n_claims") == 0) & (F.col("scope") != "silo")})


def membership_drift(prior: DataFrame, current: DataFrame, key: str, least: float = 0.8) -> DataFrame:
    """Jaccard similarity of a group's members before and now, with fingerprints that no order changes; two empty groups are alike."""
    a, b = prior.select(key, F.col("members").alias("before")), current.select(key, F.col("members").alias("now"))
    j = a.join(b, key, "full_outer")
    before, now = (F.coalesce(c, F.array().cast("array<bigint>")) for c in ("before", "now"))
    union = F.size(F.array_union(before, now))
    jac = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(before, now)) / union)
    mark = lambda c: F.sha2(F.array_join(F.array_sort(F.array_distinct(c)).cast("array<string>"), ","), 256)
    return j.select(key, jac.alias("jaccard"), (jac < least).alias("drifted"), mark(before).alias("fingerprint_before"), mark(now).alias("fingerprint"))


def reflection_suggested(hits: DataFrame, below: float = 0.4) -> DataFrame:
    c = F.when(F.coalesce("confidence", F.lit(0.0)) == 0, 1.0).otherwise(F.col("confidence"))
    return hits.groupBy("silo_id").agg(F.avg(c).alias("avg_confidence")).withColumn("suggest", F.round("avg_confidence", 9) < below)


def volatile_topics(versions: DataFrame, least: int = 3) -> DataFrame:
    """Chains with many superseded versions behind their head."""
    n = versions.groupBy("chain_id").agg((F.count("*") - 1).alias("n_superseded"), F.max_by("node_id", F.struct("valid_from", "node_id")).alias("head"))
    return n.where(F.col("n_superseded") >= least)


def knowledge_gaps(queries: DataFrame, least: int) -> DataFrame:
    """Unanswered questions by the hash of their text: how often, first and last asked."""
    g = queries.where("not answered").groupBy(F.sha2(F.lower(F.trim("text")), 256).alias("query_hash"))
    return g.agg(F.count("*").alias("n_asked"), F.min("asked").alias("first_asked"), F.max("asked").alias("last_asked")).where(F.col("n_asked") >= least)


def top_cited(edges: DataFrame, k: int = 20) -> DataFrame:
    return edges.groupBy("dst").agg(F.count("*").alias("n_citations")).orderBy(F.desc("n_citations"), "dst").limit(k)


def silos_with_pending_work(nodes: DataFrame) -> DataFrame:
    """Tenants by kind of pending work."""
    kinds = {"embed": "length(content) >= 10 and quality is null", "decay": "layer = 'memory' and age_hours > 1", "tombstone": "state = 'SUPERSEDED'"}
    kind = F.explode(F.filter(F.array(*[F.when(F.expr(c), F.lit(k)) for k, c in kinds.items()]), lambda x: x.isNotNull()))
    return nodes.select("silo_id", kind.alias("kind")).distinct()


def community_stability(labels: DataFrame) -> DataFrame:
    """The share of nodes whose label is the same in all runs, and how many communities a run has at least and at most."""
    per = labels.groupBy("node_id").agg(F.count_distinct("label").alias("n"))
    runs = labels.groupBy("run").agg(F.count_distinct("label").alias("c")).agg(F.min("c").alias("fewest"), F.max("c").alias("most"))
    return per.agg(F.avg((F.col("n") == 1).cast("double")).alias("stability"), F.count("*").alias("n_nodes")).crossJoin(F.broadcast(runs))


def dashboard_metrics(nodes: DataFrame) -> DataFrame:
    return nodes.agg(
        F.count("*").alias("total"), F.count_if(F.col("age_hours") < 24).alias("last_day"), F.count_if(F.col("age_hours") < 7 * 24).alias("last_week"),
        *[F.count_if(F.col("layer") == x).alias(f"n_{x}") for x in ("memory", "knowledge", "wisdom", "intelligence")],
    )


def orphaned_conclusions(rows: DataFrame, key: str) -> DataFrame:
    """Conclusions marked consolidated whose context has no consolidated one that lives: to be active again."""
    held = rows.where("consolidated and state = 'ACTIVE'").select(key).distinct()
    return rows.where("state = 'SUPERSEDED'").join(held, key, "left_anti")
