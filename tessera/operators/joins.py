"""Corroboration, contradiction, promotion inputs and other joins over claims, facts and edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import schema
from tessera.functions import exprs
from tessera.operators.graph import would_cycle
from tessera.operators.scans import BROADCAST_ROWS, in_blocks
from tessera.scratch import materialize

SPO = ["silo_id", "subject", "predicate", "object"]


def corroborate_exact(claims: DataFrame, least: int = 3) -> DataFrame:
    """Per claim the distinct evidence of its (subject, predicate, object), and whether that promotes it."""
    n = claims.groupBy(*SPO).agg(F.count_distinct("evidence").alias("n_evidence"))
    return claims.join(n, SPO).withColumn("promote", F.col("n_evidence") >= least)


def spo_conflicts(claims: DataFrame) -> DataFrame:
    """Pairs of different objects asserted of the same (subject, predicate), both ways, with their claims counted.

    Pairs are of distinct objects, not of claims, so a common (subject, predicate) stays small;
    each object's claims can be joined back where needed.
    """
    per = claims.groupBy(*SPO).agg(F.count("*").alias("n_claims"), F.min("claim_id").alias("first_claim"))
    a = per.select("silo_id", "subject", "predicate", F.col("object").alias("object_a"), F.col("n_claims").alias("n_a"), F.col("first_claim").alias("claim_a"))
    b = per.select("silo_id", "subject", "predicate", F.col("object").alias("object_b"), F.col("n_claims").alias("n_b"), F.col("first_claim").alias("claim_b"))
    return a.join(b, ["silo_id", "subject", "predicate"]).where("object_a <> object_b").withColumn("status", F.lit("unresolved"))


def neighborhood_conflicts(refs: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that contradict any referenced one, in either direction."""
    c = edges.where("edge_type = 'CONTRADICTS'")
    both = c.select(F.col("src").alias("id"), F.col("dst").alias("other")).union(c.select(F.col("dst").alias("id"), F.col("src").alias("other")))
    return both.join(refs.select("id").distinct(), "id", "left_semi").select("other").distinct()


def shared_evidence_peers(claims: DataFrame) -> DataFrame:
    """Per claim how many others cite the same evidence: a count a group, never the pairs."""
    n = claims.groupBy("silo_id", "evidence").agg(F.count("*").alias("n"))
    return claims.join(n, ["silo_id", "evidence"]).select("claim_id", (F.col("n") - 1).alias("n_peers"))


def session_conflicts(hypotheses: DataFrame) -> DataFrame:
    """Per hypothesis how many others of its session are about the same node."""
    n = hypotheses.groupBy("session", "target").agg(F.count("*").alias("n"))
    return hypotheses.join(n, ["session", "target"]).where("n > 1").select("hypothesis", (F.col("n") - 1).alias("n_others"))


def epistemic_edges(edges: DataFrame) -> DataFrame:
    """Per node its distinct neighbours by kind of edge."""
    pick = lambda kind: F.sort_array(F.collect_set(F.when(F.col("edge_type") == kind, F.col("dst"))))
    return edges.groupBy("src").agg(pick("SUPPORTS").alias("supports"), pick("CONTRADICTS").alias("contradicts"), pick("CAUSES").alias("causes"))


def conflict_expand(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """Contradicting nodes that are not hits themselves."""
    found = neighborhood_conflicts(hits.select(F.col("node_id").alias("id")), edges)
    return found.join(hits.select(F.col("node_id").alias("other")).distinct(), "other", "left_anti")


def belief_contributors(claims: DataFrame) -> DataFrame:
    """Per (subject, predicate) belief the claims and agents behind it."""
    return claims.groupBy("silo_id", "subject", "predicate").agg(
        F.count("*").alias("n_claims"), F.count_distinct("object").alias("n_facts"), F.count_distinct("agent_id").alias("n_agents")
    )


def agent_stats(claims: DataFrame, agents: DataFrame) -> DataFrame:
    """Distinct claims, facts and beliefs of every agent, agents without any included."""
    n = claims.groupBy("agent_id").agg(
        F.count("*").alias("n_claims"), F.count_distinct("silo_id", "subject", "predicate", "object").alias("n_facts"),
        F.count_distinct("silo_id", "subject", "predicate").alias("n_beliefs"),
    )
    return agents.join(n, "agent_id", "left").fillna(0, ["n_claims", "n_facts", "n_beliefs"])


def agents_summary(agents: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.groupBy("agent_id").agg(F.count("*").alias("n_nodes"))
    return agents.join(n, "agent_id", "left").select("agent_id", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), F.coalesce("trust", F.lit(0.5)).alias("trust"))


def list_conflicts(edges: DataFrame, nodes: DataFrame, k: int, status: str | None = None, agent: int | None = None) -> DataFrame:
    """Contradiction edges with what both ends say, newest first; of one status or with an end of one agent where asked.

    ``edges``: ``src, dst, edge_type, status, created_at``; ``nodes``: ``id, content, agent_id``.
    """
    end = lambda c: nodes.select(F.col("id").alias(c), F.col("content").alias(f"{c}_content"), F.col("agent_id").alias(f"{c}_agent"))
    c = edges.where("edge_type = 'CONTRADICTS'")
    if status is not None:
        c = c.where(F.col("status") == status)
    c = c.join(end("src"), "src").join(end("dst"), "dst")
    if agent is not None:
        c = c.where((F.col("src_agent") == agent) | (F.col("dst_agent") == agent))
    return c.orderBy(F.desc("created_at"), "src", "dst").limit(k)


def entity_corroboration(edges: DataFrame) -> DataFrame:
    """Pairs of sources (a < b) that support the same node, with how many they share."""
    e = edges.where("edge_type = 'SUPPORTS'").select("src", "dst")
    a, b = e.select(F.col("src").alias("a"), "dst"), e.select(F.col("src").alias("b"), "dst")
    return a.join(b, "dst").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def independence(pairs: DataFrame) -> DataFrame:
    """How independent two facts are: .2, and what differs: document .3, agent .3, more than a day .2, tier .2, at most 1."""
    score = (
        F.lit(0.2) + F.when(F.col("doc_a") != F.col("doc_b"), 0.3).otherwise(0) + F.when(F.col("agent_a") != F.col("agent_b"), 0.3).otherwise(0)
        + F.when(F.abs(F.col("hours_a") - F.col("hours_b")) > 24, 0.2).otherwise(0) + F.when(F.col("tier_a") != F.col("tier_b"), 0.2).otherwise(0)
    )
    return pairs.withColumn("independence", F.least(F.lit(1.0), score))


def source_tier(refs: DataFrame, rules: DataFrame, nodes: DataFrame | None = None, hint: str | None = None) -> DataFrame:
    """Per page the best of its node's tier and of the first rule that its URI matches; else the hint; else ``unknown``; and what decided.

    ``refs``: ``page_id, url, silo_id``; ``rules``: ``pattern, tier, priority, silo_id`` (null: of all
    silos). Rules of the silo come before general ones, then by priority, then by pattern. ``nodes``: ``page_id,
    tier``, the best of several counts. A theta join: rules are broadcast in blocks of a checked size.
    """
    hit = None
    for block in in_blocks(rules.select(exprs.glob_regex("pattern").alias("regex"), "pattern", "tier", "priority", F.col("silo_id").alias("rule_silo")), "pattern"):
        part = refs.join(block, F.expr("url rlike regex and (rule_silo is null or rule_silo = silo_id)"))
        hit = part if hit is None else hit.union(part)
    first = hit.groupBy("page_id").agg(F.min_by("tier", F.struct(F.col("rule_silo").isNull(), -F.col("priority"), "pattern")).alias("rule_tier"))
    j = refs.join(first, "page_id", "left")
    if nodes is not None:
        j = j.join(nodes.groupBy("page_id").agg(F.max_by("tier", rank_tier("tier")).alias("node_tier")), "page_id", "left")
    else:
        j = j.withColumn("node_tier", F.lit(None).cast("string"))
    level = lambda c: F.coalesce(rank_tier(c), F.lit(-1))
    by_node = F.col("node_tier").isNotNull() & (level("node_tier") >= F.when(F.col("rule_tier").isNull(), -1).otherwise(level("rule_tier")))
    told = F.when(by_node, F.col("node_tier")).otherwise(F.coalesce("rule_tier", F.lit(hint), F.lit("unknown")))
    why = F.when(by_node, "node").when(F.col("rule_tier").isNotNull(), "rule").otherwise("none" if hint is None else "hint")
    return j.select("page_id", told.alias("tier"), why.alias("decided_by"))


def stale_commitments(versions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Commitments whose target has evidence newer than they are, with the ids of it in order."""
    joined = versions.select("node_id", "chain_id", "valid_from").join(evidence, "chain_id").where("seen > valid_from")
    return joined.groupBy("node_id").agg(F.sort_array(F.collect_set("evidence_id")).alias("evidence"))


def session_pairs(turns: DataFrame) -> DataFrame:
    """Earlier to later pairs of the chains of a session: ``session, chain, created``."""
    a = turns.select("session", F.col("chain").alias("earlier"), F.col("created").alias("t1"))
    b = turns.select("session", F.col("chain").alias("later"), F.col("created").alias("t2"))
    return a.join(b, "session").where("t1 < t2").select("session", "earlier", "later").distinct()


def shared_participation(edges: DataFrame, node: int, least: int = 2) -> DataFrame:
    """Nodes that share at least ``least`` hyperedges (sources) with one node."""
    mine = edges.where(F.col("dst") == node).select("src").distinct()
    return edges.join(mine, "src", "left_semi").where(F.col("dst") != node).groupBy("dst").agg(F.count_distinct("src").alias("n")).where(F.col("n") >= least)


def orphans(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    return left.join(right.select(on).distinct(), on, "left_anti")


def premises_exist(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """References (``holder, ref, silo_id``) with their first violation: missing, wrong silo, tombstoned, or null."""
    n = nodes.select(F.col("node_id").alias("ref"), "state", F.col("silo_id").alias("ref_silo")).withColumn("there", F.lit(True))
    why = F.when(F.col("there").isNull(), "missing").when(F.col("ref_silo") != F.col("silo_id"), "wrong_silo").when(F.col("state") == "TOMBSTONED", "tombstoned")
    return refs.join(n, "ref", "left").select("holder", "ref", why.alias("violation"))


def evidence_accessible(chains: DataFrame, access: DataFrame) -> DataFrame:
    """Chains all of whose evidence a session may see."""
    missing = chains.join(access, ["session", "evidence"], "left_anti").select("chain").distinct()
    return chains.select("chain").distinct().join(missing, "chain", "left_anti")


def link_validate(new: DataFrame, nodes: DataFrame, edges: DataFrame, hops: int = 10) -> DataFrame:
    """New edges with the first rule they break: self loop, missing end, cross silo, deleted end, duplicate, cycle; null if none.

    ``nodes``: ``id, silo_id, state``; an id that repeats has its least silo and is deleted if any of its rows is.
    Cycles are asked for edges of the acyclic types.
    """
    one = nodes.groupBy("id").agg(F.min("silo_id").alias("silo_id"), F.max("state").alias("state"))
    end = lambda c: one.select(F.col("id").alias(c), F.col("silo_id").alias(f"{c}_silo"), F.col("state").alias(f"{c}_state"), F.lit(True).alias(f"has_{c}"))
    e = new.join(end("src"), "src", "left").join(end("dst"), "dst", "left")
    e = e.join(edges.select("src", "dst", "edge_type").distinct().withColumn("known", F.lit(True)), ["src", "dst", "edge_type"], "left")
    acyclic = F.col("edge_type").isin(*schema.ACYCLIC_EDGES)
    walked = would_cycle(edges.where(acyclic), new.where(acyclic & (F.col("src") != F.col("dst"))), hops)
    e = e.join(walked, ["src", "dst"], "left")
    gone = lambda c: F.coalesce(F.col(f"{c}_state").isin("TOMBSTONED", "DELETED"), F.lit(False))
    code = (
        F.when(F.col("src") == F.col("dst"), "self_loop").when(F.col("has_src").isNull() | F.col("has_dst").isNull(), "missing_node")
        .when(F.col("src_silo") != F.col("dst_silo"), "cross_silo").when(gone("src") | gone("dst"), "deleted_node").when(F.col("known"), "duplicate").when(acyclic & F.col("cycle"), "cycle")
    )
    return e.select("src", "dst", "edge_type", code.alias("code"))


def resolve_alias(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """The mentions with their ``entity_id`` (null: none) by the key of the surface form (``exprs.nfkc_fold``); of equal aliases the smallest entity."""
    known = aliases.where("alias is not null").select(exprs.nfkc_fold(F.col("alias")).alias("k"), "entity_id").groupBy("k").agg(F.min("entity_id").alias("entity_id"))
    return mentions.withColumn("k", exprs.nfkc_fold(F.col("surface"))).join(known, "k", "left").drop("k")


def entity_dedup(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """The entity of each mention by lowered name, else by lowered qualified name, else a new stable id.

    ``mentions``: ``mention_id, name, qualified_name``; ``entities``: ``entity_id, name, qualified_name``; of several the smallest id.
    """
    by = lambda c: entities.where(F.col(c).isNotNull()).groupBy(F.lower(c).alias(f"{c}_key")).agg(F.min("entity_id").alias(f"{c}_entity"))
    m = mentions.withColumns({"name_key": F.lower("name"), "qualified_name_key": F.lower("qualified_name")})
    m = m.join(by("name"), "name_key", "left").join(by("qualified_name"), "qualified_name_key", "left")
    return m.select("mention_id", F.coalesce(F.col("name_entity").cast("string"), F.col("qualified_name_entity").cast("string"), exprs.content_id("name_key")).alias("entity"))


def mentions_of(texts: DataFrame, key: str, text: str, subjects: DataFrame, block: int = BROADCAST_ROWS) -> DataFrame:
    """``subject, <key>``, distinct: the rows of ``texts`` whose text contains the subject, case-insensitively.

    One pass over each text finds all subjects of a block with an Aho-Corasick automaton; a block holds ``block`` subjects at
    most, each further one scans the texts once more. A null subject or text gives nothing, an empty subject stands in every text.
    """
    asked = materialize(subjects.select("subject", F.lower("subject").alias("s")).where("subject is not null").distinct(), "mention-subjects")
    low = texts.where(F.col(text).isNotNull()).select(key, F.lower(text).alias("x"))
    kind = texts.schema[key].dataType.simpleString()
    n = max(1, -(-asked.count() // block))
    told = None
    for i in range(n):
        patterns = [r.s for r in asked.where(F.pmod(F.xxhash64("s"), F.lit(n)) == i).select("s").distinct().collect()]  # a block's at most

        def run(batches: Iterator[pa.RecordBatch], patterns: list[str] = patterns) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for p in filter(None, patterns):
                machine.add_word(p, p)
            machine.make_automaton()
            everywhere = {""} & set(patterns)
            for batch in batches:
                ids, found = batch.column(key).to_pylist(), []
                for at, x in enumerate(batch.column("x").to_pylist()):
                    found += [(at, s) for s in (everywhere | {s for _, s in machine.iter(x)} if len(machine) else everywhere)]
                yield pa.RecordBatch.from_arrays([pa.array([s for _, s in found], pa.string()), pa.array([ids[at] for at, _ in found], batch.column(key).type)], names=["s", key])

        part = low.mapInArrow(run, f"s string, {key} {kind}")
        told = part if told is None else told.union(part)
    return told.join(asked, "s").select("subject", key).distinct()


def _live(beliefs: DataFrame) -> DataFrame:
    return beliefs.where(F.coalesce(F.col("state") != "TOMBSTONED", F.lit(True)))


def belief_coverage(beliefs: DataFrame, subjects: DataFrame, as_of: Column) -> DataFrame:
    """Per subject how many beliefs mention it, case-insensitively, are valid at a time and live, and the facts behind them.

    ``beliefs``: ``node_id, content, state, valid_from, valid_to, facts``. A subject that none mentions has 0 and no facts.
    """
    live = _live(beliefs).where((F.col("valid_from").isNull() | (F.col("valid_from") <= as_of)) & (F.col("valid_to").isNull() | (F.col("valid_to") > as_of)))
    told = materialize(mentions_of(live, "node_id", "content", subjects), "coverage")
    n = told.groupBy("subject").agg(F.count("*").alias("n_nodes"))
    each = told.join(live.select("node_id", F.explode("facts").alias("fact")), "node_id").select("subject", "fact").distinct()
    facts = each.groupBy("subject").agg(F.sort_array(F.collect_list("fact")).alias("facts"))
    j = subjects.join(n, "subject", "left").join(facts, "subject", "left")
    return j.select("subject", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), F.coalesce("facts", F.array().cast("array<bigint>")).alias("facts"))


def similar_beliefs(beliefs: DataFrame, subjects: DataFrame, as_of: Column, k: int = 10) -> DataFrame:
    """``subject, rank, node_id, confidence, facts``: the k surest live beliefs that mention a subject and have not ended; no confidence counts as 1, ties go to the smaller id."""
    live = _live(beliefs).where(F.col("valid_to").isNull() | (F.col("valid_to") > as_of))
    told = mentions_of(live, "node_id", "content", subjects).join(live.select("node_id", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), "facts"), "node_id")
    w = Window.partitionBy("subject").orderBy(F.desc("confidence"), "node_id")
    return told.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("subject", "rank", "node_id", "confidence", "facts")


def history_by_subject(nodes: DataFrame, subjects: DataFrame, k: int = 50) -> DataFrame:
    """``subject, place, node_id, valid_from, valid_to, confidence``: the k oldest live nodes that mention a subject in their content or their own ``about``; without a start first."""
    live = _live(nodes)
    told = mentions_of(live, "node_id", "content", subjects).union(mentions_of(live, "node_id", "about", subjects)).distinct()
    j = told.join(live.select("node_id", "valid_from", "valid_to", "confidence"), "node_id")
    w = Window.partitionBy("subject").orderBy(F.col("valid_from").asc_nulls_first(), "node_id")
    return j.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("subject", "place", "node_id", "valid_from", "valid_to", "confidence")


def validate_citations(cites: DataFrame, seen: DataFrame, nodes: DataFrame, least: float = 0.7) -> DataFrame:
    """Per finding the first fault of its citations in rank order, or null, with the offenders of that fault.

    Ranks: hallucinated (not seen), invalid (absent), cross_silo, low_confidence. ``cites``: ``finding, node_id,
    silo_id, confidence``; ``nodes``: ``node_id, silo_id``.
    """
    c = cites.join(seen.select("finding", "node_id").distinct().withColumn("was_seen", F.lit(True)), ["finding", "node_id"], "left")
    c = c.join(nodes.select("node_id", F.col("silo_id").alias("node_silo")).distinct().withColumn("exists", F.lit(True)), "node_id", "left")
    rank = F.when(F.col("was_seen").isNull(), 1).when(F.col("exists").isNull(), 2).when(F.col("node_silo") != F.col("silo_id"), 3).when(F.col("confidence") < least, 4)
    of = c.withColumn("rank", rank).groupBy("finding", "rank").agg(F.sort_array(F.collect_set("node_id")).alias("offenders"))
    per = of.groupBy("finding").agg(F.min_by(F.struct("rank", "offenders"), F.coalesce("rank", F.lit(99))).alias("w"))
    fault = exprs.lookup({1: "hallucinated", 2: "invalid", 3: "cross_silo", 4: "low_confidence"}, F.col("w.rank"))
    return per.select("finding", fault.alias("fault"), F.when(F.col("w.rank").isNotNull(), F.col("w.offenders")).otherwise(F.array().cast("array<bigint>")).alias("offenders"))


def supersession_candidates(new: DataFrame, existing: DataFrame, recalled: DataFrame, near: DataFrame, recent_minutes: int = 5) -> DataFrame:
    """The best earlier claim that each new one replaces, its tier and score, and whether that is automatic.

    Tier 1: recalled in the new claim's session and about the same subject (.95, automatic). Tier 2: the same agent's
    newest on (subject, predicate) (.9) or on the subject (.7), + .05 for the same session, + .03 within
    minutes; automatic where the predicate agrees, the object differs, and one of these holds. Tier 3: the nearest in
    meaning (.5). A later tier counts only without an automatic hit before it; of the rest the best score stands.

    ``new``, ``existing``: ``claim_id, agent_id, subject, predicate, object, session, created_at``; ``recalled``: ``session,
    claim_id``; ``near``: ``claim_id, other``. The newest of each key is found by aggregation, never by pairs.
    """
    cols = F.struct("claim_id", "object", "session", "created_at")
    newest = lambda df, keys, as_: df.groupBy(*keys).agg(F.max_by(cols, F.struct("created_at", "claim_id")).alias(as_))
    seen = existing.join(recalled.select(F.col("session").alias("asking"), "claim_id").distinct(), "claim_id")
    one = seen.groupBy(F.col("asking").alias("session"), "subject").agg(F.max_by("claim_id", F.struct("created_at", "claim_id")).alias("one"))
    j = new.join(one, ["session", "subject"], "left")
    j = j.join(newest(existing, ["agent_id", "subject", "predicate"], "sp"), ["agent_id", "subject", "predicate"], "left").join(newest(existing, ["agent_id", "subject"], "s"), ["agent_id", "subject"], "left")
    j = j.join(near.groupBy("claim_id").agg(F.min("other").alias("three")), "claim_id", "left")
    old = F.coalesce("sp", "s")
    j = j.withColumns({"old": old, "same_session": F.coalesce(old["session"] == F.col("session"), F.lit(False)), "recent": F.coalesce(F.abs(F.timestamp_diff("SECOND", old["created_at"], F.col("created_at"))) < recent_minutes * 60, F.lit(False))})
    two = F.when(F.col("sp").isNotNull(), 0.9).when(F.col("s").isNotNull(), 0.7) + F.col("same_session").cast("int") * 0.05 + F.col("recent").cast("int") * 0.03
    auto2 = F.coalesce(F.col("sp").isNotNull() & (F.col("sp.object") != F.col("object")) & (F.col("same_session") | F.col("recent")), F.lit(False))
    tier = F.when(F.col("one").isNotNull(), 1).when(F.col("old").isNotNull(), 2).when(F.col("three").isNotNull(), 3)
    return j.select(
        "claim_id", F.coalesce("one", "old.claim_id", "three").alias("supersedes"), tier.alias("tier"),
        F.round(F.when(F.col("one").isNotNull(), 0.95).otherwise(F.coalesce(two, F.lit(0.5))), 6).alias("score"), (F.col("one").isNotNull() | ((tier == 2) & auto2)).alias("auto"),
    ).where("tier is not null")


def rank_tier(c: Column | str) -> Column:
    return exprs.lookup(schema.TIER_RANK, c, 0)


def independence_groups(pairs: DataFrame, key: str, least: float = 2.0) -> DataFrame:
    """Per group of facts the sum of its pairs' independence and whether it suffices."""
    g = independence(pairs).groupBy(key).agg(F.round(F.sum("independence"), 6).alias("total"), F.count("*").alias("n_pairs"))
    return g.withColumn("passes", F.col("total") >= least)


def orphan_kinds(summaries: DataFrame, chains: DataFrame, sources: DataFrame, claims: DataFrame, steps: DataFrame, nodes: DataFrame, links: DataFrame, old_hours: int = 7 * 24) -> DataFrame:
    """``kind, id`` of what has lost what it stands on.

    Summaries whose chain is gone; sources that no claim derives from and that are old; steps
    without a node; links of which neither end lives.
    """
    live = nodes.where("state <> 'TOMBSTONED'").select("id")
    kinds = {
        "summary": orphans(summaries.select("id", "chain_id"), chains, "chain_id"),
        "source": orphans(sources.where(F.col("age_hours") > old_hours).select("id", F.col("id").alias("source_id")), claims, "source_id"),
        "step": orphans(steps.select(F.col("step_id").alias("id"), "node_id"), nodes.select(F.col("id").alias("node_id")), "node_id"),
        "link": orphans(orphans(links.select(F.col("link_id").alias("id"), "a", "b"), live.withColumnRenamed("id", "a"), "a"), live.withColumnRenamed("id", "b"), "b"),
    }
    out = None
    for kind, df in kinds.items():
        one = df.select(F.lit(kind).alias("kind"), "id")
        out = one if out is None else out.unionByName(one)
    return out
