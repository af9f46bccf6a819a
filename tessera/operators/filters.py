"""Projections, filters and predicates over nodes and hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import exprs


def filter_hits(hits: DataFrame, layers: list[str], min_confidence: float, any_tags: list[str] | None = None, include_superseded: bool = False, now: Column | None = None) -> DataFrame:
    """Layer in a set, confidence (null counts as 1) at least a bound, any of the tags; what is superseded or has ended goes unless asked for."""
    kept = hits.where(F.col("layer").isin(*layers) & (F.coalesce("confidence", F.lit(1.0)) >= min_confidence))
    if any_tags:
        kept = kept.where(F.coalesce(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in any_tags])), F.lit(False)))
    if include_superseded:
        return kept
    kept = kept.where(F.coalesce("state", F.lit("ACTIVE")) != "SUPERSEDED")
    return kept if now is None else kept.where(F.col("valid_to").isNull() | (F.col("valid_to") > now))


def filter_all_tags(df: DataFrame, tags: list[str]) -> DataFrame:
    return df.where(F.size(F.array_except(F.array(*[F.lit(t) for t in tags]), F.coalesce("tags", F.array().cast("array<string>")))) == 0)


def filter_agents(df: DataFrame, agent: int | None = None, exclude: list[int] | None = None) -> DataFrame:
    """One author, or all but some; a row without author passes exclusion only."""
    if agent is not None:
        df = df.where(F.col("agent_id") == agent)
    if exclude:
        df = df.where(F.col("agent_id").isNull() | ~F.col("agent_id").isin(*exclude))
    return df


def filter_inactive(df: DataFrame) -> DataFrame:
    return df.where(F.col("state").isNull() | (F.col("state") == "ACTIVE"))


def as_of(df: DataFrame, ts: Column) -> DataFrame:
    """Rows that existed at ``ts``: created by then, not yet ended; null bounds pass."""
    return df.where((F.col("valid_from").isNull() | (F.col("valid_from") <= ts)) & (F.col("valid_to").isNull() | (F.col("valid_to") > ts)))


def temporal_query(versions: DataFrame, ts: Column, k: int, label: str | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """Of the rows valid at ``ts`` with content and no tombstone the k that began last; of one label, among candidates (``node_id``) where given."""
    df = as_of(versions, ts).where("valid_from is not null and length(content) > 0 and coalesce(state, 'ACTIVE') <> 'TOMBSTONED'")
    if label is not None:
        df = df.where(F.col("label") == label)
    if candidates is not None:
        df = df.join(candidates.select("node_id").distinct(), "node_id", "left_semi")
    return df.orderBy(F.desc("valid_from"), "node_id").limit(k)


def temporal_status(ids: DataFrame, versions: DataFrame, ts: Column) -> DataFrame:
    found = ids.join(versions.select("node_id", "valid_from", "valid_to"), "node_id", "left")
    status = (
        F.when(F.col("valid_from").isNull(), "node_not_found").when(F.col("valid_from") > ts, "not_yet_valid")
        .when(F.col("valid_to").isNotNull() & (F.col("valid_to") <= ts), "node_expired").otherwise("valid")
    )
    return found.select("node_id", status.alias("status"))


def filter_created(df: DataFrame, column: str, since: Column, until: Column) -> DataFrame:
    """Inclusive range; rows without a time are kept."""
    return df.where(F.col(column).isNull() | F.col(column).between(since, until))


def content_policy(df: DataFrame, summary: int = 200) -> DataFrame:
    """HOT and WARM nodes in full, COLD ones as a summary that can be expanded."""
    cold = (exprs.tier("heat_score") == "COLD") & (F.length("content") > summary)
    return df.withColumns({"tier": exprs.tier("heat_score"), "shown": F.when(cold, F.substring("content", 1, summary)).otherwise(F.col("content")), "expandable": cold})


def layer_threshold(df: DataFrame, overrides: dict[str, float] | None = None, low: float = 0.15, high: float = 0.25, rerank_floor: float = 0.0) -> DataFrame:
    """Hits at or above their layer's cut, with the number below it; a null score is kept.

    ``overrides`` replace a layer's cut; no cut is below ``rerank_floor``, which holds where scores come from a reranker.
    """
    cut = F.when(F.col("layer").isin("knowledge", "wisdom"), high).otherwise(low)
    if overrides:
        cut = F.coalesce(exprs.lookup(overrides, "layer"), cut)
    marked = df.withColumn("below", F.coalesce(F.col("score") < F.greatest(cut, F.lit(rerank_floor)), F.lit(False)))
    below = marked.where("below").groupBy("layer").agg(F.count("*").alias("n_below"))
    return marked.where("not below").drop("below").join(F.broadcast(below), "layer", "left").withColumn("n_below", F.coalesce("n_below", F.lit(0)))


def adaptive_threshold(df: DataFrame, alpha: float = 0.5, floor: float = 0.1) -> DataFrame:
    """Hits at or above max(alpha x the query's best score, floor); the best is aggregated, then joined."""
    best = df.groupBy("query_id").agg(F.greatest(F.max("score") * alpha, F.lit(floor)).alias("cut"))
    return df.join(best, "query_id").where("score >= cut").drop("cut")


def finding_visible(df: DataFrame) -> DataFrame:
    return df.where((F.col("kind") != "finding") | (F.col("origin") == "extraction") | F.col("published"))


def trust_gate(hits: DataFrame, floor: float, withhold_conflicts: bool = True) -> DataFrame:
    """Each hit with the reason it is withheld for (null: surfaced); conflict before confidence."""
    reason = F.when(F.col("conflicted") & F.lit(withhold_conflicts), "conflict").when(exprs.effective_confidence("confidence") < floor, "low_confidence")
    return hits.withColumn("reason", reason)


def claim_filter(claims: DataFrame, dropped: DataFrame, suspect: list[str], never: list[str], public: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Claims with the rule that drops them, null where they stay; the dropped side is the audit.

    Hard drops go first; never-filtered predicates and allowed subjects (``name``) stay; of suspect
    predicates those go whose subject and object are both public names. Keys compare in lower case.
    """
    low = lambda c: F.lower(F.col(c).cast("string"))
    keyed = claims.withColumn("key", F.struct(low("subject").alias("s"), low("predicate").alias("p"), low("object").alias("o")))
    hard = dropped.select(F.struct(low("subject").alias("s"), low("predicate").alias("p"), low("object").alias("o")).alias("key"), F.lit(True).alias("hard")).distinct()
    names = lambda df, as_: df.select(low("name").alias("name")).distinct().withColumn(as_, F.lit(True))
    marked = keyed.join(hard, "key", "left")
    for end in ("s", "o"):
        known = names(public, f"public_{end}")
        marked = marked.join(known, F.col(f"key.{end}") == known["name"], "left").drop("name")
    if allowed is not None:
        known = names(allowed, "allowed")
        marked = marked.join(known, F.col("key.s") == known["name"], "left").drop("name")
    else:
        marked = marked.withColumn("allowed", F.lit(None).cast("boolean"))
    rule = (
        F.when(F.col("hard"), "hard_drop").when(F.col("key.p").isin(*[x.lower() for x in never]) | F.col("allowed"), None)
        .when(F.col("key.p").isin(*[x.lower() for x in suspect]) & F.col("public_s") & F.col("public_o"), "public_ends")
    )
    return marked.withColumn("rule", rule).drop("key", "hard", "allowed", "public_s", "public_o")


def contradiction_ttl(nodes: DataFrame, hours: int = 1) -> DataFrame:
    """Nodes flagged within the window, one row a peer."""
    return nodes.where((F.col("flagged_hours") >= 0) & (F.col("flagged_hours") <= hours)).select("node_id", F.explode("peers").alias("peer_id"))


def edges_among(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in the set, each once."""
    a, b = ids.select(F.col("id").alias("src")).distinct(), ids.select(F.col("id").alias("dst")).distinct()
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi").dropDuplicates(["src", "dst", "edge_type"])


def keep_top(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key; Spark limits groups before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
