"""Ranked retrieval over a table of queries: five channels, fusion, rescoring, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import exprs
from tessera.operators.aggregates import retrieval_quality
from tessera.operators.filters import layer_threshold
from tessera.operators.graph import ppr_channel
from tessera.operators.lifecycle import dominated
from tessera.operators.similarity import nearest
from tessera.operators.text_search import TOKEN, asked_terms, counted_terms, node_grams, node_words, top_by_text, top_by_words, trigram_codes, weighted_terms, words_of
from tessera.operators.windows import rrf_fuse
from tessera.scratch import materialize


def asked_words(queries: DataFrame) -> DataFrame:
    """``query_id, token``: the distinct words of each query."""
    return queries.select("query_id", F.explode(F.array_distinct(words_of("text"))).alias("token"))


def _top(df: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25(queries: DataFrame, nodes: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, words: DataFrame | None = None) -> DataFrame:
    """Each query's k best nodes by BM25, exactly, by MaxScore over blocks of nodes.

    ``words``: the nodes' words, where they are at hand. Null and empty texts have no words, repeated words of a query count
    once, ties go to the smaller node id, queries without a hit have no rows.
    """
    packed, asked = weighted_terms(words if words is not None else node_words(nodes), asked_words(queries), k1, b)
    return top_by_words(materialize(packed, "bm25-nodes"), materialize(asked, "bm25-queries"), k)


def grep_channel(queries: DataFrame, nodes: DataFrame, k: int = 10, words: DataFrame | None = None, counted: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """How many of a query's first five words of three letters or more a node contains.

    Containment is of whole words of the node, so it joins on the word instead of scanning each text for each query. ``counted``: the
    ``counted_terms`` of all words of the queries, where they are at hand.
    """
    first = F.slice(F.filter(F.split(F.lower("text"), TOKEN), lambda w: F.length(w) >= 3), 1, 5)
    # written, so that the nodes' words aren't shuffled to meet a few that are asked
    asked = materialize(queries.select("query_id", F.explode(F.array_distinct(first)).alias("token")), "grep-asked")
    if counted is not None:
        asked = asked.join(counted[0], "token").select("query_id", "id")
        hit = counted[1].select("node_id", "id").join(asked, "id")
        return _top(hit.groupBy("query_id", "node_id").agg(F.count("*").cast("double").alias("score")), k)
    terms = asked_terms(words if words is not None else node_words(nodes), asked)
    hit = terms.join(asked, "token").groupBy("query_id", "node_id").agg(F.count("*").cast("double").alias("score"))
    return _top(hit, k)


def text_channel(queries: DataFrame, nodes: DataFrame, k: int = 10, words: DataFrame | None = None, least: float = 0.1, counted: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """.7 x BM25 over its best + .3 x trigram similarity of the whole content, for lexical matches and for contents of similarity above ``least``.

    Exact: bounds tell within a block of nodes which can be among the k best, and only these are measured.
    """
    packed, asked = weighted_terms(words if words is not None else node_words(nodes), asked_words(queries), counted=counted)
    packed, asked = materialize(packed, "text-words"), materialize(asked, "text-asked")
    # a content is much work for its bytes, so it is cut in many tasks
    cores = 2 * nodes.sparkSession.sparkContext.defaultParallelism
    texts = materialize(node_grams(nodes.select("node_id", "content").repartition(cores)), "text-grams")
    return top_by_text(packed, asked, texts, queries.select("query_id", trigram_codes("text").alias("grams")), k, least)


def temporal_channel(queries: DataFrame, versions: DataFrame, k: int = 10, half_days: float = 7.0) -> DataFrame:
    """Nodes that began within a query's range, by recency at its end: memory halves every ``half_days``, other layers count 1. Joined on the months that a range covers."""
    month = lambda c: F.trunc(F.col(c).cast("date"), "month")
    q = queries.withColumn("month", F.explode(F.sequence(month("start"), month("end"), F.make_ym_interval(F.lit(0), F.lit(1)))))
    hit = versions.withColumn("month", month("valid_from")).join(q, "month").where(F.col("valid_from").between(F.col("start"), F.col("end")))
    age = F.timestamp_diff("SECOND", F.col("valid_from"), F.col("end")) / 86400
    score = F.when(F.col("layer") == "memory", exprs.half_life(age, half_days)).otherwise(1.0)
    return _top(hit.select("query_id", "node_id", F.round(score, 6).alias("score")), k)


def fuse(channels: dict[str, DataFrame], top: int = 20) -> DataFrame:
    """Reciprocal rank fusion of channels ``query_id, node_id, rank``, each written: k rows a query, however it was found."""
    every = None
    for name, df in channels.items():
        one = materialize(df.select("query_id", F.lit(name).alias("channel"), "node_id", "rank"), f"channel-{name}")
        every = one if every is None else every.unionByName(one)
    return rrf_fuse(every, top=top)


def hybrid_topk(queries: DataFrame, nodes: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, node_id, score, rank, fallback``: dense and sparse hits fused, each fetched to twice the depth.

    ``queries``: ``query_id, text, embedding``. A query whose words no node has falls back to its dense hits, marked so; one
    without a vector has its sparse hits alone; one with neither has no rows. A null text has no words.
    """
    asked = queries.where("embedding is not null").select(F.col("query_id").alias("node_id"), "embedding")
    dense = nearest(asked, vectors, 2 * k).select("query_id", "node_id", "rank")
    sparse = materialize(bm25(queries.select("query_id", "text"), nodes, 2 * k).select("query_id", "node_id", "rank"), "hybrid-sparse")
    lexical = sparse.select("query_id").distinct().withColumn("fallback", F.lit(False))
    fused = fuse({"dense": dense, "sparse": sparse}, top=k).select("query_id", "node_id", "score", "rank")
    return fused.join(lexical, "query_id", "left").withColumn("fallback", F.coalesce("fallback", F.lit(True)))


def rerank_blend(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """score x (.5 + .5 r / max r) where a rescoring exists."""
    j = hits.join(scores, ["query_id", "node_id"], "left")
    best = F.max("rescore").over(Window.partitionBy("query_id"))
    return j.withColumn("score", F.round(F.when(F.col("rescore").isNull() | (best <= 0), F.col("score")).otherwise(F.col("score") * (0.5 + 0.5 * F.col("rescore") / best)), 9))


def epistemic_boost(score: Column, ended: Column, corroboration: Column) -> Column:
    """x .3 for what has ended, x (1 + .05 min(corroboration, 5))."""
    return score * F.when(ended, 0.3).otherwise(1.0) * (1 + 0.05 * F.least(corroboration, F.lit(5)))


def layer_scoring(score: Column, layer: Column, age_days: Column, corroboration: Column, stale: Column) -> Column:
    memory = score * 0.7 + exprs.freshness(age_days, 90.0) * 0.3
    knowledge = score * (1 + 0.2 * F.log10(1 + corroboration))
    return F.when(layer == "memory", memory).when(layer == "knowledge", knowledge).when((layer == "wisdom") & stale, score * 0.5).otherwise(score)


def epistemic_fusion(score: Column, layer: Column, confidence: Column, unresolved: Column) -> Column:
    """Knowledge and wisdom x (.7 + .3 confidence); unresolved x .5."""
    trusted = F.when(layer.isin("knowledge", "wisdom"), score * (0.7 + 0.3 * exprs.effective_confidence(confidence))).otherwise(score)
    return trusted * F.when(unresolved, 0.5).otherwise(1.0)


def freshness_heat_rescore(score: Column, age_days: Column, heat: Column) -> Column:
    return score * (0.7 + 0.3 * exprs.freshness(age_days, 30.0)) * (0.9 + 0.1 * F.coalesce(heat, F.lit(0.5)))


def recall(queries: DataFrame, nodes: DataFrame, vectors: DataFrame, edges: DataFrame, k: int = 10, seeds: int = 5, rounds: int = 10, rerank: int = 50, overrides: dict[str, float] | None = None) -> DataFrame:
    """Five channels, fused, reranked, weighed by what is known of each node, without dominated hits and cut, for a whole table of queries at once.

    ``queries``: ``query_id, text, embedding, start, end`` (of the time asked about, or null); ``nodes``: ``node_id, content, state, layer,
    confidence, age_hours, valid_from, valid_to, n_sources, stale``, live and dead; ``vectors``: ``node_id, embedding``; ``edges``: ``src, dst,
    edge_type, weight``, of which those that don't contradict are walked from each query's first dense hits.

    Of the 2k best fused hits the first ``rerank`` are blended with the cosine of query and node (T8), the first 2k of these boosted by
    corroboration and cut where they have ended (T9), scored by layer, age and staleness (T10), by confidence and open contradictions (T11);
    then what a better hit contradicts goes (J13, J14), then what lies below its layer's cut (P10). ``quality`` says how good the query's hits are (A16).
    """
    live = materialize(nodes.where("state = 'ACTIVE'"), "recall-live")
    asked = queries.select(F.col("query_id").alias("node_id"), "embedding")
    near = materialize(vectors.select("node_id", "embedding").join(live.select("node_id"), "node_id", "left_semi"), "recall-vectors")
    dense = materialize(nearest(asked, near, 2 * k).select("query_id", "node_id", "rank"), "recall-dense")
    start = dense.where(F.col("rank") <= seeds).select("query_id", F.col("node_id").alias("id"), F.lit(1.0).alias("weight"))
    text = queries.select("query_id", "text")
    words = node_words(live)
    counted = counted_terms(words, asked_words(text))
    times = queries.where("start is not null").select("query_id", "start", "end")
    channels = {
        "dense": dense, "text": text_channel(text, live, 2 * k, words, counted=counted), "grep": grep_channel(text, live, 2 * k, words, counted),
        "graph": ppr_channel(edges.where("edge_type <> 'CONTRADICTS'"), start, 2 * k, rounds=rounds),
        "temporal": temporal_channel(times, live.where("valid_from is not null").select("node_id", "layer", "valid_from"), 2 * k),
    }
    fused = materialize(fuse(channels, top=max(2 * k, rerank)).join(live.select("node_id"), "node_id", "left_semi"), "recall-fused")
    pairs = fused.join(near, "node_id").join(queries.select("query_id", F.col("embedding").alias("asked")), "query_id")
    blended = _top(rerank_blend(fused.select("query_id", "node_id", "score"), pairs.select("query_id", "node_id", F.round(exprs.cosine("asked", "embedding"), 6).alias("rescore"))).select("query_id", "node_id", "score"), 2 * k)
    open_ = contradicting(edges).join(live.select(F.col("node_id").alias("b")), "b", "left_semi").select(F.col("a").alias("node_id"), F.lit(True).alias("unresolved")).distinct()
    j = blended.join(live.select("node_id", "layer", "confidence", "age_hours", "n_sources", "stale", "valid_to"), "node_id").join(open_, "node_id", "left").join(queries.select("query_id", "end"), "query_id")
    ended = F.coalesce(F.col("valid_to") <= F.col("end"), F.lit(False))
    score = epistemic_boost(F.col("score"), ended, F.coalesce("n_sources", F.lit(0)))
    score = layer_scoring(score, F.col("layer"), F.col("age_hours") / 24, F.coalesce("n_sources", F.lit(0)), F.coalesce("stale", F.lit(False)))
    score = F.round(epistemic_fusion(score, F.col("layer"), F.col("confidence"), F.coalesce("unresolved", F.lit(False))), 6)
    ranked = materialize(_top(j.select("query_id", "node_id", "layer", score.alias("score")), 2 * k), "recall-ranked")
    kept = drop_dominated(ranked, edges).drop("rank")
    final = _top(layer_threshold(kept, overrides).select("query_id", "node_id", "score"), k)
    quality = retrieval_quality(final.withColumn("fallback", F.lit(False))).select("query_id", "quality")
    return final.join(quality, "query_id")


def ranking_eval(results: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """Per query whether the expected node is among the first k and its rank, whether the ``lower`` node stays below it, and whether the ``absent`` one is not among them."""
    at = lambda c: results.select("query_id", F.col("node_id").alias(c), F.col("rank").alias(f"{c}_rank"))
    j = expected.join(at("expected_id"), ["query_id", "expected_id"], "left").join(at("lower_id"), ["query_id", "lower_id"], "left").join(at("absent_id"), ["query_id", "absent_id"], "left")
    above = F.col("expected_id_rank").isNotNull() & (F.col("lower_id_rank").isNull() | (F.col("expected_id_rank") < F.col("lower_id_rank")))
    return j.select(
        "query_id", F.coalesce(F.col("expected_id_rank") <= k, F.lit(False)).alias("found"), F.coalesce("expected_id_rank", F.lit(0)).alias("at"), above.alias("above"),
        F.coalesce(F.col("absent_id_rank") > k, F.lit(True)).alias("absent"),
    )


def contradicting(edges: DataFrame) -> DataFrame:
    """``a, b`` for each contradiction, both ways."""
    c = edges.where("edge_type = 'CONTRADICTS'").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return c.union(c.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def drop_dominated(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """Hits (``query_id, node_id, rank, ...``) without those that a better surviving hit of their query contradicts."""
    key = F.xxhash64("query_id", "node_id")
    h = hits.select("query_id", "node_id", "rank", key.alias("key"))
    x = h.select("query_id", F.col("node_id").alias("a"), F.col("key").alias("ka"))
    y = h.select("query_id", F.col("node_id").alias("b"), F.col("key").alias("kb"))
    pairs = contradicting(edges).join(x, "a").join(y, ["query_id", "b"]).select(F.col("ka").alias("a"), F.col("kb").alias("b"))
    gone = dominated(pairs, h.select(F.col("key").alias("node_id"), F.col("rank").alias("place"))).select(F.col("node_id").alias("key"))
    return hits.withColumn("key", key).join(gone, "key", "left_anti").drop("key")
