"""From texts to claims: what is extracted from, what becomes of a claim, and the class of a free entity type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import schema
from tessera.operators.similarity import nearest
from tessera.scratch import materialize

#: Our own vocabulary of entity types; the classes in order of precedence.
TYPE_WORDS = {
    "Agent": "person people human author artist engineer researcher scientist customer employee user manager doctor teacher politician player speaker".split(),
    "Organization": "organization organisation company corporation university school bank agency ministry government team department supplier vendor startup institute".split(),
    "Artifact": "artifact document paper book report product device machine software library tool part material dataset file service vehicle building".split(),
    "Concept": "concept idea theory method algorithm topic field language principle law metric skill quality technology strategy belief".split(),
    "Event": "event meeting conference election war release incident launch accident festival match order purchase shipment deadline milestone".split(),
    "Location": "location place city country region nation state river mountain street address continent island village district market".split(),
}


def type_vocabulary(spark: SparkSession, words: dict[str, list[str]] = TYPE_WORDS) -> DataFrame:
    """``word, type_class, place``: the vocabulary in order of precedence."""
    rows = [(w, c) for c, ws in words.items() for w in ws]
    return spark.createDataFrame([(w, c, i) for i, (w, c) in enumerate(rows)], "word string, type_class string, place int")


#: Types that a task compares with the vocabulary at a time.
TYPE_ROWS = 1 << 15


def trigrams(text: Column) -> Column:
    """The trigrams of a text between two ``#``, repeats included; null for an empty one."""
    padded = F.concat(F.lit("#"), text, F.lit("#"))
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(padded, i, F.lit(3))))


def squared_length(grams: Column) -> Column:
    """The sum of the squares of how often each trigram stands in an array: the i-th of equal ones adds 2 i - 1."""
    start = F.struct(F.lit("").alias("gram"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("total"))

    def add(s: Column, g: Column) -> Column:
        run = F.when(g == s["gram"], s["run"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(g.alias("gram"), run.alias("run"), (s["total"] + 2 * run - 1).alias("total"))

    return F.aggregate(F.sort_array(grams), start, add, lambda s: s["total"])


def type_classes(types: DataFrame, column: str, vocabulary: DataFrame, least: float = 0.15) -> DataFrame:
    """``column, type_class`` for each distinct entity type: that of the vocabulary's word that it is, else of its first token that is
    a word, else of the word with the highest cosine of trigram counts, if that is ``least`` or more; of equal ones the first word.

    Null, and what is like no word, has the class null. Types meet words only in a common trigram; Spark decides whether the vocabulary is
    broadcast. The distinct types are written once and dealt by their number, so that a task holds about ``TYPE_ROWS`` of them and their words.
    """
    t = materialize(types.select(F.col(column).alias("of_type")).distinct(), "types")
    dealt = t.repartition(max(1, -(-t.count() // TYPE_ROWS)), "of_type")
    norm = F.lower(F.trim("of_type"))
    v = vocabulary.groupBy("word").agg(F.min_by("type_class", "place").alias("type_class"), F.min("place").alias("place"))
    v = materialize(v.withColumn("theirs", squared_length(trigrams(F.col("word")))), "type-words")
    tokens = F.filter(F.concat(F.array(norm), F.split(norm, r"[^a-z0-9]+")), lambda w: w != "")
    known = dealt.select("of_type", F.posexplode(tokens).alias("at", "word")).join(v, "word").groupBy("of_type").agg(F.min_by("type_class", "at").alias("known"))
    grams = dealt.select("of_type", trigrams(norm).alias("grams")).withColumn("mine", squared_length(F.col("grams")))
    mine = grams.select("of_type", "mine", F.explode_outer("grams").alias("gram"))  # not outer, Spark would make the trigrams once more to find empty arrays
    dot = mine.join(v.select("word", F.explode(trigrams(F.col("word"))).alias("gram")), "gram").groupBy("of_type", "mine", "word").agg(F.count("*").alias("dot"))
    score = F.round(F.col("dot") / (F.sqrt("mine") * F.sqrt("theirs")), 9)
    like = dot.join(v, "word").where(score >= least).groupBy("of_type").agg(F.max_by("type_class", F.struct(score, -F.col("place"))).alias("alike"))
    return dealt.join(known, "of_type", "left").join(like, "of_type", "left").select(F.col("of_type").alias(column), F.coalesce("known", "alike").alias("type_class"))


def extraction_sources(nodes: DataFrame, version: str, least_chars: int = 200, least_heat: float = 0.0) -> DataFrame:
    """``node_id`` of nodes to extract from: long enough, or hot enough where a heat is set, and not yet extracted in this version.

    ``nodes``: ``node_id, content, heat_score, extracted_version``. A null content is empty, a null heat 0.
    """
    long_enough = F.length(F.coalesce("content", F.lit(""))) >= least_chars
    hot = F.lit(least_heat > 0) & (F.coalesce("heat_score", F.lit(0.0)) >= least_heat)
    return nodes.where((long_enough | hot) & ~F.col("extracted_version").eqNullSafe(F.lit(version))).select("node_id").distinct()


def dedup_or_corroborate(new: DataFrame, existing: DataFrame, sources: DataFrame, least: float = 0.95, most: int = 10) -> DataFrame:
    """What becomes of each claim extracted from a source node: an edge to the existing claim nearest it, if near enough, else a claim of its own.

    ``new``: ``node_id, source_id, place, raw_confidence, embedding``; ``existing``: ``node_id, embedding``; ``sources``: ``node_id``. Of each
    source the first ``most`` by (place, id) count. A claim has the raw confidence (null: .5) times the weights of its source's tier and of its extractor; an
    edge has independence .3. Gives ``node_id, source_id, target, outcome, confidence, independence``; equal rows of ``new`` are one claim.
    """
    w = Window.partitionBy("source_id").orderBy("place", "node_id")
    asked = new.dropDuplicates(["node_id", "source_id"]).join(sources.select(F.col("node_id").alias("source_id")).distinct(), "source_id", "left_semi")
    kept = asked.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)
    near = nearest(kept.select("node_id", "embedding").dropDuplicates(["node_id"]), existing.select("node_id", "embedding"), 1, least)
    j = kept.join(near.select(F.col("query_id").alias("node_id"), F.col("node_id").alias("target")), "node_id", "left")
    is_edge = F.col("target").isNotNull()
    scaled = schema.TIER_WEIGHT["community"] * schema.METHOD_WEIGHT["standard_extractor"] * F.coalesce("raw_confidence", F.lit(0.5))
    return j.select(
        "node_id", "source_id", "target", F.when(is_edge, "CORROBORATES").otherwise("claim").alias("outcome"), F.when(~is_edge, scaled).alias("confidence"), F.when(is_edge, 0.3).alias("independence")
    )


def belief_hints(facts: DataFrame, synthesized: DataFrame, hits: DataFrame, facts_least: int = 3, evidence_least: int = 3, shown: int = 5) -> DataFrame:
    """Hints that retrieved facts could form a belief: the groups of (silo, subject, predicate) with enough free facts and evidence that they belong to.

    ``facts``: ``claim_id, silo_id, subject, predicate, evidence``; ``hits``: ``claim_id`` retrieved. A silo with fewer than ``facts_least`` retrieved
    facts gets none. Gives ``silo_id, subject, predicate, n_facts, message, node_ids`` (the first ``shown`` by id); a null part of a key is in no group.
    """
    key = ["silo_id", "subject", "predicate"]
    got = facts.join(hits.select("claim_id").distinct(), "claim_id", "left_semi")
    enough = got.groupBy("silo_id").agg(F.count("*").alias("n")).where(F.col("n") >= facts_least).select("silo_id")
    asked = got.join(enough, "silo_id", "left_semi").select(*key).distinct()
    free = facts.join(synthesized.select("claim_id"), "claim_id", "left_anti").join(asked, key, "left_semi")
    g = free.groupBy(*key).agg(F.count("*").alias("n_facts"), F.count_distinct("evidence").alias("n_evidence")).where((F.col("n_facts") >= facts_least) & (F.col("n_evidence") >= evidence_least))
    first = free.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("claim_id"))).where(F.col("nth") <= shown)
    ids = first.groupBy(*key).agg(F.sort_array(F.collect_list("claim_id")).alias("node_ids"))
    message = F.concat(F.col("n_facts"), F.lit(" corroborating facts about '"), F.col("predicate"), F.lit("'. Consider forming a belief."))
    return g.join(ids, key).select(*key, "n_facts", message.alias("message"), "node_ids")


def child_summaries(groups: DataFrame, about: DataFrame, findings: DataFrame) -> DataFrame:
    """``parent, child, finding, summary``: the visible findings about the groups that are part of a parent.

    ``groups``: ``child, parent``; ``about``: ``finding, child``; ``findings``: ``finding, summary, origin, published``. Visible: by extraction, or published.
    """
    seen = findings.where(F.coalesce(F.col("origin") == "extraction", F.lit(False)) | F.coalesce("published", F.lit(False)))
    return groups.select("child", "parent").distinct().join(about.select("finding", "child").distinct(), "child").join(seen.select("finding", "summary"), "finding").select("parent", "child", "finding", "summary")
