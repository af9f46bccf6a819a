"""Parts of the extraction and ingest rules on rows made for them: nulls, ties, repeated rows, empty tables, clashing names."""

from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.operators import chains as C
from tessera.operators import extraction as E
from tessera.operators import joins as J


def test_type_classes(spark):
    v = E.type_vocabulary(spark)
    types = [("Person",), ("software city",), (" BANK ",), ("citizen-country",), ("universities",), ("zzqx",), ("",), (None,), ("Person",)]
    got = {r.t: r.type_class for r in E.type_classes(spark.createDataFrame(types, "t string").withColumn("word", F.lit("clash")), "t", v).collect()}
    assert got == {"Person": "Agent", "software city": "Artifact", " BANK ": "Organization", "citizen-country": "Location", "universities": "Organization", "zzqx": None, "": None, None: None}
    tie = spark.createDataFrame([("abcd", "second", 1), ("abce", "first", 0)], "word string, type_class string, place int")
    assert [r.type_class for r in E.type_classes(spark.createDataFrame([("abc",)], "t string"), "t", tie).collect()] == ["first"]
    assert E.type_classes(spark.createDataFrame([], "t string"), "t", v).count() == 0


def test_sources_and_outcomes(spark):
    n = spark.createDataFrame(
        [(1, "x" * 200, None, None), (2, "x" * 199, 0.4, None), (3, "", 0.6, None), (4, "x" * 300, 0.9, "v2"), (5, "x" * 300, 0.9, "v1"), (6, None, None, None)],
        "node_id long, content string, heat_score double, extracted_version string",
    )
    ids = lambda **k: sorted(r.node_id for r in E.extraction_sources(n, "v2", **k).collect())
    assert ids() == [1, 5] and ids(least_heat=0.5) == [1, 3, 5]
    new = [(10 + i, 1, i, None if i == 3 else 1.0, [1.0, 0.0] if i < 2 else [-1.0, 1.0]) for i in range(12)] + [(40, 4, 0, 1.0, [1.0, 0.0])]
    new = spark.createDataFrame([*new, new[0]], "node_id long, source_id long, place int, raw_confidence double, embedding array<double>")
    old = spark.createDataFrame([(100, [1.0, 0.1]), (101, [0.0, -1.0])], "node_id long, embedding array<double>")
    got = {r.node_id: r for r in E.dedup_or_corroborate(new, old, E.extraction_sources(n, "v2")).collect()}
    assert sorted(got) == list(range(10, 20))  # ten of the source that is eligible
    assert got[10].target == 100 and got[10].outcome == "CORROBORATES" and got[10].confidence is None and got[10].independence == 0.3
    assert got[12].outcome == "claim" and abs(got[12].confidence - 0.45) < 1e-12 and abs(got[13].confidence - 0.225) < 1e-12
    assert E.dedup_or_corroborate(new.limit(0), old, n).count() == 0


def test_aliases_by_compatible_form(spark):
    m = spark.createDataFrame([(1, "ＡＣＭＥ"), (2, "straße"), (3, "ﬁle"), (4, None), (5, "other")], "m long, surface string")
    a = spark.createDataFrame([("acme", 7), ("ACME", 6), ("STRASSE", 8), ("File", 9), (None, 1)], "alias string, entity_id long")
    assert {r.m: r.entity_id for r in J.resolve_alias(m, a).collect()} == {1: 6, 2: 8, 3: 9, 4: None, 5: None}


def test_hard_queries(spark):
    hard = ["my bike colour", "Was it all approved", "denied!", "which one", "a true or false thing", "x?", "How, then"]
    easy = ["the bike colour", "it was approved by the whole of the board", "myth busters", "", None, "  "]
    df = spark.createDataFrame([(t, t in hard) for t in hard + easy], "t string, want boolean")
    assert [r.t for r in df.withColumn("got", F.coalesce(X.is_hard_query("t"), F.lit(False))).where("got <> want").collect()] == []


def test_ingest_resolves_references(spark):
    s = "claim_id long, silo_id int, subject long, predicate string, object string, evidence string, created_at timestamp"
    day = lambda df: df.withColumn("created_at", F.expr("timestampadd(DAY, cast(claim_id as int), timestamp '2024-01-01')"))
    old = day(spark.createDataFrame([(1, 0, 1, "p", "a", "d1", None)], s))
    new = day(spark.createDataFrame(
        [
            (2, 0, 1, "p", "b", "d2", None, 0, None, None, None),  # the one before it has another object
            (3, 0, 1, "p", "b", "d3", None, 1, None, None, None),  # the same object
            (4, 0, 1, "p", "c", "d2", None, 2, 99, None, None),  # names a claim
            (5, 0, 2, "p", "c", "d4", None, 3, None, 1, "d2"),  # a position before a document
            (6, 0, 2, "p", "c", "d5", None, 4, None, 9, "d2"),  # that position isn't there: last of the document
            (7, 0, 2, "p", "c", "d6", None, 5, None, 5, "d6"),  # itself is not earlier
            (8, 0, 2, "p", "c", "d1", None, 6, None, None, None),  # known
            (9, 0, 2, "p", "c", None, None, 7, None, 6, "d1"),  # that claim was not created
        ],
        s + ", position long, supersedes long, supersedes_at long, supersedes_document string",
    ))
    got = {r.claim_id: (r.status, r.supersedes) for r in C.ingest_claims(old, new).collect()}
    made = {2: 1, 3: None, 4: 99, 5: 3, 6: 4, 7: None, 9: None}
    assert got == {**{c: ("created", x) for c, x in made.items()}, 8: ("skipped", None)}
    assert {r.status for r in C.ingest_claims(old, new, "error").where("claim_id = 8").collect()} == {"failed"}
    assert C.ingest_claims(old.limit(0), new.limit(0)).count() == 0


def test_hints_and_summaries(spark):
    facts = spark.createDataFrame([(i, 0, 1, "p", i % 4) for i in range(8)] + [(20, 1, 1, "p", 1)], "claim_id long, silo_id int, subject long, predicate string, evidence long")
    none = spark.createDataFrame([], "claim_id long")
    hits = lambda *ids: spark.createDataFrame([(i,) for i in ids], "claim_id long")
    (r,) = E.belief_hints(facts, none, hits(0, 1, 2, 20)).collect()
    assert r.node_ids == [0, 1, 2, 3, 4] and r.message == "8 corroborating facts about 'p'. Consider forming a belief."
    assert E.belief_hints(facts, none, hits(0, 1)).count() == 0 and E.belief_hints(facts, hits(*range(6)), hits(0, 1, 2)).count() == 0
    groups = spark.createDataFrame([(1, 9), (1, 9), (2, 9)], "child long, parent long")
    about = spark.createDataFrame([(5, 1), (6, 1), (7, 2)], "finding long, child long")
    found = spark.createDataFrame([(5, "s", "extraction", None), (6, "t", None, None), (7, None, "other", True)], "finding long, summary string, origin string, published boolean")
    assert sorted(map(tuple, E.child_summaries(groups, about, found).collect())) == [(9, 1, 5, "s"), (9, 2, 7, None)]
