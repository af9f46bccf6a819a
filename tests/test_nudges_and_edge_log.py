"""Nudges on a stream against the batch, and the log of edge accesses read across restarts."""

import random

from pyspark.sql import functions as F

from tessera.sources import edge_accesses as E
from tessera.streaming import nudges as N

TURN = "session long, event_id long, ts string, stored boolean, wants array<string>, ignored array<string>"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def at(minute):
    return f"2024-01-{1 + minute // 1440:02d} {minute // 60 % 24:02d}:{minute % 60:02d}:00"


def test_rules_of_nudges(spark):
    m, o = ["pending_markers"], list(N.KINDS)
    rows = [(1, i, at(i), False, m, None) for i in range(5)]  # every third turn
    rows += [(2, 10 + i, at(i), i == 2, None, None) for i in range(8)]  # a gap of more than 3 turns after the write
    rows += [(3, 20, at(0), False, o, None), (3, 21, at(1), False, ["open_reasoning"], None)]  # the three most urgent; the others rest too
    rows += [(4, 30 + 3 * i, at(3 * i), None, m, m if i else None) for i in range(5)]  # three times ignored
    rows += [(5, 50, at(0), False, m, m * 2), (5, 51, at(239), False, m, None), (5, 52, at(479), False, m, None)]  # 239 and 240 minutes later
    rows += [(None, 60, at(0), False, m, None), (6, None, at(0), False, m, None), (6, 61, None, False, m, None), (7, 70, at(0), False, [], [])]
    got = rows_of(N.nudges(spark.createDataFrame(rows, TURN).withColumn("gap", F.lit("clash")), N.Rules(gap=3)).select("session", "event_id", "kind"))
    assert [r for r in got if r[0] == 1 and r[2] == m[0]] == [(1, 0, m[0]), (1, 3, m[0])]
    assert [r for r in got if r[0] == 2] == [(2, 16, "storage_gap")]
    assert [r[2] for r in got if r[0] == 3] == ["form_belief", "pending_markers", "stale_hypothesis"] and all(r[1] == 20 for r in got if r[0] == 3)
    assert [r[1] for r in got if r[0] == 4 and r[2] == m[0]] == [30]
    assert [r[1] for r in got if r[0] == 5] == [50, 52]
    assert not [r for r in got if r[0] in (6, 7, None)]
    assert N.nudges(spark.createDataFrame([], TURN)).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows, minute = [], 0
    for i in range(600):
        minute += rng.choice((0, 1, 2, 5))
        rows.append((rng.randrange(6), i, at(minute), rng.random() < 0.1, rng.sample(N.KINDS, rng.randint(0, 4)), rng.sample(N.KINDS, rng.random() < 0.1)))
        minute += 300 * (rng.random() < 0.02)
    turns = spark.createDataFrame(rows, TURN)
    for i in range(3):
        turns.where((F.col("event_id") >= 200 * i) & (F.col("event_id") < 200 * (i + 1))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        live = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = N.nudge_stream(live, N.Rules(gap=4), "2 hours").writeStream.format("memory").queryName("nudged").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(key, before)
    want = rows_of(N.nudges(turns, N.Rules(gap=4)))
    assert len(want) > 100 and rows_of(spark.table("nudged")) == want


def test_edge_log_restarts(spark, tmp_path):
    log, out, cursor = f"{tmp_path}/log", f"{tmp_path}/out", f"{tmp_path}/cursor"
    schema = "silo_id string, src long, dst long, edge_type string, context string, ts timestamp"
    stamp = F.lit("2024-01-01").cast("timestamp")

    def commit(n, rows):
        E.append_commit(spark.createDataFrame([(s, a, b, "CITES", "recall", None) for s, a, b in rows], schema).withColumn("ts", stamp), log, n)

    def read(silos=None, to=(out, cursor)):
        live = E.edge_access_source(spark, log, silos)
        live.writeStream.format("parquet").option("path", to[0]).option("checkpointLocation", to[1]).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.silo_id, r.src, r.dst) for r in spark.read.schema(live.schema).parquet(to[0]).collect())

    commit(0, [("a", 1, 2), ("b", 3, 4), (None, 9, 9)])
    assert read() == [("a", 1, 2), ("b", 3, 4)]
    assert read() == [("a", 1, 2), ("b", 3, 4)]
    commit(1, [("a", 2, 1)])
    commit(2, [("c", 5, 6), ("c", 5, 6)])  # a new tenant, and an access that repeats
    (tmp_path / "log" / "commit=000000000003").mkdir()  # unfinished
    assert read() == [("a", 1, 2), ("a", 2, 1), ("b", 3, 4), ("c", 5, 6), ("c", 5, 6)]
    assert read(["c"], (f"{tmp_path}/c", f"{tmp_path}/ccp")) == [("c", 5, 6), ("c", 5, 6)]
    ids = {r.edge_id for r in spark.read.schema(E.SCHEMA).parquet(out).where("silo_id = 'a'").collect()}
    assert len(ids) == 1  # both ways are one edge


def test_edge_offsets():
    r = E.EdgeAccessReader("/nowhere/at/all", None)
    assert r.latestOffset() == {} and r.partitions({}, {}) == []


