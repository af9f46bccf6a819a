"""A stream over micro-batches gives what one batch gives."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.sources.fixtures import Tables
from tessera.streaming import streams as ST


def arrivals(t, path, n=3):
    e = t.access_events.withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts").cache()
    total = e.count()
    numbered = e.select("*", F.ntile(n).over(Window.orderBy("ts", "entry_id")).alias("part"))
    for i in range(1, n + 1):
        numbered.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(path)
    return e, total


def test_heat_upsert_per_batch(spark, sf_dir, tmp_path):
    t = Tables(spark, sf_dir)
    e, _ = arrivals(t, f"{tmp_path}/in")
    stream = ST.access_source(spark, f"{tmp_path}/in", e.schema, 1)
    ST.run_available(stream, ST.heat_job(spark, f"{tmp_path}/heat", 0.0), f"{tmp_path}/cp").awaitTermination()
    got = {r.node_id: r.heat for r in spark.read.parquet(f"{tmp_path}/heat/v=3").collect()}
    want = {}
    for f in sorted((tmp_path / "in").glob("part-*.parquet")):
        for r in ST.heat_contributions(spark.read.parquet(str(f))).collect():
            want[r.node_id] = min(1.0, want.get(r.node_id, 0) + r.gain)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def collect_stream(spark, df, name, mode="complete"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_windows_and_sessions_equal_batch(spark, sf_dir, tmp_path):
    t = Tables(spark, sf_dir)
    e, _ = arrivals(t, f"{tmp_path}/in")
    events = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    events = events.withColumns({"silo_id": F.col("user_id") % 3, "metric": F.col("event_type"), "is_error": F.col("value") > 50, "times": F.when(F.col("event_id") % 4 == 0, 3)})
    events.coalesce(1).write.parquet(f"{tmp_path}/ev")
    live = ST.access_source(spark, f"{tmp_path}/ev", events.schema, 1)
    key = lambda df: sorted(map(tuple, df.select("bucket", "silo_id", "metric", "n", "n_errors", "total", "p50", "p95", "most").collect()))
    assert key(collect_stream(spark, ST.metric_buckets(live, "1 day"), "buckets")) == key(ST.metric_buckets(events, "1 day"))
    live = ST.access_source(spark, f"{tmp_path}/in", e.schema, 1)
    got = sorted(map(tuple, collect_stream(spark, ST.sessionize(live, "6 hours"), "sessions").select("node_id", "start", "n_events").collect()))
    assert got == sorted(map(tuple, ST.sessionize(e, "6 hours").select("node_id", "start", "n_events").collect()))


def test_dedup_within_watermark(spark, sf_dir, tmp_path):
    t = Tables(spark, sf_dir)
    e, total = arrivals(t, f"{tmp_path}/in")
    live = ST.access_source(spark, f"{tmp_path}/in", e.schema, 1)
    n = collect_stream(spark, ST.dedup_stream(live), "deduped", "append").count()
    assert e.select("node_id").distinct().count() <= n <= total


def test_stuck_stream_equals_batch(spark, tmp_path):
    """Three like queries of a user in a row are stuck; a write among them, an unlike text or a long gap is not."""
    from tessera.operators.chains import stuck_stream
    from tessera.operators.windows import stuck_sessions

    like, other = "how do I reset the ledger", "weather in the north"
    turns = {
        1: [(0, like, False), (10, like + "?", False), (20, like, False)],
        2: [(0, like, False), (10, like, True), (20, like, False)],
        3: [(0, like, False), (10, other, False), (20, like, False)],
        4: [(0, like, False), (10, like, False), (4000, like, False)],
        5: [(0, None, False), (10, like, False), (20, like, False), (30, like, False), (40, like, True), (50, like, False)],
        6: [(0, like, False), (10, like, False)],
    }
    rows = [(u, 100 * u + i, f"2024-01-01 {10 + s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}", text, wrote) for u, ts in turns.items() for i, (s, text, wrote) in enumerate(ts)]
    e = spark.createDataFrame(rows, "user_id long, event_id long, ts string, text string, is_write boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    e.coalesce(1).write.parquet(f"{tmp_path}/ev")
    live = ST.access_source(spark, f"{tmp_path}/ev", e.schema, 1)
    got = {tuple(r) for r in collect_stream(spark, stuck_stream(live, 300), "stuck", "append").collect()}
    assert got == {(1, 102), (5, 503)}
    assert got == {tuple(r) for r in stuck_sessions(e, 5).collect()}
