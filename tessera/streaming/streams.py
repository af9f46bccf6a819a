"""Signals from event streams. Each job is a batch function that a stream applies to its micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera import schema
from tessera.functions import exprs


def access_source(spark, path: str, table_schema, files_per_batch: int = 1000) -> DataFrame:
    """Events as they arrive in a folder; the query's checkpoint is the cursor."""
    return spark.readStream.schema(table_schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def heat_contributions(events: DataFrame, read: float = 1.0, other: float = 0.5) -> DataFrame:
    """Per node the heat that a batch of accesses adds."""
    w = F.when(F.col("access_type") == "read", read).otherwise(other)
    return events.groupBy("node_id").agg(exprs.heat_contribution(F.sum(w)).alias("gain"))


def merge_heat(prior: DataFrame, gain: DataFrame, days: float, cap: float = 1.0) -> DataFrame:
    """``node_id, heat, tier``: the prior decayed by its half-life plus the gain, capped."""
    both = prior.join(gain, "node_id", "full_outer")
    heat = F.least(F.lit(cap), F.coalesce("heat", F.lit(0.0)) * exprs.half_life(F.lit(days), schema.HALF_LIFE_DAYS) + F.coalesce("gain", F.lit(0.0)))
    return both.select("node_id", heat.alias("heat")).withColumn("tier", exprs.tier("heat"))


def edge_heat(events: DataFrame) -> DataFrame:
    """Per link (a user and a kind of access) the heat of its accesses, unit weight, no tier."""
    return events.groupBy("node_id", "access_type").agg(exprs.heat_contribution(F.count("*")).alias("heat"))


def first_in_window(events: DataFrame, seconds: int = 300) -> DataFrame:
    """At most one event a node and tumbling window: the first."""
    slot = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / seconds)
    return events.groupBy("node_id", slot.alias("slot")).agg(F.min("entry_id").alias("entry_id"))


def dedup_stream(events: DataFrame, seconds: int = 300, late: str = "10 minutes") -> DataFrame:
    """The same on a stream, with state bounded by a watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["node_id"])


def touch_counts(events: DataFrame, minutes: int = 30) -> DataFrame:
    """Touches of each event's node within the trailing window.

    Time is cut into buckets of the window's length, so that a window lies in its event's bucket and the one before; each bucket
    of a node is counted with the last one's events put before it. A hot node is as many tasks as it has buckets.
    """
    span = minutes * 60
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    e = events.select("entry_id", "node_id", at.alias("at")).withColumn("bucket", F.floor(F.col("at") / span))
    both = e.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("later")).withColumn("bucket", F.col("bucket") + F.col("later"))
    w = Window.partitionBy("node_id", "bucket").orderBy("at").rangeBetween(-span, 0)
    return both.withColumn("n_touches", F.count("*").over(w)).where("later = 0").select("entry_id", "n_touches")


def metric_buckets(metrics: DataFrame, width: str = "1 minute") -> DataFrame:
    """Per window, tenant and metric: count, errors, and the latencies' sum, median, 95th percentile (interpolated) and maximum. Batch and stream alike.

    ``metrics``: ``ts, silo_id, metric, value, is_error, times``: how often it happened (null: once). A null latency counts, but is none; a null flag is no error.
    """
    g = metrics.groupBy(F.window("ts", width).alias("w"), "silo_id", "metric")
    times = F.coalesce("times", F.lit(1))
    return g.agg(
        F.sum(times).alias("n"), F.sum(F.when(F.col("is_error"), times).otherwise(0)).alias("n_errors"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 6).alias("total"),
        F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"), F.max("value").alias("most"),
    ).select(F.col("w.start").alias("bucket"), "silo_id", "metric", "n", "n_errors", "total", "p50", "p95", "most")


def sessionize(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Per user the sessions that a gap ends: start, events and the last write."""
    src = events.withWatermark("ts", late) if late else events
    g = src.groupBy(F.session_window("ts", gap).alias("w"), "node_id")
    return g.agg(F.count("*").alias("n_events"), F.max(F.when(F.col("access_type") == "write", F.col("ts"))).alias("last_write")).select(
        "node_id", F.col("w.start").alias("start"), "n_events", "last_write"
    )


def reflection_budget(triggers: DataFrame, n: int = 10) -> DataFrame:
    """The first n triggers of each kind and hour."""
    hour = F.date_trunc("hour", F.col("ts"))
    w = Window.partitionBy("event_type", hour).orderBy("ts", "event_id")
    return triggers.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("event_id", "place")


def pending_trigger(events: DataFrame, key: str, least: int = 5) -> DataFrame:
    return events.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def engagement_heat(ticks: DataFrame) -> DataFrame:
    """Viewed .5, used 1, confirmed 2, uncapped."""
    w = exprs.lookup({"view": 0.5, "click": 1.0, "purchase": 2.0}, "event_type", 0.0)
    return ticks.groupBy("user_id").agg(F.sum(w).alias("heat"))


def incremental(facts: DataFrame, since: Column, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A detection job over what is newer than a mark."""
    return job(facts.where(F.col("created_at") > since))


def run_available(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Apply a function to all that has arrived since the checkpoint, in micro-batches."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def heat_job(spark, store: str, days: float) -> Callable[[DataFrame, int], None]:
    """Upsert of a batch's heat into a table of versions: each batch writes the next one, so a repeated batch is harmless."""

    def apply(batch: DataFrame, number: int) -> None:
        prior = spark.read.parquet(f"{store}/v={number}").select("node_id", "heat") if number else spark.createDataFrame([], "node_id long, heat double")
        merge_heat(prior, heat_contributions(batch), days).write.mode("overwrite").parquet(f"{store}/v={number + 1}")

    return apply
