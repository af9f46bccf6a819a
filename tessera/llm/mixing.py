"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations alone.

Each source has a weight schedule over training time, piecewise constant over equal phases.
Its integral is the source's weight, so its share of all words (with a cap on how often a source
may repeat), and the running integral is its cumulative token demand D(t). The source's documents,
in a hashed order and repeated pass by pass, cover the word positions 0 .. D(1); a copy whose middle
lies at c is trained on at the time t with D(t) = c, found by inverting D within its phase. The
mix is then range-sorted by t.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD
from tessera.scratch import materialize

#: The weight of a source in each of four equal phases of training; sources in code point order take the rows in turn.
#: The first source fades out, the second stays, the third fades in. Their integrals are 1, 2 and 3.
SCHEDULES = ((1.5, 1.25, 0.75, 0.5), (2.0, 2.0, 2.0, 2.0), (1.5, 2.25, 3.75, 4.5))
#: How often a source may be repeated.
MAX_PASSES = 3


def integrals(schedule: tuple[float, ...]) -> tuple[float, ...]:
    """The schedule's integral from 0 to the start of each phase, and to 1."""
    return tuple(sum(schedule[:k]) / len(schedule) for k in range(len(schedule) + 1))


#: The same as factors on the source's weight, the integral.
PHASES = tuple(tuple(w / integrals(row)[-1] for w in row) for row in SCHEDULES)


def _pick(values: tuple, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(at, F.lit(len(values))) + 1).cast("int"))


def source_targets(sized: DataFrame, schedules: tuple[tuple[float, ...], ...] = SCHEDULES, passes: int = MAX_PASSES) -> DataFrame:
    """``source``, ``rank``, ``source_size`` and ``target`` from rows ``(source, size)``.

    Targets are in proportion to the schedules' integrals and sum to all sizes; one that would exceed
    ``passes`` times its source's size stops there, and the rest share the excess by weight until
    none is above. With the sources in order of size / weight, those that stop are a prefix, so
    one running sum decides it. The windows run over one row a source, a table the size of the
    weight configuration.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1)
    ranked = ranked.withColumns({"weight": _pick(tuple(integrals(x)[-1] for x in schedules), F.col("rank")), "cap": F.col("source_size") * passes})
    tight = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, after = tight.rowsBetween(Window.unboundedPreceding, -1), tight.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    filled = ranked.withColumns(
        {
            "left_over": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "open_weight": F.sum("weight").over(after),
        }
    )
    stops = filled.withColumn("stops", F.col("cap") * F.col("open_weight") < F.col("weight") * F.col("left_over"))
    # the first source that doesn't stop has the level of all that don't
    level = F.min(F.when(~F.col("stops"), F.struct(F.col("cap") / F.col("weight"), "rank", "left_over", "open_weight"))).over(everything)
    told = stops.withColumn("level", level)
    share = (F.col("weight") * F.col("level.left_over")).cast("double") / F.col("level.open_weight")
    return told.select("source", "rank", "source_size", F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def _size() -> Column:
    return F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``source`` and the number of words of each row (null text: 0)."""
    return docs.select("doc_id", "source", _size().alias("size"))


def placed(sized: DataFrame, rows_per_bucket: int = 2000) -> DataFrame:
    """Rows ``doc_id, source, size`` (and more, to tell rows apart) plus ``start``, the words of its source before it in the hashed order, and the source's target.

    A source may hold any share of the rows: its order is cut into hash buckets of about
    ``rows_per_bucket`` rows, whose sums are small; a running sum over buckets plus one within
    the bucket gives the start. Equal rows follow each other and are one row until then, so an id (or none) that any number of rows share is no large bucket;
    which of them comes first changes no result.
    """
    groups = materialize(sized.groupBy(*sized.columns).agg(F.count("*").alias("times")), "mix-groups")
    targets = source_targets(groups.select("source", (F.col("size") * F.col("times")).alias("size")))
    n = groups.count()
    bits = min(32, max(0, (max(1, n // rows_per_bucket) - 1).bit_length()))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    bucket = F.shiftright(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), 32 - bits)
    keyed = groups.withColumns({"order": key, "bucket": bucket, "words": F.col("size") * F.col("times")})
    sums = keyed.groupBy("source", "bucket").agg(F.sum("words").alias("words"))
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(run), F.lit(0)).alias("offset"))
    offsets = offsets.join(targets.withColumnRenamed("source", "s2"), F.col("s").eqNullSafe(F.col("s2"))).drop("s2")
    within = Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "size", *sorted(set(sized.columns) - {"doc_id", "source", "size"})).rowsBetween(Window.unboundedPreceding, -1)
    local = keyed.withColumn("before", F.coalesce(F.sum("words").over(within), F.lit(0)))
    joined = local.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    each = joined.withColumn("time", F.explode(F.sequence(F.lit(0), F.col("times").cast("int") - 1)))
    start = F.col("before") + F.col("offset") + F.col("time") * F.col("size")
    return each.withColumn("start", start).drop("s", "b", "bucket", "order", "before", "offset", "words", "time", "times")


def copies(rows: DataFrame, passes: int = MAX_PASSES) -> DataFrame:
    """Adds ``copies``: in how many passes over the source the document's middle lies before the target."""
    middle = F.col("start") + F.col("size") / 2
    taken = [((middle + F.col("source_size") * p) < F.col("target")).cast("int") for p in range(passes)]
    return rows.withColumn("copies", F.when(F.col("size") > 0, sum(taken[1:], taken[0])).otherwise(0))


def demand_time(c: Column, target: Column, rank: Column, schedules: tuple[tuple[float, ...], ...] = SCHEDULES) -> Column:
    """The time in [0, 1] at which a source's cumulative demand reaches ``c`` of its ``target`` words."""
    n = len(schedules[0])
    done = [integrals(row) for row in schedules]
    share = c * _pick(tuple(d[-1] for d in done), rank) / target
    time = None
    for k in reversed(range(n)):
        low, rate = _pick(tuple(d[k] for d in done), rank), _pick(tuple(row[k] for row in schedules), rank)
        here = F.lit(k / n) + (share - low) / rate
        time = here if time is None else F.when(share < _pick(tuple(d[k + 1] for d in done), rank), here).otherwise(time)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), time))


def _position(at: Column) -> Column:
    """The training position of a document's copy in pass ``at`` over its source."""
    middle = F.col("start") + F.col("size") / 2 + F.col("source_size") * at
    return demand_time(middle, F.col("target"), F.col("rank"))


def _each_pass(rows: DataFrame) -> DataFrame:
    """A row for each copy, with its ``pass`` and training ``position``."""
    each = rows.where("copies > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return each.withColumn("position", _position(F.col("pass")))


def mixed_positions(docs: DataFrame) -> DataFrame:
    """One row a copy that the mix takes: ``doc_id, source, size, start, pass, position``, not sorted.

    A document with no words is never taken. Null ids order and join like any other value;
    null sources are one source. Rows equal in id, source and size follow each other and each
    gives its copies; copies at equal positions are ties in any order. An empty table gives none.
    """
    return _each_pass(copies(placed(sizes(docs)))).select("doc_id", "source", "size", "start", "pass", "position")


def mix(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, a row for each copy, range-sorted by training position.

    Columns are those of ``docs``, whatever their names. Rows equal in id, source and text are
    taken together, at one position a pass; other rows of one id follow each other.
    """
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct(F.col("doc_id").alias("id"), F.col("source").alias("source"), text.alias("hash")).alias("own"))
    sized = docs.select("doc_id", "source", text.alias("hash"), _size().alias("size")).groupBy("doc_id", "source", "hash", "size").agg(F.count("*").alias("times"))
    rows = placed(sized.select("doc_id", "source", "hash", (F.col("size") * F.col("times")).alias("size")))
    taken = _each_pass(copies(rows)).select(F.struct(F.col("doc_id").alias("id"), "source", "hash").alias("key"), "position")
    match = F.col("own.id").eqNullSafe(F.col("key.id")) & F.col("own.source").eqNullSafe(F.col("key.source")) & (F.col("own.hash") == F.col("key.hash"))
    return keyed.join(taken, match).orderBy("position", "own").select(*[F.col(f"row.`{c}`") for c in docs.columns])


def op3_source_mix(docs: DataFrame) -> DataFrame:
    """A row a document with the words taken of it and the training positions of its first and last copy, range-sorted by the first.

    Those not taken come last, without positions. ``op3_mix_positions`` has a row a copy. Nulls,
    ties, repeated rows and empty tables: see ``mixed_positions``; other columns are not read.
    """
    rows = copies(placed(sizes(docs)))
    at = lambda p: F.when(F.col("copies") > 0, F.round(_position(p), 9))
    told = rows.withColumns({"first_position": at(F.lit(0)), "last_position": at(F.col("copies") - 1), "taken": (F.col("size") * F.col("copies")).cast("long")})
    # doc_id spreads what isn't taken over the ranges
    return told.orderBy(F.col("first_position").asc_nulls_last(), "doc_id").select("doc_id", "size", "source_size", "target", "taken", "first_position", "last_position")


def op3_mix_positions(docs: DataFrame) -> DataFrame:
    """One row a copy that the mix takes, range-sorted by its training position; see ``mixed_positions``."""
    return mixed_positions(docs).orderBy("position", "doc_id", "pass")


OP3_SQL = r"""
WITH s AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM per),
plans AS (SELECT * FROM (VALUES (0, [1.5, 1.25, 0.75, 0.5]::DOUBLE[]), (1, [2.0, 2.0, 2.0, 2.0]::DOUBLE[]), (2, [1.5, 2.25, 3.75, 4.5]::DOUBLE[])) AS v(place, w)),
c AS (SELECT r.*, w, list_sum(w) / 4 AS weight, 3 * source_size AS cap FROM r JOIN plans ON place = rank % 3),
f AS (
  SELECT *,
    CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS left_over,
    sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM c),
t AS (SELECT *, cap * open_weight < weight * left_over AS stops FROM f),
v AS (SELECT left_over AS lo, open_weight AS ow FROM t WHERE NOT stops ORDER BY cap / weight, rank LIMIT 1),
g AS (
  SELECT source, source_size, w, weight, CASE WHEN stops THEN CAST(cap AS DOUBLE) ELSE CAST(weight * lo AS DOUBLE) / ow END AS target
  FROM t LEFT JOIN v ON true),
p AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s),
k AS (
  SELECT doc_id, size, source_size, target, w, weight, CAST(start AS DOUBLE) + size / 2 AS middle,
    CAST(start + size / 2 < target AS INT) + CAST(start + size / 2 + source_size < target AS INT) + CAST(start + size / 2 + 2 * source_size < target AS INT) AS n
  FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source),
d AS (SELECT *, CASE WHEN size > 0 THEN n ELSE 0 END AS copies FROM k),
e AS (SELECT *, middle * weight / target AS s1, (middle + source_size * (copies - 1)) * weight / target AS s2 FROM d),
z AS (
  SELECT *, [0.0, w[1] / 4, (w[1] + w[2]) / 4, (w[1] + w[2] + w[3]) / 4, weight]::DOUBLE[] AS done FROM e)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken,
  CASE WHEN copies > 0 THEN round(least(1.0, greatest(0.0, CASE WHEN s1 < done[2] THEN s1 / w[1] WHEN s1 < done[3] THEN 0.25 + (s1 - done[2]) / w[2]
    WHEN s1 < done[4] THEN 0.5 + (s1 - done[3]) / w[3] ELSE 0.75 + (s1 - done[4]) / w[4] END)), 9) END AS first_position,
  CASE WHEN copies > 0 THEN round(least(1.0, greatest(0.0, CASE WHEN s2 < done[2] THEN s2 / w[1] WHEN s2 < done[3] THEN 0.25 + (s2 - done[2]) / w[2]
    WHEN s2 < done[4] THEN 0.5 + (s2 - done[3]) / w[3] ELSE 0.75 + (s2 - done[4]) / w[4] END)), 9) END AS last_position
FROM z
"""
