"""Set operations over markers, tags and memberships."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def markers_by_silo(contradictions: DataFrame, stale: DataFrame) -> DataFrame:
    """Both kinds of marker in one table."""
    return contradictions.withColumn("kind", F.lit("contradiction")).unionByName(stale.withColumn("kind", F.lit("stale_commitment")))


def markers_about(markers: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct markers that touch any of the ids."""
    each = markers.select("marker_id", F.explode("about_ids").alias("id"))
    return each.join(ids.select("id").distinct(), "id", "left_semi").select("marker_id").distinct()


def stale_tags(vocabulary: DataFrame, recent: DataFrame) -> DataFrame:
    """Tags of the vocabulary that no recently touched node has."""
    return vocabulary.select("tag").distinct().join(recent.select("tag").distinct(), "tag", "left_anti")


def shared(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    return a.select(on).intersect(b.select(on))
