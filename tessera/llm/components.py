"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.scratch import materialize


def component_labels(links: DataFrame, tag: str, rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` for each node of ``links(a, b)`` (longs): equal roots, one component.

    Each round every node moves to the least of its neighbours in a hashed order, and links
    between the places moved to remain. The expected number of nodes falls by a constant share
    a round, whatever the shape, and a star of any size falls in one. The rounds' small move
    tables are then resolved from the last to the first; no row reaches the driver.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    edges = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = materialize(edges, f"{tag}-links")
    moves: list[DataFrame] = []
    for _ in range(rounds):
        if edges.isEmpty():
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        own = rank("a")
        move = best.select(F.col("a").alias("node"), F.when(F.col("m") < own, F.col("m.v")).otherwise(F.col("a")).alias("to"))
        move = materialize(move, f"{tag}-moves")
        moves.append(move)
        at = edges.join(move.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").select("ta", "b")
        at = at.join(move.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b").where("ta <> tb")
        edges = at.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        edges = materialize(edges, f"{tag}-links")
    else:
        if not edges.isEmpty():
            raise RuntimeError("components did not settle")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    resolved = moves[-1].select("node", F.col("to").alias("root"))
    for move in reversed(moves[:-1]):
        up = resolved.select(F.col("node").alias("to"), "root")
        resolved = materialize(move.join(up, "to", "left").select("node", F.coalesce("root", "to").alias("root")), f"{tag}-roots")
    return resolved
