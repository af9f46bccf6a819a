"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes are cut into segments, each with a table from segment value to codes. A search grows one
segment's radius at a time, probes that table at the new radius and verifies what it finds. If
segment s has been searched up to radius r_s, every code within sum(r_s + 1) - 1 bits of the
query has been found, for a farther one would exceed r_s somewhere only if it exceeded it
everywhere; the search stops when the k-th verified distance is within that bound.

Codes and queries are cut into blocks by hash, and every pair of blocks is a task: it indexes its
codes once and searches all its queries one after the other. Neither side ever has to fit a task or
the driver. Blocks are as large as a task's memory allows (8 MB of codes, 2 MB of queries), so that
each code travels once for 262144 queries and each query once for a million codes.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.scratch import materialize

BITS = 64


def sign_code(vector: str) -> Column:
    """One bit for each of up to 64 components, set where it is positive (null, NaN: not), as a long; null of null. More components are an error."""
    bit = f"shiftleft(cast(coalesce({vector}[i] > 0 and not isnan({vector}[i]), false) as bigint), i)"
    return F.expr(f"case when {vector} is null then null when size({vector}) > {BITS} then cast(raise_error('a code has 64 bits: more components than that') as bigint) else aggregate(sequence(0, {BITS - 1}), 0L, (a, i) -> a | if(i < size({vector}), {bit}, 0L)) end")


@lru_cache(maxsize=64)
def flips(width: int, radius: int) -> np.ndarray:
    """All values of ``width`` bits with ``radius`` bits set."""
    return np.array([sum(1 << b for b in pick) for pick in combinations(range(width), radius)], np.int64)


class MultiIndex:
    """The tables of one block of distinct codes."""

    def __init__(self, codes: np.ndarray, segments: int) -> None:
        self.codes = codes
        cuts = [round(BITS * i / segments) for i in range(segments + 1)]
        self.parts = [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.tables = []
        for part in self.parts:
            value = self.segment(codes, part)
            order = np.argsort(value, kind="stable")
            self.tables.append((order, np.searchsorted(value[order], np.arange((1 << part[1]) + 1))))

    @staticmethod
    def segment(codes: np.ndarray, part: tuple[int, int]) -> np.ndarray:
        return ((codes >> np.uint64(part[0])) & np.uint64((1 << part[1]) - 1)).astype(np.int64)

    def search(self, query: np.uint64, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The distances and places of the k nearest codes and of all at the k-th distance."""
        n = len(self.codes)
        own = [int(self.segment(np.array([query]), p)[0]) for p in self.parts]
        seen = np.zeros(n, bool)
        per = np.zeros(BITS + 1, np.int64)  # verified codes by distance
        near, dist = [], []
        covered = -1
        for radius in range(max(w for _, w in self.parts) + 1):
            for (order, first), (_, width), value in zip(self.tables, self.parts, own, strict=True):
                if radius <= width:
                    probe = value ^ flips(width, radius)
                    a, size = first[probe], first[probe + 1] - first[probe]
                    size_all = int(size.sum())
                    if size_all:
                        at = order[np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size_all)]
                        at = at[~seen[at]]
                        seen[at] = True
                        d = np.bitwise_count(self.codes[at] ^ query)
                        per += np.bincount(d, minlength=BITS + 1)
                        near.append(at)
                        dist.append(d)
                covered += 1
                reach = int(np.searchsorted(np.cumsum(per), min(k, n)))
                if reach <= covered:
                    at, d = np.concatenate(near), np.concatenate(dist)
                    keep = d <= reach
                    return d[keep].astype(np.int32), at[keep]
        raise AssertionError("all radii cover all codes")


def _search_blocks(k: int, segments: int):
    def run(key: tuple, codes: pa.Table, queries: pa.Table) -> pa.Table:
        out_q, out_c, out_d = [], [], []
        if codes.num_rows and queries.num_rows:
            index = MultiIndex(codes["code"].to_numpy().view(np.uint64), segments)
            for q in queries["code"].to_numpy():
                d, at = index.search(np.int64(q).view(np.uint64), k)
                # of a code only its k smallest ids count, so k codes are enough but for ties in distance
                out_q.append(np.full(len(at), q))
                out_c.append(index.codes[at].view(np.int64))
                out_d.append(d)
        cat = lambda parts, t: pa.array(np.concatenate(parts) if parts else np.zeros(0, t), type=pa.from_numpy_dtype(t))
        return pa.table({"q": cat(out_q, np.int64), "code": cat(out_c, np.int64), "distance": cat(out_d, np.int32)})

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, segments: int = 4, code_block: int = 1 << 20, query_block: int = 1 << 18) -> DataFrame:
    """``query_id, rank, id, distance``: for each query the k rows nearest in Hamming distance, by id among equals.

    ``rows``: ``id long, code long``; ``queries``: ``query_id long, code long``. A query that is a
    row finds itself. Rows or queries without a code are left out; ids that are null come last
    among equals; equal rows are separate results; queries that repeat give their results again.
    Fewer than k rows give all of them, empty tables none. A code held by any number of rows is
    searched once and keeps its k first ids, found before the shuffle by code.
    """
    ids = Window.partitionBy("code").orderBy(F.col("id").asc_nulls_last())
    held = rows.where("code is not null").select("code", "id").withColumn("r", F.row_number().over(ids)).where(F.col("r") <= k)
    held = materialize(held.select("code", "id"), "mih-rows")
    codes = materialize(held.select("code").distinct(), "mih-codes")
    asked = materialize(queries.where("code is not null").select("code").distinct(), "mih-queries")
    cut = lambda n, size: max(1, -(-n // size))
    n_codes, n_asked = codes.count(), asked.count()
    cb = cut(n_codes, code_block)
    # few queries are cut finer, to give every core something to do
    qb = max(cut(n_asked, query_block), min(cut(n_asked, 256), cut(2 * rows.sparkSession.sparkContext.defaultParallelism, cb)))
    block = lambda n: F.pmod(F.xxhash64("code"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = codes.select("code", block(cb).alias("c"), every(qb).alias("q")).groupBy("c", "q")
    right = asked.select("code", block(qb).alias("q"), every(cb).alias("c")).groupBy("c", "q")
    found = left.cogroup(right).applyInArrow(_search_blocks(k, segments), "q long, code long, distance int")
    best = Window.partitionBy("q").orderBy("distance", F.col("id").asc_nulls_last())
    ranked = found.join(held, "code").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    ranked = ranked.select(F.col("q").alias("code"), "rank", "id", "distance")
    return queries.select("query_id", "code").join(ranked, "code").select("query_id", "rank", "id", "distance")


def op7_hamming_topk(embeddings: DataFrame) -> DataFrame:
    """For each row whose id is divisible by 20 the 10 rows with the nearest sign codes; odd rows: see ``nearest``."""
    coded = materialize(embeddings.select(F.col("vec_id").alias("id"), sign_code("embedding").alias("code")), "mih-signs")
    queries = coded.where("id % 20 = 0").select(F.col("id").alias("query_id"), "code")
    return nearest(coded, queries).select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


OP7_SQL = """
WITH c AS (
  SELECT vec_id, list_aggregate(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), 'string_agg', '') AS code
  FROM embeddings),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(hamming(q.code, c.code) AS INT) AS distance
  FROM c AS q CROSS JOIN c WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p)
WHERE rank <= 10
"""
