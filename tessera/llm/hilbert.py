"""Approximate nearest neighbours by shifted space-filling curves.

Each of several curves projects the vectors on a few random directions, shifts the projections and orders all vectors
by their place on a Hilbert curve through that space. The orders are range-partitioned sorts; a vector's rank on a
curve is its place in one. Vectors that are near stand near on some curve: a query is compared with those within a
window of ranks around its own on every curve, exactly, and what the curves find is merged and reranked.

How wide a window must be depends on the vectors (on 64 independent components it is some hundredths of all, on
clustered ones far less), so it is measured: for a bounded sample of queries the true neighbours are found among all
rows, and the window is the one that holds ``recall`` of them.

Equal vectors are one until the end, so copies, however many, take one rank and no room in windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.scratch import materialize

_U = np.uint64


def hilbert_key(x: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points (rows) with coordinates of ``bits`` bits; coordinates x bits < 64."""
    x = x.T.astype(_U)
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        q, low = _U(1 << bit), _U((1 << bit) - 1)
        for i in range(n):
            inside = (x[i] & q) != 0
            swap = np.where(inside, _U(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(inside, low, swap)
            x[i] ^= swap
    x = np.bitwise_xor.accumulate(x, axis=0)
    flip = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] & _U(1 << bit)) != 0, _U((1 << bit) - 1), _U(0))
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << _U(1)) | ((x[i] >> _U(bit)) & _U(1))
    return key.astype(np.int64)


def matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """Vectors as rows of doubles, shorter ones with zeros behind."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, cuts = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy()
    length = np.diff(cuts)
    if len(length) and (length == size).all():
        return flat.reshape(-1, size)
    out = np.zeros((len(length), size))
    out[np.repeat(np.arange(len(length)), length), np.arange(len(flat)) - np.repeat(cuts[:-1] - cuts[0], length)] = flat
    return out


def directions(size: int, curves: int, dims: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For each curve orthogonal directions, and shifts in cells of the grid."""
    rng = np.random.default_rng(seed)
    axes = [np.linalg.qr(rng.normal(size=(size, min(dims, size))))[0] for _ in range(curves)]
    return np.stack(axes), rng.random((curves, min(dims, size)))


def usable(vector: str) -> Column:
    """Finite, whole and not all zeros."""
    v = F.col(vector)
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)


def _keys(axes: np.ndarray, shift: np.ndarray, middle: np.ndarray, spread: np.ndarray, bits: int, reach: float = 4.0):
    """Rows ``curve, key, rep`` for each vector and curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), axes.shape[1])
            for c in range(len(axes)):
                z = (x @ axes[c] - middle[c]) / spread[c]
                cell = np.clip((z + reach + shift[c]) / (2 * reach + 1), 0, np.nextafter(1, 0)) * (1 << bits)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(hilbert_key(cell.astype(np.int64), bits)), batch.column("rep")], names=["curve", "key", "rep"])

    return run


def _moments(axes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, 0.0, 0.0
        for batch in batches:
            p = np.einsum("nd,cdk->nck", matrix(batch.column("v"), axes.shape[1]), axes)
            n, one, two = n + len(p), one + p.sum(0), two + (p * p).sum(0)
        if n:
            m = axes.shape[0] * axes.shape[2]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(m)), pa.array(np.full(m, n)), pa.array(one.ravel()), pa.array(two.ravel())], names=["i", "n", "one", "two"])

    return run


def closest(q: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query places, ids, distances) of each query's k nearest rows: chosen by products, with room for their rounding, then measured exactly."""
    at, found, dist = [], [], []
    norm, own = (rows * rows).sum(1), (q * q).sum(1)
    k = min(k, len(rows))
    for i in range(0, len(q), max(1, (1 << 22) // len(rows))):
        part = slice(i, i + max(1, (1 << 22) // len(rows)))
        near = norm + own[part, None] - 2 * (q[part] @ rows.T)
        bound = np.partition(near, k - 1, axis=1)[:, k - 1] + 1e-10 * (norm.max() + own[part])
        a, b = np.nonzero(near <= bound[:, None])
        d = np.sqrt(((q[part][a] - rows[b]) ** 2).sum(1))
        order = np.lexsort((ids[b], d, a))
        a, b, d = a[order], b[order], d[order]
        first = np.searchsorted(a, a)
        keep = np.arange(len(a)) - first < k
        at.append(a[keep] + i)
        found.append(ids[b[keep]])
        dist.append(d[keep])
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in (at, found, dist))


def _true_neighbours(sample: np.ndarray, ids: np.ndarray, k: int):
    """Each batch's k nearest of every sampled query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, reps = matrix(batch.column("v"), sample.shape[1]), batch.column("rep").to_numpy()
            for i in range(0, len(rows), 65536):
                a, b, d = closest(sample, rows[i : i + 65536], reps[i : i + 65536], k, sample.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(ids[a.astype(np.int64)]), pa.array(b.astype(np.int64)), pa.array(d)], names=["query", "rep", "d"])

    return run


def _search(k: int, size: int):
    def run(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["query", "rep", "score"]
        if not rows.num_rows or not queries.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        ids = queries["query"].to_numpy()
        a, b, d = closest(matrix(queries["point"], size), matrix(rows["v"], size), rows["rep"].to_numpy(), k, size)
        return pa.table([pa.array(ids[a.astype(np.int64)]), pa.array(b.astype(np.int64)), pa.array(d)], names=names)

    return run


def _classes(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors (``rep, v``; rep the smallest id) and the first k + 1 ids of each (``rep, id, place``)."""
    w = Window.partitionBy("h", "v").orderBy("id")
    first = rows.withColumn("h", F.xxhash64("v")).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k + 1)
    first = materialize(first.withColumn("rep", F.min("id").over(Window.partitionBy("h", "v"))).select("rep", "id", "place", F.when(F.col("place") == 1, F.col("v")).alias("v")), "hilbert-classes")
    return first.where("place = 1").select("rep", "v"), first.select("rep", "id", "place")


def ranked_curves(vectors: DataFrame, curves: int, dims: int, bits: int, seed: int, size: int) -> DataFrame:
    """``curve, rep, rank``: every vector's place (from 0) on each curve."""
    axes, shift = directions(size, curves, dims, seed)
    m = vectors.mapInArrow(_moments(axes), "i long, n long, one double, two double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("one").alias("one"), F.sum("two").alias("two")).toPandas().sort_values("i")
    n = m["n"].to_numpy()
    middle = m["one"].to_numpy() / n
    spread = np.sqrt(np.maximum(m["two"].to_numpy() / n - middle**2, 1e-24))
    shape = (axes.shape[0], axes.shape[2])
    keys = vectors.mapInArrow(_keys(axes, shift, middle.reshape(shape), spread.reshape(shape), bits), "curve int, key long, rep long")
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # an id that counts up within its partition; the partitions' sizes say where each begins
    ordered = keys.repartitionByRange(partitions, "curve", "key", "rep").sortWithinPartitions("curve", "key", "rep")
    ordered = materialize(ordered.select("curve", "rep", F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("part")), "hilbert-order")
    each = ordered.groupBy("curve", "part").agg(F.count("*").alias("n"), F.min("at").alias("low"))
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("curve", "part", "low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return materialize(ordered.join(each, ["curve", "part"]).select("curve", "rep", (F.col("start") + F.col("at") - F.col("low")).alias("rank")), "hilbert-ranks")


def measured_window(vectors: DataFrame, ranks: DataFrame, sample: pd.DataFrame, k: int, recall: float, size: int) -> int:
    """The half width of windows that hold ``recall`` of the sampled queries' k true neighbours, found among all rows."""
    ids = sample["rep"].to_numpy(np.int64)
    points = matrix(pa.array(sample["v"].tolist(), pa.list_(pa.float64())), size)
    found = vectors.mapInArrow(_true_neighbours(points, ids, k + 1), "query long, rep long, d double").where("query <> rep")
    near = found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("d", "rep"))).where(F.col("r") <= k).select("query", "rep")
    own = ranks.select("curve", F.col("rep").alias("query"), F.col("rank").alias("mine"))
    gaps = near.join(ranks, "rep").join(own, ["curve", "query"]).groupBy("query", "rep").agg(F.min(F.abs(F.col("rank") - F.col("mine"))).alias("gap")).select("gap").toPandas()["gap"].to_numpy()
    return int(np.quantile(gaps, recall, method="higher")) + 1 if len(gaps) else 1


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, curves: int = 16, dims: int = 6, bits: int = 10, recall: float = 0.96, sample: int = 256, most_rows: int = 1 << 14, seed: int = 42) -> DataFrame:
    """``query_id, rank, id, score``: for each query of ``queries(query_id)``, ids of rows, its k nearest found among ``rows(id, v)``.

    ``score`` is the Euclidean distance of the whole vectors in double precision; of equal ones the smaller id is first.
    Rows without an id, and null, zero, or non-finite vectors or such with null components take no part. Vectors of
    different lengths are compared as if zeros stood behind the shorter. An id that several rows hold is one row a
    vector: equal repeated rows count once, a query leaves out all rows of its id and asks for each of its vectors.
    Fewer than k candidates give all of them; empty tables none. Further columns are ignored.

    ``sample`` bounds the queries whose true neighbours decide the windows. ``most_rows`` of a curve are a task.
    """
    spark = rows.sparkSession
    held = rows.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable("v"))
    held = held.select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v")).distinct()
    vectors, members = _classes(held, k)
    asked = materialize(members_of(held, queries, vectors), "hilbert-queries")  # query_id, rep
    n, size = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    empty = spark.createDataFrame([], "query_id long, rank int, id long, score double")
    if not n:
        return empty
    ranks = ranked_curves(vectors, curves, dims, bits, seed, size)
    tried = asked.select("rep").distinct().orderBy(F.xxhash64("rep"), "rep").limit(sample).join(vectors, "rep").toPandas()
    if not len(tried):
        return empty
    window = measured_window(vectors, ranks, tried, k, recall, size)
    block = min(max(window, 1024), most_rows)
    placed = ranks.withColumn("block", F.expr(f"rank div {block}"))
    left = placed.join(vectors, "rep").select("curve", "block", "rep", "v").groupBy("curve", "block")
    points = vectors.select(F.col("rep").alias("query"), F.col("v").alias("point"))
    reach = F.sequence(F.expr(f"greatest(rank - {window}, 0) div {block}"), F.expr(f"least(rank + {window}, {n - 1}) div {block}"))
    wanted = asked.select("rep").distinct()
    right = ranks.join(wanted, "rep").select(F.col("curve").alias("line"), F.explode(reach).alias("part"), F.col("rep").alias("query")).join(points, "query").select("line", "part", "query", "point")
    found = left.cogroup(right.groupBy("line", "part")).applyInArrow(_search(k + 1, size), "query long, rep long, score double")
    best = Window.partitionBy("query").orderBy("score", "rep")
    found = found.groupBy("query", "rep").agg(F.min("score").alias("score")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    found = materialize(found.select("query", "rep", "score"), "hilbert-found")
    each = asked.join(found.withColumnRenamed("rep", "other"), asked["rep"] == F.col("query")).select("query_id", "other", "score").join(members.withColumnRenamed("rep", "other"), "other").where("id <> query_id")
    # a query that holds several vectors: the nearest of them counts
    each = each.groupBy("query_id", "id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def members_of(held: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """The distinct vectors that queries hold: ``query_id, rep``."""
    q = queries.select(F.col("query_id").cast("long").alias("query_id")).where("query_id is not null").distinct()
    mine = held.join(q, held["id"] == q["query_id"], "left_semi").select(F.col("id").alias("query_id"), "v", F.xxhash64("v").alias("h"))
    return mine.join(vectors.select("rep", "v", F.xxhash64("v").alias("h")), ["h", "v"]).select("query_id", "rep")


def op11_hilbert_neighbours(embeddings: DataFrame) -> DataFrame:
    """For each row whose id is divisible by 100 the 10 nearest found, by Euclidean distance; odd rows: see ``nearest``."""
    rows = embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    queries = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"))
    return nearest(rows, queries).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
