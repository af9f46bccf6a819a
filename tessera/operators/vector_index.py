"""A partitioned index of unit vectors whose cells rule blocks out exactly, for searches by cosine.

Vectors are dealt to the nearest of some centroids and, within such a cell, to rings by their angle to
it. By the triangle inequality of angles, a query at the angle t from a centroid is at an angle of at least
max(t - hi, lo - t) from every vector of a ring that lies between lo and hi; a block whose best possible
cosine is too low isn't visited. With a k, a first search of each query's own block gives what is too
low. Pairs of blocks meet as matrix products, so a pair of vectors is a row only if it is found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.scratch import materialize

#: What rounding a score to 6 places and computing angles in double precision may change.
SLACK = 2e-6


@dataclass(frozen=True)
class Params:
    """``block`` vectors and ``query_block`` queries at most meet in a task, or ``together`` blocks of vectors one after another. Centroids: one for each block of vectors, at most
    ``cells`` of them and ``numbers`` components in all (8 MB), fitted on ``sample`` vectors a cell, at most 8192 (smallest hashes of ids) in
    ``rounds`` rounds; they decide what is skipped, never what is found. ``rings`` of equal width cover the angles from 0 to pi."""

    block: int = 1 << 14
    query_block: int = 1 << 16
    together: int = 16
    cells: int = 1024
    numbers: int = 1 << 20
    sample: int = 32
    rounds: int = 6
    rings: int = 32


def unit_rows(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    """Vectors as rows of length 1 (zero ones stay zero); null and NaN components are 0."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(set(flat.value_lengths().to_pylist())) > 1:
        raise ValueError("vectors of unequal length can't be compared")
    m = flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) if n else np.zeros((0, 0))
    np.nan_to_num(m, copy=False)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=m, where=norm > 0)


def fit_centroids(rows: np.ndarray, cells: int, rounds: int) -> np.ndarray:
    """Spherical k-means from the first ``cells`` rows, numbered along the direction in which they differ most."""
    c = rows[:cells].copy()
    for _ in range(rounds):
        at = np.argmax(rows @ c.T, 1)
        total = np.zeros_like(c)
        np.add.at(total, at, rows)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.where(norm > 0, norm, 1), c)
    axis = np.linalg.svd(c - c.mean(0), full_matrices=False)[2][0]
    return c[np.argsort(c @ axis, kind="stable")]


def angles(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ centroids.T, -1, 1))


@dataclass(frozen=True)
class Ring:
    """Vectors of a cell between two angles, in ``parts`` blocks numbered from ``first``; the cell -1 holds zero vectors."""

    cell: int
    lo: float
    hi: float
    first: int
    parts: int


def pack_rings(counts: list[tuple[int, int, int, float, float]], block: int) -> tuple[list[Ring], list[tuple[int, int, int]]]:
    """Rings from ``cell, ring, rows, lo, hi`` in order, small neighbours in a cell joined; and for each (cell, ring) which one it went to."""
    rings: list[Ring] = []
    where: list[tuple[int, int, int]] = []
    open_rows = first = 0
    for cell, ring, n, lo, hi in sorted(counts):
        if rings and rings[-1].cell == cell and (open_rows + n <= block // 2 or open_rows < block // 8):
            last = rings.pop()
            lo, first, open_rows = min(last.lo, lo), last.first, open_rows + n
            hi = max(last.hi, hi)
        else:
            open_rows = n
        parts = max(1, -(-open_rows // block))
        rings.append(Ring(cell, lo, hi, first, parts))
        where.append((cell, ring, len(rings) - 1))
        first += parts
    return rings, where


def best_scores(theta: np.ndarray, zero: np.ndarray, rings: list[Ring]) -> np.ndarray:
    """The highest cosine that each query (its angles to the centroids) can have with a vector of each ring."""
    cell = np.array([r.cell for r in rings], int)
    lo, hi = np.array([r.lo for r in rings], float), np.array([r.hi for r in rings], float)
    t = theta[:, np.maximum(cell, 0)]
    out = np.cos(np.maximum(0, np.maximum(t - hi, lo - t)))
    out[:, cell < 0] = 0
    out[zero] = 0
    return out


def _hash(n: Column | int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(n) if isinstance(n, int) else n).cast("int")


class Index:
    """``vectors(id, embedding, tag)`` dealt to blocks; ``pairs`` has the pairs of blocks of the last search and those that it visited."""

    def __init__(self, vectors: DataFrame, p: Params = Params()) -> None:
        self.p, n = p, vectors.count()
        self.centroids = np.zeros((1, 0))
        cells = min(p.cells, -(-n // p.block))
        if cells > 1:
            rows = vectors.select("embedding").orderBy(F.xxhash64("id"), "id").limit(min(8192, cells * p.sample)).toArrow()
            m = unit_rows(rows["embedding"], rows.num_rows)
            m = m[np.any(m != 0, 1)]
            cells = min(cells, max(1, p.numbers // max(1, m.shape[1])), len(m))
            self.centroids = fit_centroids(m, cells, p.rounds) if cells > 1 else np.zeros((1, 0))
        self.pairs = (0, 0)
        if len(self.centroids) < 2:  # nothing to place
            self.n_blocks = max(1, -(-n // p.block))
            self.rings, self.dealt = [Ring(0, 0.0, 0.0, 0, self.n_blocks)], None
            self.blocks = vectors.select("id", "embedding", "tag", _hash(self.n_blocks).alias("j"))
            return
        placed = self.place(vectors, "index-placed")
        counts = placed.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi")).collect()  # cells * rings rows at most
        self.rings, where = pack_rings([tuple(r) for r in counts], p.block)
        spark = vectors.sparkSession
        table = [(c, g, r, self.rings[r].first, self.rings[r].parts) for c, g, r in where]
        self.dealt = spark.createDataFrame(table, "cell int, ring int, at int, first int, parts int")  # as many rows
        self.blocks = placed.join(F.broadcast(self.dealt), ["cell", "ring"]).select("id", "embedding", "tag", (F.col("first") + _hash(F.col("parts"))).alias("j"))
        self.n_blocks = sum(r.parts for r in self.rings)

    def place(self, df: DataFrame, tag: str) -> DataFrame:
        """``df`` with the cell, ring and angle of each vector."""
        c, rings = self.centroids, self.p.rings
        kinds = df.select("id", "embedding", "tag").schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                m = unit_rows(b.column("embedding"), b.num_rows)
                near = m @ c.T if b.num_rows else np.zeros((0, len(c)))
                cell = near.argmax(1) if b.num_rows else np.zeros(0, int)
                angle = np.arccos(np.clip(near[np.arange(len(m)), cell], -1, 1))
                zero = ~np.any(m != 0, 1)
                cell, angle = np.where(zero, -1, cell), np.where(zero, 0, angle)
                ring = np.minimum(rings - 1, (angle / np.pi * rings).astype(int))
                cols = [b.column(0), b.column(1), b.column(2), pa.array(cell.astype(np.int32)), pa.array(ring.astype(np.int32)), pa.array(angle)]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "embedding", "tag", "cell", "ring", "angle"])

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds)
        return materialize(df.select("id", "embedding", "tag").mapInArrow(run, f"{kinds}, cell int, ring int, angle double"), tag)

    def room(self, queries: DataFrame, n: int) -> int:
        """Queries in a block; few are cut finer, to give every core something to do."""
        return min(self.p.query_block, max(256, n * self.n_blocks // (2 * queries.sparkSession.sparkContext.defaultParallelism)))

    def cuts(self, queries: DataFrame) -> int:
        n = queries.count()
        return max(1, -(-n // self.room(queries, n)))

    def place_queries(self, queries: DataFrame) -> DataFrame:
        """Queries with a block ``i`` (of neighbouring cells) and the block ``home`` of vectors around them."""
        if self.dealt is None:
            return queries.select("id", "embedding", "tag", _hash(self.cuts(queries)).alias("i"), F.lit(0).alias("home"))
        q = self.place(queries, "index-queries")
        counts = {r.cell: r["n"] for r in q.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a cell
        room = self.room(queries, sum(counts.values()))
        table, i, used = [], 0, 0
        for cell in sorted(counts):
            parts = -(-counts[cell] // room)
            if used and used + counts[cell] > room:
                i, used = i + 1, 0
            table.append((cell, i, parts))
            i, used = (i + parts, 0) if parts > 1 else (i, used + counts[cell])
        cells = queries.sparkSession.createDataFrame(table, "cell int, i0 int, n_i int")
        home = self.dealt.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("ring", "first"))).alias("rings"))
        j = q.join(F.broadcast(cells), "cell").join(F.broadcast(home), "cell", "left")
        # the last ring that begins no further out, else the first one
        inner = F.filter("rings", lambda r: r["ring"] <= F.col("ring"))
        at = F.coalesce(F.when(F.size(inner) > 0, F.element_at(inner, -1)["first"]), F.get("rings", F.lit(0))["first"], F.lit(0))
        return j.select("id", "embedding", "tag", (F.col("i0") + _hash(F.col("n_i"))).alias("i"), at.alias("home"))

    def visits(self, queries: DataFrame) -> DataFrame:
        """Each query once for every block that may hold a vector of at least its ``least``, but for the block ``home``."""
        c, rings = self.centroids, self.rings
        first, parts = np.array([r.first for r in rings], int), np.array([r.parts for r in rings], int)
        kind, tag = (queries.schema[c].dataType.simpleString() for c in ("embedding", "tag"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    b = whole.slice(at, 256)
                    m = unit_rows(b.column("embedding"), b.num_rows)
                    zero = ~np.any(m != 0, 1)
                    theta = angles(m, c) if len(c) > 1 else np.zeros((len(m), 1))
                    ok = best_scores(theta, zero, rings) >= b.column("least").to_numpy()[:, None] - SLACK
                    row, ring = np.nonzero(ok)
                    row, ring = np.repeat(row, parts[ring]), np.repeat(ring, parts[ring])
                    ring_of = row * len(rings) + ring
                    j = first[ring] + np.arange(len(row)) - np.searchsorted(ring_of, ring_of)
                    new = j != b.column("home").to_numpy()[row]
                    picked = b.take(pa.array(row[new]))
                    yield pa.RecordBatch.from_arrays([*(picked.column(x) for x in ("id", "embedding", "tag", "i")), pa.array(j[new].astype(np.int32))], names=["id", "embedding", "tag", "i", "j"])

        return queries.select("id", "embedding", "tag", "i", "least", "home").mapInArrow(run, f"id long, embedding {kind}, tag {tag}, i int, j int")

    def meet(self, visits: DataFrame, work: Callable, schema: str) -> DataFrame:
        """``work(key, queries, vectors)`` for each pair of blocks that a query visits; a block of vectors travels to those alone."""
        asked = materialize(visits, "index-visits")
        pairs = materialize(asked.select("i", "j").distinct(), "index-pairs")
        n = pairs.count()
        self.pairs = (self.pairs[0] + n, self.n_pairs)
        right = self.blocks.join(pairs, "j").groupBy("i", "j")
        return asked.groupBy("i", "j").cogroup(right).applyInArrow(work, schema)

    def met(self, queries: DataFrame, least: float) -> DataFrame:
        """``i, js``: the blocks that may hold a vector of at least ``least`` to a query of each block."""
        c, rings = self.centroids, self.rings
        first, parts = np.array([r.first for r in rings], int), np.array([r.parts for r in rings], int)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    b = whole.slice(at, 256)
                    m = unit_rows(b.column("embedding"), b.num_rows)
                    theta = angles(m, c) if len(c) > 1 else np.zeros((len(m), 1))
                    row, ring = np.nonzero(best_scores(theta, ~np.any(m != 0, 1), rings) >= least - SLACK)
                    i, ring = np.unique(np.stack([b.column("i").to_numpy()[row], ring]), axis=1)
                    j = np.concatenate([first[r] + np.arange(parts[r]) for r in ring] or [np.zeros(0, int)])
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(i, parts[ring]).astype(np.int32)), pa.array(j.astype(np.int32))], names=["i", "j"])

        return queries.select("embedding", "i").mapInArrow(run, "i int, j int").groupBy("i").agg(F.collect_set("j").alias("js"))

    def sweep(self, queries: DataFrame, work: Callable, schema: str, least: float) -> DataFrame:
        """As ``search`` without a k, but nothing is written for a pair of blocks: each is packed in a row, and a task reads a block of queries and
        ``together`` blocks of vectors, so that what it finds for a query can be added up before a shuffle."""
        if self.n_blocks < 2:
            return self.search(queries, work, schema, least, None)

        def pack(of: str) -> Callable:
            def run(key: tuple, t: pa.Table) -> pa.Table:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, t.schema) as w:
                    w.write_table(t)
                return pa.table({of: pa.array([key[0].as_py()], pa.int32()), f"{of}_rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

            return run

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = lambda b, c, r: pa.ipc.open_stream(b.column(c)[r].as_buffer()).read_all()
            at, asked = None, None
            for b in batches:
                for r in range(b.num_rows):
                    i = b.column("i")[r].as_py()
                    at, asked = (at, asked) if i == at else (i, rows(b, "i_rows", r))
                    yield from work((i,), asked, rows(b, "j_rows", r)).to_batches()

        q = materialize(self.place_queries(queries), "index-asked")
        met = materialize(self.met(q, least), "index-met")
        self.pairs = (met.agg(F.sum(F.size("js"))).first()[0] or 0, met.count() * self.n_blocks)
        kept = lambda df, of: materialize(df.select("id", "embedding", "tag", of).groupBy(of).applyInArrow(pack(of), f"{of} int, {of}_rows binary"), "index-packed")
        left = kept(q, "i").join(F.broadcast(met), "i").repartition(max(1, met.count()), "i")
        right = kept(self.blocks, "j").repartition(-(-self.n_blocks // self.p.together), "j")
        pairs = left.crossJoin(right).where(F.array_contains("js", F.col("j")))
        return pairs.select("i", "i_rows", "j_rows").mapInArrow(run, schema)

    def search(self, queries: DataFrame, work: Callable, schema: str, least: float, k: int | None) -> DataFrame:
        """What ``work`` gives for all pairs of blocks that count. With a k, ``work`` gives ``query_id, score`` and at most k rows a query, and the union has its k best."""
        if self.n_blocks < 2:  # it goes to each block of queries
            n = self.cuts(queries)
            left = queries.select("id", "embedding", "tag", _hash(n).alias("i")).groupBy("i")
            right = self.blocks.select("id", "embedding", "tag", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).groupBy("i")
            return left.cogroup(right).applyInArrow(work, schema)
        q = materialize(self.place_queries(queries), "index-asked")
        self.n_pairs = q.select("i").distinct().count() * self.n_blocks
        self.pairs = (0, self.n_pairs)
        if k is None:
            return self.meet(self.visits(q.withColumns({"least": F.lit(float(least)), "home": F.lit(-1)})), work, schema)
        seen = materialize(self.meet(q.select("id", "embedding", "tag", "i", F.col("home").alias("j")), work, schema), "index-seen")
        w = Window.partitionBy("query_id").orderBy(F.desc("score"))
        kth = seen.select("query_id", "score", F.row_number().over(w).alias("n")).where(F.col("n") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
        rest = q.join(kth, "id", "left").withColumn("least", F.greatest(F.coalesce("kth", F.lit(float(least))), F.lit(float(least))))
        return seen.union(self.meet(self.visits(rest), work, schema))
