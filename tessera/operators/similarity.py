"""Exact nearest neighbours by cosine, over the blocks of a partitioned index.

A pair of blocks is a task that multiplies two matrices and keeps each query's k best, its distinct tags, or the best
pairs, so no other pair is ever a row and no side has to fit a task. Pairs of blocks that can't count are not visited.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.vector_index import Index, Params, unit_rows
from tessera.scratch import materialize


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return t["id"].to_numpy(), unit_rows(t["embedding"], t.num_rows), t["tag"].to_numpy()


#: Scores that a task holds at a time; what is found among them takes several times as much.
SCORES = 1 << 20
#: Scores whose highest is looked at first, and what rounding to 6 places may change.
STRETCH, ROUNDED = 64, 2e-6


def _scores(queries: pa.Table, vectors: pa.Table, other_tag: bool, chunk: int = 512, coarse: tuple | None = None):
    """Stretches of the queries: ids of both sides, tags of the vectors, and the rounded scores, or those of the ``coarse`` sides as they are; -2 for pairs that don't count."""
    if not queries.num_rows or not vectors.num_rows:
        return
    chunk = max(1, min(chunk, SCORES // vectors.num_rows))
    (qid, q, qt), (vid, v, vt) = coarse or (_matrix(queries), _matrix(vectors))
    order = np.argsort(vid, kind="stable")
    for at in range(0, len(qid), chunk):
        s = q[at : at + chunk] @ v.T
        if not coarse:
            np.round(s, 6, out=s)
        own = qid[at : at + chunk]
        a, b = np.searchsorted(vid, own, "left", sorter=order), np.searchsorted(vid, own, "right", sorter=order)
        for i in np.flatnonzero(b > a):
            s[i, order[a[i] : b[i]]] = -2
        if other_tag:
            s[qt[at : at + chunk, None] == vt[None]] = -2
        yield qid[at : at + chunk], vid, vt, s


def _cat(parts: list, kind: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _found(q: list, v: list, s: list) -> pa.Table:
    return pa.table({"query_id": _cat(q, np.int64), "node_id": _cat(v, np.int64), "score": _cat(s, float)})


def _best(k: int | None, least: float, other_tag: bool):
    def run(key: tuple, queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if not queries.num_rows or not vectors.num_rows:
            return _found(out_q, out_v, out_s)
        (asked, q, qt), (vid, v, vt) = _matrix(queries), _matrix(vectors)
        # in single precision a score is off by less than this; what may count is then scored in double precision
        off = 2 * (q.shape[1] + 4) * 2.0**-23 + ROUNDED
        coarse = (asked, q.astype(np.float32), qt), (vid, v.astype(np.float32), vt)
        at = 0
        for qid, _, _, s in _scores(queries, vectors, other_tag, coarse=coarse):
            n = s.shape[1]
            cuts = np.full(len(s), least)
            if k is not None and k * STRETCH <= n:
                # k stretches have a score of at least the k-th highest of their maxima, so the k-th score isn't lower
                most = np.maximum.reduceat(s, np.arange(0, n, STRETCH), axis=1)
                cuts = np.maximum(cuts, np.partition(most, most.shape[1] - k, axis=1)[:, most.shape[1] - k])
            elif k is not None:
                cuts = np.maximum(cuts, np.partition(s, n - min(k, n), axis=1)[:, n - min(k, n)])
            for i, row in enumerate(s):
                keep = np.flatnonzero((row >= cuts[i] - off) & (row > -1.5))
                score = np.round(v[keep] @ q[at + i], 6)
                keep, score = keep[ok := score >= least], score[ok]
                best = np.lexsort((vid[keep], -score))[:k]
                out_q.append(np.full(len(best), qid[i]))
                out_v.append(vid[keep[best]])
                out_s.append(score[best])
            at += len(qid)
        return _found(out_q, out_v, out_s)

    return run


def _tags(least: float):
    def run(key: tuple, queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out_q, out_t = [], []
        for qid, _, vt, s in _scores(queries, vectors, False):
            kinds, at = np.unique(vt, return_inverse=True)
            order = np.argsort(at, kind="stable")
            found = np.maximum.reduceat(s[:, order], np.searchsorted(at[order], np.arange(len(kinds))), axis=1) >= max(least, -1.5)
            row, kind = np.nonzero(found)
            out_q.append(qid[row])
            out_t.append(kinds[kind])
        return pa.table({"query_id": _cat(out_q, np.int64), "tag": _cat(out_t, np.int64)})

    return run


def _top_pairs(most: int, least: float):
    def run(key: tuple, queries: pa.Table, vectors: pa.Table) -> pa.Table:
        a, b, c = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for qid, vid, _, s in _scores(queries, vectors, False):
            row, col = np.nonzero((s >= least) & (s > -2) & (qid[:, None] < vid[None]))
            a, b, c = np.r_[a, qid[row]], np.r_[b, vid[col]], np.r_[c, s[row, col]]
            keep = np.lexsort((b, a, -c))[:most]
            a, b, c = a[keep], b[keep], c[keep]
        return pa.table({"a": a, "b": b, "score": c})

    return run


def _slim(df: DataFrame, tag: str | None) -> DataFrame:
    return materialize(df.where("embedding is not null and node_id is not null").select(F.col("node_id").cast("long").alias("id"), "embedding", (F.col(tag) if tag else F.lit(0)).cast("long").alias("tag")), "nearest")


def _sides(queries: DataFrame, vectors: DataFrame, tag: str | None, p: Params) -> tuple[DataFrame, Index]:
    a = _slim(queries, tag)
    return a, Index(a if queries is vectors else _slim(vectors, tag), p)


def nearest(queries: DataFrame, vectors: DataFrame, k: int | None, least: float = -1.0, tag: str | None = None, p: Params = Params()) -> DataFrame:
    """``query_id, node_id, score, rank``: the k vectors of cosine at least ``least`` nearest each query, itself left out; all of them without a k.

    Both sides: ``node_id, embedding`` of one length (others are an error); null ids and vectors are left out, null components are 0. Scores are
    rounded to 6 places and tie by id. Blocks that the index rules out aren't read. ``tag``: a column in which neighbours have to differ.
    """
    asked, index = _sides(queries, vectors, tag, p)
    found = index.search(asked, _best(k, least, tag is not None), "query_id long, node_id long, score double", least, k)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    ranked = found.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def _step_costs(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Warping similarity of each of ``a`` with each of ``b``; all of ``a`` have one number of steps, all of ``b`` one."""
    x, y = np.stack(a), np.stack(b)
    if not x.shape[1] or not y.shape[1]:
        return np.zeros((len(x), len(y)))
    sx, sy = (x**2).sum(-1), (y**2).sum(-1)
    acc: dict[tuple[int, int], np.ndarray | float] = {(-1, -1): 0.0}
    for i in range(x.shape[1]):
        for j in range(y.shape[1]):
            cost = np.maximum(0, sx[:, i, None] + sy[None, :, j] - 2 * (x[:, i] @ y[:, j].T))
            acc[i, j] = cost + reduce(np.minimum, [acc[k] for k in ((i - 1, j - 1), (i - 1, j), (i, j - 1)) if k in acc])
        for j in range(y.shape[1]):
            acc.pop((i - 1, j), None)
        acc.pop((-1, -1), None)
    return 1 / (1 + np.sqrt(acc[x.shape[1] - 1, y.shape[1] - 1]))


def _steps(t: pa.Table) -> list[np.ndarray]:
    """The steps of each chain as rows; none for a null."""
    lists = t["tag"].combine_chunks().field("steps")
    each = lists.flatten()
    flat = each.flatten()
    if len(each) and not each.null_count and not flat.null_count and len(np.unique(each.value_lengths().to_numpy(zero_copy_only=False))) == 1:
        rows = flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(each), -1)
        n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return [rows[end - k : end] if k else np.zeros((0, 1)) for k, end in zip(n, np.cumsum(n), strict=True)]
    return [np.array([np.asarray(v, float) for v in s]) if s else np.zeros((0, 1)) for s in lists.to_pylist()]


def _agreeing(least: float, least_steps: float, near: float = 1e-9):
    def run(key: tuple, queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out_q, out_a, out_n = [], [], []
        agents = vectors["tag"].combine_chunks().field("agent").dictionary_encode() if vectors.num_rows else None
        if agents is not None:
            of = agents.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            mine, theirs = _steps(queries), _steps(vectors)
            sizes = np.array([len(s) for s in theirs])
            plain = [t.set_column(t.schema.get_field_index("tag"), "tag", pa.array(np.zeros(t.num_rows, np.int64))) for t in (queries, vectors)]
            at = 0
            for qid, _, _, s in _scores(*plain, False, 256):
                here, at = np.arange(at, at + len(qid)), at + len(qid)
                like = (s >= least) & (s > -2)
                for size in np.unique([len(mine[i]) for i in here]):
                    rows = np.array([r for r, i in enumerate(here) if len(mine[i]) == size])
                    for other in np.unique(sizes):
                        cols = np.flatnonzero(sizes == other)
                        got = _step_costs([mine[here[r]] for r in rows], [theirs[c] for c in cols])
                        # too near to tell from products
                        for r, c in zip(*np.nonzero(like[np.ix_(rows, cols)] & (np.abs(got - least_steps) < near)), strict=True):
                            got[r, c] = _dtw(mine[here[rows[r]]], theirs[cols[c]])
                        like[np.ix_(rows, cols)] &= got > least_steps
                row, col = np.nonzero(like)
                pair, n = np.unique(row * (len(agents.dictionary) + 1) + of[col] + 1, return_counts=True)
                out_q.append(qid[pair // (len(agents.dictionary) + 1)])
                out_a.append(pair % (len(agents.dictionary) + 1) - 1)
                out_n.append(n)
        a = _cat(out_a, np.int64)
        kinds = agents.dictionary.to_numpy(zero_copy_only=False) if agents is not None and len(agents.dictionary) else np.zeros(1, np.int64)
        return pa.table({"query_id": _cat(out_q, np.int64), "agent_id": pa.array(kinds[np.maximum(a, 0)].astype(np.int64), mask=a < 0), "n": _cat(out_n, np.int64)})

    return run


def agreeing_chains(chains: DataFrame, least: float, least_steps: float, p: Params = Params(block=1 << 12, query_block=1 << 12)) -> DataFrame:
    """``query_id, agent_id, n``: the chains of each agent of cosine at least ``least`` to each one whose steps warp onto its own by more than ``least_steps``.

    ``chains``: ``node_id, agent_id, embedding, steps``. Pairs are counted in each pair of blocks and are never rows, no chain is written for each block; there may be several rows an agent.
    """
    c = chains.where("embedding is not null and node_id is not null").select(F.col("node_id").cast("long").alias("id"), "embedding", F.struct(F.col("agent_id").cast("long").alias("agent"), "steps").alias("tag"))
    c = materialize(c, "agreeing")
    return Index(c, p).sweep(c, _agreeing(least, least_steps), "query_id long, agent_id long, n long", least)


def _least_ids(least: float):
    def run(key: tuple, queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out_q, out_v = [], []
        for qid, vid, _, s in _scores(queries, vectors, False):
            order = np.argsort(vid, kind="stable")
            found = ((s >= least) & (s > -2))[:, order]
            row = np.flatnonzero(found.any(1))
            out_q.append(qid[row])
            out_v.append(vid[order][found[row].argmax(1)])
        return pa.table({"query_id": _cat(out_q, np.int64), "node_id": _cat(out_v, np.int64)})

    return run


def least_like(queries: DataFrame, vectors: DataFrame, least: float, p: Params = Params()) -> DataFrame:
    """``query_id, node_id``: the smallest id of the vectors of cosine at least ``least`` to each query, itself left out."""
    asked, index = _sides(queries, vectors, None, p)
    return index.search(asked, _least_ids(least), "query_id long, node_id long", least, None).groupBy("query_id").agg(F.min("node_id").alias("node_id"))


def tags_within(queries: DataFrame, vectors: DataFrame, least: float, tag: str, p: Params = Params()) -> DataFrame:
    """``query_id, tag``: the distinct tags (integers; null ones don't count) of the vectors of cosine at least ``least`` to each query, itself left out.

    Tags are made distinct in each pair of blocks, so like vectors of one tag are one row and not pairs.
    """
    index = Index(_slim(vectors.where(F.col(tag).isNotNull()), tag), p)
    return index.search(_slim(queries, None), _tags(least), "query_id long, tag long", least, None).distinct()


def contradiction_candidates(vectors: DataFrame, k: int = 20, least: float = 0.85) -> DataFrame:
    """Per node its most similar peers."""
    return nearest(vectors, vectors, k, least).select("query_id", "node_id", "score")


def affinity_edges(vectors: DataFrame, k: int = 3, least: float = 0.85) -> DataFrame:
    n = nearest(vectors, vectors, k, least)
    return n.select(F.col("query_id").alias("src"), F.col("node_id").alias("dst"), F.col("score").alias("weight"))


def weak_links(vectors: DataFrame, existing: DataFrame, k: int = 10, least: float = 0.75, max_degree: int = 5) -> DataFrame:
    """New speculative links within what is left of each node's out-degree, at half the similarity; one row an unordered pair."""
    near = nearest(vectors, vectors, k, least)
    known = existing.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    used = existing.groupBy(F.col("src").alias("query_id")).agg(F.count("*").alias("used"))
    fresh = near.withColumns({"a": F.least("query_id", "node_id"), "b": F.greatest("query_id", "node_id")}).join(known, ["a", "b"], "left_anti")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    left = fresh.join(used, "query_id", "left").withColumn("place", F.row_number().over(w))
    left = left.where(F.col("place") <= F.greatest(F.lit(0), max_degree - F.coalesce("used", F.lit(0))))
    return left.groupBy("a", "b").agg(F.round(F.max("score") * 0.5, 6).alias("weight"))


def overlapping_pairs(vectors: DataFrame, least: float = 0.85, most: int = 50, p: Params = Params()) -> DataFrame:
    """The most similar unordered pairs of at least a similarity, best first; a pair of blocks gives its ``most`` best alone."""
    asked, index = _sides(vectors, vectors, None, p)
    pairs = index.search(asked, _top_pairs(most, least), "a long, b long, score double", least, None)
    return pairs.orderBy(F.desc("score"), "a", "b").limit(most)


def cross_agent_neighbours(vectors: DataFrame, k: int = 10, least: float = 0.7) -> DataFrame:
    """Per node the nearest of other agents."""
    return nearest(vectors, vectors, k, least, tag="agent_id").select("query_id", "node_id", "score")


def suggest_tags(vectors: DataFrame, tags: DataFrame, least: float = 0.4, k: int = 5) -> DataFrame:
    """The tags whose vectors are nearest each node's."""
    return nearest(vectors, tags, k, least).select(F.col("query_id").alias("node_id"), F.col("node_id").alias("tag_id"), "score")


def dtw_of(a: Column | str, b: Column | str) -> Column:
    """1 / (1 + dynamic time warping distance) of two sequences of vectors; 0 where one is null or empty. For candidate pairs only."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_dtw(p, q) for p, q in zip(x, y, strict=True)])

    return run(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


def _dtw(a, b) -> float:
    if a is None or b is None or not len(a) or not len(b):
        return 0.0
    x, y = np.array([np.asarray(v, float) for v in a]), np.array([np.asarray(v, float) for v in b])
    cost = ((x[:, None, :] - y[None, :, :]) ** 2).sum(-1)
    acc = np.full((len(x) + 1, len(y) + 1), np.inf)
    acc[0, 0] = 0
    for i in range(len(x)):
        for j in range(len(y)):
            acc[i + 1, j + 1] = cost[i, j] + min(acc[i, j], acc[i, j + 1], acc[i + 1, j])
    return float(1 / (1 + np.sqrt(acc[-1, -1])))


def ratio_of(a: Column | str, b: Column | str) -> Column:
    """Ratcliff/Obershelp ratio of two texts in lower case, null counting as empty; twice the matched characters over all. For candidate pairs only."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, (p or "").lower(), (q or "").lower()).ratio() for p, q in zip(x, y, strict=True)])

    return run(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


def dtw_similarity(pairs: DataFrame) -> DataFrame:
    """``id, similarity`` of candidate pairs ``id, a, b`` of sequences of vectors; see ``dtw_of``."""
    return pairs.select("id", dtw_of("a", "b").alias("similarity"))


def text_ratio(pairs: DataFrame) -> DataFrame:
    """``id, ratio`` of candidate pairs ``id, a, b`` of texts; see ``ratio_of``."""
    return pairs.select("id", ratio_of("a", "b").alias("ratio"))


def cross_agent_conflicts(vectors: DataFrame, facts: DataFrame, k: int = 10, least: float = 0.7, alike: float = 0.85) -> DataFrame:
    """Of each node's nearest of other agents those that conflict: another object of the same (subject, predicate), else the same subject, else the same label and very alike.

    ``vectors``: ``node_id, embedding, agent_id, label``; ``facts``: ``node_id, subject, predicate, object``.
    """
    near = nearest(vectors, vectors, k, least, tag="agent_id")
    f = vectors.select("node_id", "label").join(facts, "node_id", "left")
    j = near.join(f.select(F.col("node_id").alias("query_id"), F.struct("label", "subject", "predicate", "object").alias("x")), "query_id")
    j = j.join(f.select("node_id", F.struct("label", "subject", "predicate", "object").alias("y")), "node_id")
    same = lambda c: F.coalesce(F.col(f"x.{c}") == F.col(f"y.{c}"), F.lit(False))
    why = (
        F.when(same("subject") & same("predicate") & (F.col("x.object") != F.col("y.object")), "structural").when(same("subject"), "subject").when(same("label") & (F.col("score") > alike), "semantic")
    )
    return j.select("query_id", "node_id", "score", why.alias("conflict")).where("conflict is not null")
