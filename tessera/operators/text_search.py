"""Exact top-k by words and by trigrams over blocks of nodes, without a row for each pair.

Nodes are packed, one row each: the words that some query has, with what each adds to a BM25 score, and the text's
trigrams. Nodes and queries are cut into blocks by hash; a pair of blocks is a task that holds the inverted lists of
its nodes and returns k rows a query. Within it

* words are added by MaxScore: those with the highest possible part first, until what is left can no longer lift a node
  over the k-th score; the common words that come last are then looked up for the nodes still in question alone;
* the blend of word score and trigram similarity looks at nodes by their upper bound (the similarity of two sets is at
  most the ratio of their sizes) and stops below the k-th blend; nodes without a common word are found by a prefix
  filter, for a set of similarity s or more shares one of the query's rarest |y| - ceil(s |y|) + 1 trigrams.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.scratch import materialize

#: Scores are rounded to six places; what differs by less may be equal.
EPS = 2e-6
NODE_BLOCK, QUERY_BLOCK = 1 << 11, 1 << 12
#: Texts whose trigrams are held at a time.
GRAM_ROWS = 1 << 7


def _codes(text: str) -> np.ndarray:
    c = np.frombuffer(f"  {text} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:])


def trigram_codes(text: str) -> Column:
    """The distinct trigrams of a text as ``exprs.trigrams`` has them, each as one long of three code points, in order: long texts are cut faster in Arrow batches."""

    @F.pandas_udf("array<bigint>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([_codes(x) for x in texts])

    return run(F.lower(F.coalesce(text, F.lit(""))))


def gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The trigrams of ``id, text``, few texts at a time: they are several times as large as the texts, and a batch holds thousands of these."""
    for whole in batches:
        for at in range(0, whole.num_rows, GRAM_ROWS):
            b = whole.slice(at, GRAM_ROWS)
            codes = [_codes(x) for x in b.column(1).to_pylist()]
            offsets = np.cumsum([0, *map(len, codes)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, np.concatenate(codes))], names=["node_id", "grams"])


def node_grams(nodes: DataFrame) -> DataFrame:
    """``node_id, grams`` of each content, as ``trigram_codes`` has them."""
    return nodes.select("node_id", F.lower(F.coalesce("content", F.lit("")))).mapInArrow(gram_batches, "node_id long, grams array<long>")


#: What separates words of letters and digits.
TOKEN = r"[^\p{L}\p{N}]+"


def words_of(text: str) -> Column:
    """The lower-cased words of letters and digits, in order; none of a null text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN), lambda w: w != "")


def node_words(nodes: DataFrame) -> DataFrame:
    """``node_id, words``: each content cut once, written, for it is read for lengths and for terms."""
    return materialize(nodes.select("node_id", words_of("content").alias("words")), "node-words")


def asked_terms(words: DataFrame, tokens: DataFrame) -> DataFrame:
    """``node_id, token, tf`` of the words that ``tokens(token)`` has: the others never leave their scan."""
    each = words.select("node_id", F.explode("words").alias("token")).join(tokens.select("token").distinct(), "token", "left_semi")
    return each.groupBy("node_id", "token").agg(F.count("*").alias("tf"))


def counted_terms(words: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The words that ``asked(query_id, token)`` has by number (``token, id``), and how often a node has them (``node_id, id, tf``), both written."""
    numbered = materialize(asked.select("token").distinct().withColumn("id", F.monotonically_increasing_id()), "bm25-words")
    return numbered, materialize(asked_terms(words, numbered).join(numbered, "token").select("node_id", "id", "tf"), "bm25-hits")


def weighted_terms(words: DataFrame, asked: DataFrame, k1: float = 1.2, b: float = 0.75, counted: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (``node_id, words array<struct<id, w>>``) and queries (``query_id, words array<long>``), words as numbers.

    ``words``: as ``node_words`` has them; ``asked``: ``query_id, token``; ``counted``: their ``counted_terms``, where at hand. A query's word that no node has is left out.
    """
    lengths = words.groupBy("node_id").agg(F.sum(F.size("words")).alias("length")).where("length > 0")
    stats = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    numbered, hits = counted or counted_terms(words, asked)
    df = hits.groupBy("id").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats))
    idf = df.select("id", "mean", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    packed = hits.join(idf, "id").join(lengths, "node_id").groupBy("node_id").agg(F.collect_list(F.struct("id", part.alias("w"))).alias("words"))
    queries = asked.join(numbered.join(df.select("id"), "id", "left_semi"), "token").groupBy("query_id").agg(F.collect_set("id").alias("words"))
    return packed, queries


class Lists:
    """The inverted lists of a block."""

    def __init__(self, words: pa.ListArray) -> None:
        flat = words.flatten()
        size = np.diff(words.offsets.to_numpy())
        node = np.repeat(np.arange(len(size)), size)
        word, w = flat.field("id").to_numpy(), flat.field("w").to_numpy()
        order = np.lexsort((node, word))
        self.n, self.node, self.w = len(size), node[order], w[order]
        ids, start = np.unique(word[order], return_index=True)
        ends = np.append(start[1:], len(order))
        self.at = {int(i): (int(a), int(b)) for i, a, b in zip(ids, start, ends, strict=True)}
        self.most = np.maximum.reduceat(self.w, start) if len(start) else np.zeros(0)
        self.bound = dict(zip(ids.tolist(), self.most.tolist(), strict=True))

    def scores(self, words: list[int]) -> np.ndarray:
        """Every node's whole score; 0 where no word is shared."""
        out = np.zeros(self.n)
        for a, b in (self.at[i] for i in words if i in self.at):
            out[self.node[a:b]] += self.w[a:b]
        return out

    def best(self, words: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The nodes that may be among the k best, and their scores, by MaxScore."""
        held = sorted((i for i in words if i in self.at), key=lambda i: -self.bound[i])
        left = sum(self.bound[i] for i in held)
        out = np.zeros(self.n)
        done = 0
        for done, i in enumerate(held, 1):
            a, b = self.at[i]
            out[self.node[a:b]] += self.w[a:b]
            left -= self.bound[i]
            if k < self.n and (cut := np.partition(out, self.n - k)[self.n - k]) > left + EPS:
                break
        keep = np.flatnonzero(out > 0)
        if done < len(held):  # no word that is left lifts another node over the k-th
            keep = keep[out[keep] + left >= cut - EPS]
            for i in held[done:]:
                a, b = self.at[i]
                at = np.minimum(np.searchsorted(self.node[a:b], keep), b - a - 1) + a
                out[keep] += np.where(self.node[at] == keep, self.w[at], 0)
                left -= self.bound[i]
                if len(keep) > k:
                    cut = np.partition(out[keep], len(keep) - k)[len(keep) - k]
                    keep = keep[out[keep] + left >= cut - EPS]
        return keep, out[keep]


def _list(column: pa.ChunkedArray) -> pa.ListArray:
    made = column.combine_chunks()
    return made.combine_chunks() if isinstance(made, pa.ChunkedArray) else made


def _cut(nodes: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids[nodes], -scores))[:k]
    return ids[nodes[order]], scores[order]


def _result(found: list[tuple]) -> pa.Table:
    cat = lambda i, t: np.concatenate([f[i] for f in found]) if found else np.zeros(0, t)
    return pa.table({"query_id": pa.array(cat(0, np.int64)), "node_id": pa.array(cat(1, np.int64)), "score": pa.array(cat(2, float))})


def _word_search(k: int):
    def run(key: tuple, nodes: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        if nodes.num_rows and queries.num_rows:
            ids, lists = nodes["node_id"].to_numpy(), Lists(_list(nodes["words"]))
            for q, words in zip(queries["query_id"].to_pylist(), queries["words"].to_pylist(), strict=True):
                at, scores = lists.best(words, k)
                hit, score = _cut(at, np.round(scores, 6), ids, k)
                found.append((np.full(len(hit), q), hit, score))
        return _result(found)

    return run


class Grams:
    """The trigrams of a block's nodes."""

    def __init__(self, grams: pa.ListArray) -> None:
        self.flat, self.start = grams.flatten().to_numpy(), grams.offsets.to_numpy() - grams.offsets.to_numpy()[0]
        self.size = np.diff(self.start)
        self.lists: tuple[np.ndarray, np.ndarray] | None = None

    def similarity(self, nodes: np.ndarray, y: np.ndarray) -> np.ndarray:
        size = self.size[nodes]
        first = np.cumsum(size) - size
        x = self.flat[np.repeat(self.start[nodes] - first, size) + np.arange(size.sum())]
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        common = np.add.reduceat((y[at] == x).astype(np.int64), first) if len(nodes) else np.zeros(0)
        return common / (size + len(y) - common)

    def sharing(self, y: np.ndarray, least: float) -> np.ndarray:
        """Nodes that share one of the prefix of ``y``: all of similarity ``least`` or more are among them."""
        if self.lists is None:
            node = np.repeat(np.arange(len(self.size)), self.size)
            order = np.argsort(self.flat, kind="stable")
            self.lists = (self.flat[order], node[order])
        gram, node = self.lists
        a, b = np.searchsorted(gram, y), np.searchsorted(gram, y, "right")
        rarest = np.argsort(b - a, kind="stable")[: len(y) - ceil(least * len(y) - 1e-9) + 1]
        return np.unique(np.concatenate([node[a[i] : b[i]] for i in rarest])) if len(rarest) else np.zeros(0, np.int64)


def blended(lists: Lists, grams: Grams, words: list[int], y: np.ndarray, best: float, k: int, least: float, floor: float = -1.0) -> tuple[np.ndarray, np.ndarray]:
    """The nodes that may be among the k best of .7 word score / best + .3 similarity, and their blends; k nodes of all blocks have ``floor`` or more."""
    score = np.round(lists.scores(words), 6)
    share = score / best if best else np.zeros_like(score)
    most = np.minimum(grams.size, len(y)) / np.maximum(grams.size, len(y))
    match = np.flatnonzero(score > 0)
    bound = 0.7 * share[match] + 0.3 * most[match]
    match = match[np.argsort(-bound, kind="stable")]
    bound = -np.sort(-bound, kind="stable")
    seen, made = [], []

    def kth() -> float:
        all_of = np.concatenate(made) if made else np.zeros(0)
        return float(np.partition(all_of, len(all_of) - k)[len(all_of) - k]) if len(all_of) >= k else -1.0

    cut, at = floor, 0
    while at < len(match) and bound[at] >= cut - EPS:
        part = match[at : at + 128]
        seen.append(part)
        made.append(0.7 * share[part] + 0.3 * grams.similarity(part, y))
        at += 128
        cut = max(floor, kth())
    # without a common word a node needs this similarity at least
    need = max(least, (cut - EPS) / 0.3)
    if need <= 1:
        other = grams.sharing(y, need)
        other = other[(score[other] <= 0) & (most[other] >= need)]
        for i in range(0, len(other), 1024):
            part = other[i : i + 1024]
            s = grams.similarity(part, y)
            seen.append(part[s > least])
            made.append(0.3 * s[s > least])
    return (np.concatenate(seen), np.concatenate(made)) if seen else (np.zeros(0, np.int64), np.zeros(0))


def _text_search(k: int, least: float):
    def run(key: tuple, nodes: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        if nodes.num_rows and queries.num_rows:
            ids, lists, grams = nodes["node_id"].to_numpy(), Lists(_list(nodes["words"])), Grams(_list(nodes["grams"]))
            for q, words, y, best, floor in zip(*(queries[c].to_pylist() for c in ("query_id", "words", "grams", "best", "floor")), strict=True):
                at, scores = blended(lists, grams, words, np.array(y, np.int64), best, k, least, floor)
                hit, score = _cut(at, np.round(scores, 6), ids, k)
                found.append((np.full(len(hit), q), hit, score))
        return _result(found)

    return run


def _blocks(nodes: DataFrame, queries: DataFrame, run) -> DataFrame:
    cut = lambda n, size: max(1, -(-n // size))
    n, m = nodes.count(), queries.count()
    cores = 2 * nodes.sparkSession.sparkContext.defaultParallelism
    nb = max(cut(n, NODE_BLOCK), min(cores, cut(n, 256)))
    qb = max(cut(m, QUERY_BLOCK), min(cut(cores, nb), cut(m, 32)))
    of = lambda key, k: F.pmod(F.xxhash64(key), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = nodes.withColumns({"nb": of("node_id", nb)}).withColumn("qb", every(qb))
    right = queries.withColumns({"qb": of("query_id", qb)}).withColumn("nb", every(nb))
    return left.groupBy("nb", "qb").cogroup(right.groupBy("nb", "qb")).applyInArrow(run, "query_id long, node_id long, score double")


def _top(df: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_by_words(packed: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, node_id, score, rank``: the k best nodes of each query by the sum of its words' weights; ties by id."""
    return _top(_blocks(packed, queries, _word_search(k)), k)


def top_by_text(packed: DataFrame, queries: DataFrame, texts: DataFrame, asked: DataFrame, k: int, least: float) -> DataFrame:
    """The k best of .7 x word score over the query's best + .3 x trigram similarity, among nodes with a common word or a similarity above ``least``.

    ``texts``: ``node_id, grams`` of all nodes; ``asked``: ``query_id, grams`` of all queries. The k-th word score of all nodes is a floor
    of the k-th blend in every block, which spares measuring most nodes of the blocks that have none of the best.
    """
    best = top_by_words(packed, queries, k).groupBy("query_id").agg(F.max("score").alias("best"), F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    floor = F.when(F.col("best") > 0, 0.7 * F.col("kth") / F.col("best"))
    none = F.array().cast("array<struct<id:long,w:double>>")
    nodes = materialize(texts.join(packed, "node_id", "left").select("node_id", "grams", F.coalesce("words", none).alias("words")), "text-nodes")
    q = asked.join(queries, "query_id", "left").join(best, "query_id", "left")
    q = materialize(q.select("query_id", "grams", F.coalesce("words", F.array().cast("array<long>")).alias("words"), F.coalesce("best", F.lit(0.0)).alias("best"), F.coalesce(floor, F.lit(-1.0)).alias("floor")), "text-queries")
    return _top(_blocks(nodes, q, _text_search(k, least)), k)
