"""SimHash near-duplicate groups found with BK-trees.

Two fingerprints that differ in at most ``radius`` bits agree on some ``keep`` of the segments
into which the 64 bits are cut, if there are ``radius + keep`` segments. So each choice of
``keep`` segments makes one table of shards: the fingerprints of a shard agree on these
segments. A shard becomes a BK-tree (children keyed by their integer Hamming distance to the
parent) that its members search, following only edges within the radius. A shard never has to
fit one task: one with more members than ``block`` is cut into blocks, and each pair of blocks
is a task of its own, so a tree that a task holds has at most ``block`` nodes. That bound is
what makes the trees safe to send to the tasks; broadcasting the trees of all fingerprints to
every task would grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import word_hashes
from tessera.llm.common import as_bytes, text_slices
from tessera.llm.components import component_labels
from tessera.scratch import materialize


def _hashes(text: bytes, shingle: int) -> np.ndarray:
    """The XXH64 hashes of the text's shingles; a text of fewer words is one shingle, one without a word has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, n)


def _majority(h: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """The majority bits of the shingles' XXH64 hashes; 0 if the text has no word."""
    return _majority(_hashes(text, shingle))


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = 4) -> DataFrame:
    """``doc_id``, the text's hash and its fingerprint ``fp`` as a signed long, over whole texts (null: no word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in as_bytes(batch, text)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(fps.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    rows = docs.select("doc_id", text, F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


class BkForest:
    """BK-trees of many shards side by side, built and searched level by level.

    A node's children are keyed by their Hamming distance to it. ``group`` numbers the shard of
    each code from 0 and is sorted; codes of a shard are distinct.
    """

    def __init__(self, codes: np.ndarray, group: np.ndarray) -> None:
        n = len(codes)
        self.codes = codes
        self.edge = np.zeros(n, np.int16)
        self.first = np.zeros(n, np.int64)  # of a node's children, which lie side by side
        self.count = np.zeros(n, np.int64)
        self.children: np.ndarray = np.zeros(0, np.int64)
        roots, members, family, parts, at = [], np.arange(n), group.astype(np.int64), [], 0
        parent_of_family: np.ndarray | None = None
        while len(members):
            heads = np.flatnonzero(np.r_[True, family[1:] != family[:-1]])
            head = members[heads]
            if parent_of_family is None:
                roots = head
            else:
                owner = parent_of_family[heads]
                starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                self.first[owner[starts]] = at + starts
                self.count[owner[starts]] = np.diff(np.r_[starts, len(owner)])
                parts.append(head)
                at += len(head)
            which = np.cumsum(np.r_[True, family[1:] != family[:-1]]) - 1
            rest = np.ones(len(members), bool)
            rest[heads] = False
            members, own = members[rest], head[which[rest]]
            distance = np.bitwise_count(codes[members] ^ codes[own]).astype(np.int16)
            order = np.lexsort((members, distance, own))
            members, own, distance = members[order], own[order], distance[order]
            self.edge[members] = distance  # right for those that become heads in the next round
            family = own * 65 + distance
            parent_of_family = own
        self.roots = np.asarray(roots, np.int64)
        self.children = np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def search(self, queries: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query's place, node) within the radius, a level at a time; ``group``: each query's shard."""
        q, node = np.arange(len(queries)), self.roots[group]
        while len(q):
            d = np.bitwise_count(queries[q] ^ self.codes[node]).astype(np.int16)
            near = d <= radius
            yield q[near], node[near]
            count = self.count[node]
            total = int(count.sum())
            up = np.repeat(np.arange(len(q)), count)
            step = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
            child = self.children[self.first[node][up] + step] if total else np.zeros(0, np.int64)
            follow = np.abs(self.edge[child] - d[up]) <= radius
            q, node = q[up[follow]], child[follow]


class CodeGroups:
    """BK-trees of shards whose members may share a code: a node stands for all members with its code."""

    def __init__(self, codes: np.ndarray, group: np.ndarray) -> None:
        self.order = np.lexsort((codes, group))
        c, g = codes[self.order], group[self.order]
        new = np.r_[True, (c[1:] != c[:-1]) | (g[1:] != g[:-1])]
        self.first = np.flatnonzero(new)
        self.count = np.diff(np.r_[self.first, len(c)])
        self.tree = BkForest(c[new], g[new])

    def search(self, queries: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query's place, member's place) within the radius."""
        for q, node in self.tree.search(queries, group, radius):
            n = self.count[node]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(q, n), self.order[np.repeat(self.first[node], n) + step]


def _stars(codes: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A forest that spans the links: each code that is linked, with its root."""
    root = np.arange(len(codes))
    for a, b in pairs:
        while len(a):
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            low, high = np.minimum(ra, rb)[apart], np.maximum(ra, rb)[apart]
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]
            a, b = a[apart], b[apart]
    moved = np.flatnonzero(root != np.arange(len(codes)))
    return codes[root[moved]], codes[moved]


def _link_shards(radius: int, chunk: int = 1 << 13):
    """For sorted rows (shard, left block, right block, side, fp): the spanning links of each task's shards."""

    def solve(key: np.ndarray, fp: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes = fp.view(np.uint64)
        group = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
        tree = side == 0
        node_at = np.flatnonzero(tree)
        has = np.unique(group[node_at])
        forest = BkForest(codes[node_at], np.searchsorted(has, group[node_at]))
        within = np.isin(group, has)
        # a block met with itself has one side: its members search their own tree
        two_sided = np.zeros(group[-1] + 1, bool)
        two_sided[group[~tree]] = True
        asks = np.flatnonzero(within & (~tree | ~two_sided[group]))

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for at in range(0, len(asks), chunk):
                part = asks[at : at + chunk]
                for q, node in forest.search(codes[part], np.searchsorted(has, group[part]), radius):
                    yield part[q], node_at[node]

        return _stars(codes, pairs())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def emit() -> Iterator[pa.RecordBatch]:
            key, fp, side = (np.concatenate(x) for x in zip(*held, strict=True))
            a, b = solve(key, fp, side)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            key, fp, side = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "fp", "side"))
            if not len(key):
                continue
            last = len(key) - int(np.argmax(key[::-1] != key[-1])) if (key != key[-1]).any() else 0
            if last:  # all shards but the last are whole
                held.append((key[:last], fp[:last], side[:last]))
                yield from emit()
                held.clear()
            held.append((key[last:], fp[last:], side[last:]))
        if held:
            yield from emit()

    return run


def _dealt(rows: DataFrame, block: int, *columns: str) -> DataFrame:
    """``rows`` of shards with two members or more, dealt to tasks that each hold a block of a shard, or a pair of blocks, by ``side``."""
    counts = rows.groupBy("shard").agg(F.count("*").alias("_n")).where("_n > 1")
    rows = rows.join(counts, "shard")
    blocks = F.ceil(F.col("_n") / block).cast("int")
    own = F.pmod(F.xxhash64(columns[0], F.lit(7)), blocks.cast("long")).cast("int")
    # a block meets itself and every other block once
    meets = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    rows = rows.select("shard", *columns, own.alias("_own"), F.explode(meets).alias("_m"))
    rows = rows.select(F.xxhash64("shard", "_m.i", "_m.j").alias("shard"), *columns, (F.col("_own") != F.col("_m.i")).cast("int").alias("side"))
    return rows.repartition("shard").sortWithinPartitions("shard", "side", columns[0])


def near_links(fps: DataFrame, radius: int = 4, keep: int = 2, block: int = 2048) -> DataFrame:
    """Links ``(a, b)`` that connect exactly what links of at most ``radius`` bits connect.

    ``fps``: distinct, non-null longs ``fp``. Each shard gives a spanning forest of its links,
    so a group of n copies makes fewer than n rows a table, and never all pairs.
    """
    parts = radius + keep
    cuts = [round(64 * i / parts) for i in range(parts + 1)]
    segment = [(((1 << (b - a)) - 1) << (64 - b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    masks = [sum(segment[i] for i in pick) for pick in combinations(range(parts), keep)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    rows = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("choice", "part"))
    rows = rows.select("fp", F.xxhash64("choice", "part").alias("shard"))
    dealt = _dealt(rows, block, "fp")
    return dealt.mapInArrow(_link_shards(radius), "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """``doc_id``, ``text_hash``, ``fp``, ``root`` (equal within a component) and ``component_id``, the smallest ``doc_id`` that links reach.

    Nulls: a null text has no word, a null ``doc_id`` is never a ``component_id`` unless its
    whole component has none. Texts without a word have fingerprint 0 and link like any other.
    Rows that repeat are linked to each other and each give a row. An empty table gives none.
    Only ``doc_id`` and the text are read, so further columns can't clash.
    """
    prints = materialize(with_fingerprint(docs, text, shingle), "simhash")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    links = near_links(distinct.select("fp"), radius)
    labels = component_labels(links, "simhash")
    # a fingerprint without links is its own component
    named = distinct.join(labels, distinct.fp == labels.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "simhash-named")
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    whole = named.join(least, "root").select("fp", "root", "component_id")
    return prints.join(whole, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def op5_near_duplicates(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Near copies, to the pipeline's stage: this Jaccard similarity of the sets of shingles of so many words.
SHINGLE, SIMILARITY = 5, 0.8
#: Bits that may differ in a candidate. At a Jaccard similarity of 0.8 about 10 of 64 do, give or take 3.
RADIUS = 26
_BUCKETS = 1 << 16
_LOW48 = np.uint64((1 << 48) - 1)
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all bits, one to one."""
    h = (h ^ (h >> np.uint64(30))) * _ODD[1]
    h = (h ^ (h >> np.uint64(27))) * _ODD[2]
    return h ^ (h >> np.uint64(31))


def shingle_hashes(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each shingle of each text, with its text's place; a text of fewer words is one shingle, one without a word has none."""
    joined = b"\n".join(texts).lower()
    start, _, one, two = word_hashes(joined)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    counts = np.diff(np.searchsorted(start, ends), prepend=0)
    doc = np.repeat(np.arange(len(texts)), counts)
    word, total = _mix(one ^ (two * _ODD[0])), np.zeros(len(doc), np.uint64)
    for j in range(shingle):
        factor = _ODD[j % len(_ODD)] + np.uint64(2 * (j // len(_ODD)))
        n = max(0, len(doc) - j)
        same = doc[j:] == doc[:n]
        total[:n] += np.where(same, word[j:] * factor, np.uint64(0))
    last = np.zeros(len(doc), bool)
    n = max(0, len(doc) - shingle + 1)
    last[:n] = doc[shingle - 1 :] == doc[:n]
    last[(np.cumsum(counts) - counts)[(counts > 0) & (counts < shingle)]] = True
    return _mix(total[last]), doc[last]


def _sorted_sets(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of a text and a number, by text and number."""
    order = np.argsort(h)
    narrow = doc[order].astype(np.uint16 if not len(doc) or doc[-1] < 1 << 16 else np.int64)
    order = order[np.argsort(narrow, kind="stable")]
    h, doc = h[order], doc[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
    return h[new], doc[new]


def _majorities(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The majority bits of each text's numbers, ``n`` of them a text, side by side."""
    ones, at = np.zeros((len(n), 64), np.int64), 0
    owner = np.repeat(np.arange(len(n)), n)
    while at < len(h):
        part, who = h[at : at + (1 << 17)], owner[at : at + (1 << 17)]
        first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones[who[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
        at += len(part)
    return np.packbits(2 * ones > n[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def _slices(batches: Iterator[pa.RecordBatch], size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    return (part for batch in batches if batch.num_rows for part in text_slices(batch, size))


def set_prints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``text_hash`` and of the text's set of shingles the size ``n`` and a hash ``set_key``; sets are equal if both are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            n, key, _ = _keys(*_sorted_sets(*shingle_hashes(as_bytes(part, "text"), shingle)), part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(key.view(np.int64))], names=["doc_id", "text_hash", "set_key"])

    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, set_key long")


def _keys(h: np.ndarray, doc: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text's set the size, a hash that no order changes, and where it starts."""
    n = np.bincount(doc, minlength=rows)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(h ^ _ODD[3]), dtype=np.uint64)))
    ends = np.cumsum(n)
    return n, _mix((total[ends] - total[ends - n]) ^ (n.astype(np.uint64) * _ODD[4])), ends - n


def _frequencies(docs: DataFrame, shingle: int) -> np.ndarray:
    """How many shingles of all sets fall in each hash bucket: ``_BUCKETS`` numbers, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_BUCKETS, np.int64)
        for part in _slices(batches):
            h, _ = _sorted_sets(*shingle_hashes(as_bytes(part, "text"), shingle))
            total += np.bincount((h >> np.uint64(48)).astype(np.int64), minlength=_BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    found = np.zeros(_BUCKETS, np.int64)
    counts = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for bucket, n in counts.collect():
        found[bucket] = n
    return found


_SHARED = "shard long, set_key long, fp long, n int, pos int"


def _prefixes(docs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Rows ``(shard, set_key, fp, n, pos)``: two sets of at least ``similarity`` share a shard.

    Such sets have at least ``similarity * n`` shingles in common, so in any order of all
    shingles each has one of these among its first ``n - ceil(similarity * n) + 1``. The order
    is by the bucket's count, which puts common shingles last; it decides the size of shards only.
    """
    by_rank = np.argsort(_frequencies(docs, shingle), kind="stable")
    rank = np.empty(_BUCKETS, np.uint64)
    rank[by_rank] = np.arange(_BUCKETS)
    dealt = lambda h, table: table[(h >> np.uint64(48)).astype(np.int64)].astype(np.uint64) << np.uint64(48) | (h & _LOW48)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            h, doc = shingle_hashes(as_bytes(part, "text"), shingle)
            h, doc = _sorted_sets(dealt(h, rank), doc)
            shingles = dealt(h, by_rank)
            n, key, first = _keys(shingles, doc, part.num_rows)
            fp = _majorities(shingles, n)
            once = np.zeros(len(n), bool)  # copies in a slice are sent once, texts without a word never
            once[np.unique(key, return_index=True)[1]] = True
            place = np.arange(len(h)) - first[doc]
            take = n - np.ceil(similarity * n - 1e-6).astype(np.int64) + 1
            sent = once[doc] & (place < take[doc])
            h, doc, place = h[sent], doc[sent], place[sent]
            columns = [h.view(np.int64), key.view(np.int64)[doc], fp.view(np.int64)[doc], n[doc].astype(np.int32), place.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shard", "set_key", "fp", "n", "pos"])

    return docs.select("text").mapInArrow(run, _SHARED)


def _may_be_similar(n: np.ndarray, pos: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets that share no shingle before this shard's can have the similarity: by their sizes and what is left of them from here on."""
    sizes = np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]) - 1e-6
    return sizes & (np.minimum(n[a] - pos[a], n[b] - pos[b]) >= similarity / (1 + similarity) * (n[a] + n[b]) - 1e-6)


_FOUND = "a long, b long, " + _SHARED


def _first_links(radius: int, similarity: float, block: int = 1024, slab: int = 1 << 20):
    """Of rows sorted by shard and set: candidate pairs ``(a, b)``, and the rows of shards with more of them than were sent.

    A shard with few candidates sends them all and is done. In any other each set is paired
    with its nearest predecessor only. A shard of more than ``block`` sets goes block by block,
    each together with the shard's first set.
    """

    def solve(rows: list[np.ndarray], whole: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``whole``: whether a row's shard is all here."""
        shard, key, fp, n, pos = rows
        group = np.cumsum(np.r_[True, shard[1:] != shard[:-1]]) - 1
        size = np.bincount(group)
        cost = np.cumsum(size.astype(np.int64) ** 2) // slab
        bounds = np.concatenate(([0], np.cumsum(size)))
        codes = fp.view(np.uint64)
        for g in np.split(np.arange(len(size)), np.flatnonzero(np.diff(cost)) + 1):
            lo, hi = int(bounds[g[0]]), int(bounds[g[-1] + 1])
            own = group[lo:hi] - g[0]
            tree = CodeGroups(codes[lo:hi], own)
            found = [(q[node < q] + lo, node[node < q] + lo) for q, node in tree.search(codes[lo:hi], own, radius)]
            q, p = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            fits = _may_be_similar(n, pos, p, q, similarity) & (key[p] != key[q])
            q, p = q[fits], p[fits]
            per = np.bincount(group[q] - g[0], minlength=len(g))
            done = (per <= 2 * size[g]) & whole[bounds[g]]
            near = np.lexsort((key[p], np.bitwise_count(codes[p] ^ codes[q]), q))
            first = np.zeros(len(q), bool)
            if len(q):
                first[near[np.r_[True, q[near][1:] != q[near][:-1]]]] = True
                first |= done[group[q] - g[0]]
            a, b = np.minimum(key[p], key[q])[first], np.maximum(key[p], key[q])[first]
            left = np.flatnonzero(~done[own]) + lo
            none = pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int32())
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none[0], none[0], none[0], none[1], none[1]], names=names)
            if len(left):
                gap = pa.nulls(len(left), pa.int64())
                yield pa.RecordBatch.from_arrays([gap, gap, *[pa.array(c[left]) for c in rows]], names=names)

    names = [f.split()[0] for f in _FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the rows so far of a shard that may go on
        pivot: list[np.ndarray] | None = None  # its first row, once a block of it is gone

        def started(rows: list[np.ndarray]) -> list[np.ndarray]:
            return rows if pivot is None else [np.r_[p, c] for p, c in zip(pivot, rows, strict=True)]

        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in names[2:]]
            if not len(rows[0]):
                continue
            rows = rows if held is None else [np.r_[h, c] for h, c in zip(held, rows, strict=True)]
            new = np.r_[True, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])]
            rows = [c[new] for c in rows]
            edge = np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]])
            if pivot is not None and len(edge) > 1:
                yield from solve(started([c[: edge[1]] for c in rows]), np.zeros(int(edge[1]) + 1, bool))
                pivot, rows, edge = None, [c[edge[1] :] for c in rows], edge[1:] - edge[1]
            last = int(edge[-1])
            if last:
                sizes = np.diff(edge)
                take = np.repeat(sizes > 1, sizes)
                if take.any():
                    yield from solve([c[:last][take] for c in rows], np.ones(int(take.sum()), bool))
                rows = [c[last:] for c in rows]
            while len(rows[0]) > block:
                some = started([c[:block] for c in rows])
                yield from solve(some, np.zeros(len(some[0]), bool))
                pivot, rows = [c[:1] for c in some], [c[block:] for c in rows]
            held = rows
        if held is not None and len(held[0]) and (pivot is not None or len(held[0]) > 1):
            some = started(held)
            yield from solve(some, np.full(len(some[0]), pivot is None))

    return run


def _candidates(radius: int, similarity: float, most: int | None, chunk: int = 1 << 9):
    """For dealt rows: pairs within the radius of sets of different parts that may be similar, of each set with its ``most`` nearest."""
    names = ("shard", "fp", "side", "n", "part", "set_key", "pos")

    def solve(key: np.ndarray, fp: np.ndarray, side: np.ndarray, n: np.ndarray, part: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
        codes = fp.view(np.uint64)
        group = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
        tree = side == 0
        node_at = np.flatnonzero(tree)
        if not len(node_at):
            return
        has = np.unique(group[node_at])
        bk = CodeGroups(codes[node_at], np.searchsorted(has, group[node_at]))
        two_sided = np.zeros(group[-1] + 1, bool)
        two_sided[group[~tree]] = True
        asks = np.flatnonzero(np.isin(group, has) & (~tree | ~two_sided[group]))
        for at in range(0, len(asks), chunk):
            some = asks[at : at + chunk]
            found = [(some[q], node_at[node]) for q, node in bk.search(codes[some], np.searchsorted(has, group[some]), radius)]
            a, b = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            fits = (part[a] != part[b]) & _may_be_similar(n, pos, a, b, similarity)
            a, b = a[fits], b[fits]
            if most is not None and len(a):
                near = np.lexsort((ids[b], np.bitwise_count(codes[a] ^ codes[b]), a))
                a, b = a[near], b[near]
                first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
                place = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)]))
                a, b = a[place < most], b[place < most]
            if len(a):
                pairs = np.unique(np.stack([np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            key = columns[0]
            if not len(key):
                continue
            last = len(key) - int(np.argmax(key[::-1] != key[-1])) if (key != key[-1]).any() else 0
            if held and held[-1][0][-1] != key[0]:
                yield from solve(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held.clear()
            if last:  # all shards but the last are whole
                held.append(tuple(c[:last] for c in columns))
                yield from solve(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held.clear()
            held.append(tuple(c[last:] for c in columns))
        if held:
            yield from solve(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _sets_of(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``set_key`` and the sorted ``shingles`` of each distinct set that ``wanted`` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            h, doc = _sorted_sets(*shingle_hashes(as_bytes(part, "text"), shingle))
            n, key, _ = _keys(h, doc, part.num_rows)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(h.view(np.int64)))
            once = pa.array(np.unique(key, return_index=True)[1])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), lists], names=["set_key", "shingles"]).take(once)

    sets = docs.select("text").mapInArrow(run, "set_key long, shingles array<long>")
    return sets.join(wanted, "set_key", "left_semi").groupBy("set_key").agg(F.first("shingles").alias("shingles"))


def _verified(pairs: DataFrame, docs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Those of the pairs ``(a, b)`` whose sets have the Jaccard similarity."""
    ends = materialize(pairs.select(F.explode(F.array("a", "b")).alias("set_key")).distinct(), "simhash-ends")
    held = materialize(_sets_of(docs, ends, shingle), "simhash-candidate-sets")
    side = lambda c: held.select(F.col("set_key").alias(c), F.col("shingles").alias(f"s{c}"))
    both = F.size(F.array_intersect("sa", "sb"))
    alike = both / (F.size("sa") + F.size("sb") - both) >= similarity
    return materialize(pairs.join(side("b"), "b").join(side("a"), "a").where(alike).select("a", "b"), "simhash-verified")


def similar_links(docs: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, shingle: int = SHINGLE, block: int = 2048) -> DataFrame:
    """Links ``(a, b)`` of ``set_key`` that connect what links of sets of at least ``similarity`` connect.

    Shards are sets that share a rare shingle, and within them BK-trees of fingerprints find the
    candidates; a candidate is a link once its sets have been compared. A first round compares all
    candidates of small shards and in larger ones each set with its nearest. Later rounds look at
    shards that still hold different components and compare each set with its 8, its 64 and at last
    all its candidates in other components, so a large group of copies has become one component
    long before its pairs would be counted, and no pair is compared twice.
    """
    rows = _prefixes(docs, similarity, shingle).repartition("shard").sortWithinPartitions("shard", "set_key")
    found = materialize(rows.mapInArrow(_first_links(radius, similarity), _FOUND), "simhash-found")
    tested = materialize(found.where("a is not null").select("a", "b").distinct(), "simhash-pairs")
    links = _verified(tested, docs, similarity, shingle)
    shared = found.where("shard is not null").select("shard", "set_key", "fp", "n", "pos").distinct()
    for most in (8, 64, None):
        parts = component_labels(links, "simhash-parts").select(F.col("node").alias("set_key"), "root")
        told = shared.join(parts, "set_key", "left").withColumn("part", F.coalesce("root", "set_key")).drop("root")
        apart = told.groupBy("shard").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("shard")
        told = materialize(told.join(apart, "shard", "left_semi"), "simhash-apart")
        if told.isEmpty():
            break
        shared = told.drop("part")
        more = _dealt(told, block, "set_key", "fp", "n", "part", "pos").mapInArrow(_candidates(radius, similarity, most), "a long, b long")
        more = materialize(more.distinct().join(tested, ["a", "b"], "left_anti"), "simhash-more-pairs")
        if not more.isEmpty():
            tested, links = tested.union(more), links.union(_verified(more, docs, similarity, shingle))
    return links


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component of near copies: the smallest by ``doc_id`` (nulls last), then by its text's hash.

    Near copies have five-word shingles of Jaccard similarity 0.8 or more. Rows equal in id and
    text are copies too, and one of them stays; so does one of all texts without a word. Columns
    of any name pass through unchanged. An empty table gives none.
    """
    prints = materialize(set_prints(docs), "simhash-sets")
    labels = component_labels(similar_links(docs), "simhash").select(F.col("node").alias("set_key"), "root")
    found = prints.join(labels, "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("text_hash")))
    stands = found.groupBy("root").agg(first.alias("k")).select("k.*")
    keys = ["missing", "id", "text_hash"]
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").isNull().alias("missing"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
    )
    return keyed.join(stands, keys, "left_semi").dropDuplicates(keys).select(*[F.col(f"row.`{c}`") for c in docs.columns])
