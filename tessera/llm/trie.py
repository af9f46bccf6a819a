"""The prefix trie of conversations, from their sorted order.

Conversations are sorted by their turns. What two share is told by neighbours: the depth of their longest common
prefix (LCP) is an edge, and joining edges by union-find from the deepest up gives the trie, for each merge of
components at a depth is the node of that depth. A node's members are a run of the order, so its counts are sums
over the run: of one a conversation, of leaves, and of the bytes of the prefixes its edges share.

The order is cut by range. Each partition joins its own edges, returns the nodes that reach neither of its ends, and
contracts the rest, the nodes around its first and its last conversation, to fragments: as many as the two have
branching prefixes, whatever the partition holds. Adjacent contracted forests are merged the same way, ``fan`` at a
time, with the edges across their boundaries, until one is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.scratch import materialize

#: Bytes of a turn's digest: a prefix of SHA-256.
WIDTH = 16
#: A conversation is replaced by its family's first in its first turns: families of so many ids, so many turns at most.
FAMILY, TURNS = 5, 8
NO_ENDS = hashlib.sha256(b"").hexdigest()
#: Ids in a piece of the list of conversations that end at a node.
PIECE = 50_000


def turn_digest(role: Column, text: Column) -> Column:
    """Tells a turn (role, text) from any other, as 32 hexadecimal digits."""
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256).substr(1, 2 * WIDTH)


def rebuilt(turns: DataFrame) -> DataFrame:
    """``conv_id, seq, sizes`` of every rebuilt conversation: the digests of its turns, joined, and the bytes of their texts.

    The first h turns of conversation c - c % 5 stand for the first h of c, with h = crc32(decimal c) % 9. A turn is
    24 bytes here; texts stay where they are read. Rows without ``conv_id`` take no part; turns of equal number are in the
    order of their digests; repeated rows are turns of their own; further columns are ignored.
    """
    c = F.col("conv_id").cast("long")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    t = turns.where("conv_id is not null").select(c.alias("conv_id"), (c - c % FAMILY).alias("family"), F.struct(F.col("turn").alias("turn"), turn_digest(role, text).alias("d"), F.octet_length(text).cast("long").alias("b")).alias("x"))
    # one shuffle, by family: it also holds for grouping by conversation and for the family's window
    own = t.repartition("family").groupBy("family", "conv_id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: F.struct(x["d"], x["b"])).alias("x"))
    first = F.max(F.when(F.col("conv_id") == F.col("family"), F.slice("x", 1, TURNS))).over(Window.partitionBy("family"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (TURNS + 1)).cast("int")
    rest = F.when(h < F.size("x"), F.slice("x", h + 1, F.greatest(F.size("x") - h, F.lit(1)))).otherwise(F.slice("x", 1, 0))
    head = F.coalesce(F.slice(F.col("first"), F.lit(1), h), F.slice("x", 1, 0))
    x = own.withColumn("first", first).select("conv_id", F.concat(head, rest).alias("x"))
    return x.select("conv_id", F.unhex(F.array_join(F.transform("x", lambda v: v["d"]), "")).alias("seq"), F.transform("x", lambda v: v["b"]).alias("sizes"))


def shared(a: bytes, b: bytes) -> int:
    """How many first turns two sequences share."""
    n = min(len(a), len(b)) // WIDTH
    if a[: n * WIDTH] == b[: n * WIDTH]:
        return n
    low, high = 0, n - 1  # the first ``low`` are shared, those up to ``high`` may be
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * WIDTH : mid * WIDTH] == b[low * WIDTH : mid * WIDTH]:
            low = mid
        else:
            high = mid - 1
    return low


def prefix_key(seq: bytes, depth: int) -> bytes:
    return hashlib.sha256(seq[: depth * WIDTH]).digest()[:WIDTH]


@dataclass(slots=True)
class Node:
    """A node, or the fragment of one: what of its members lies in a run of the order."""

    depth: int
    n: int
    least: int | None  # its smallest member
    shared: int  # bytes of the prefixes that neighbours among its members share
    leaves: int
    kids: int
    rep: int  # a row or sequence that begins with it
    a: int  # first and last item of the run
    b: int
    ids: list[int] | None = None
    children: list[Node] = field(default_factory=list)

    def take(self, other: Node) -> None:
        self.n += other.n
        self.shared += other.shared
        self.leaves += other.leaves
        if self.least is None or other.least is not None and other.least < self.least:
            self.least = other.least
        if self.ids is not None and other.ids:
            self.ids += other.ids
        self.a, self.b = min(self.a, other.a), max(self.b, other.b)


def join_edges(items: list[Node], depth: list[int], weight: list[int], leaf: list[int]) -> Node:
    """The top node once all edges between neighbouring items are joined, the deepest first.

    ``weight``: the bytes that an edge's neighbours share; ``leaf``: -1 where the left one ends inside the right one.
    """
    up = list(range(len(items)))
    tops = list(items)

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for e in sorted(range(len(depth)), key=lambda e: -depth[e]):
        x, y = find(e), find(e + 1)
        left, right = tops[x], tops[y]
        d = depth[e]
        if left.depth == d and right.depth == d:
            left.kids += right.kids
            left.children += right.children
            left.take(right)
            top = left
        elif left.depth == d or right.depth == d:
            top, child = (left, right) if left.depth == d else (right, left)
            top.kids += 1
            top.children.append(child)
            ids, child.ids = child.ids, None
            top.take(child)
            child.ids = ids
        else:
            top = Node(d, left.n + right.n, min((v for v in (left.least, right.least) if v is not None), default=None), left.shared + right.shared, left.leaves + right.leaves, 2, left.rep, left.a, right.b, None if left.ids is None else [], [left, right])
        top.shared += weight[e]
        top.leaves += leaf[e]
        up[y] = x
        tops[x] = top
    return tops[find(0)]


def spine(top: Node, first: int, last: int) -> tuple[list[Node], set[int]]:
    """The contracted forest, left to right: fragments of the nodes that reach the first or last item; and which nodes those are."""
    opened: set[int] = set()

    def fragment(node: Node, inner: list[Node]) -> Node:
        opened.add(id(node))
        least = node.least  # of all its members: it counts once at least, and more often does no harm
        return Node(node.depth, node.n - sum(c.n for c in inner), least, node.shared - sum(c.shared for c in inner), node.leaves - sum(c.leaves for c in inner), node.kids - len(inner), node.rep, 0, 0)

    def down(node: Node, edge: int, left: bool) -> list[Node]:
        """Fragments from the deepest up."""
        path = [node]
        while inner := next((c for c in path[-1].children if (c.a if left else c.b) == edge), None):
            path.append(inner)
        return [fragment(v, path[i + 1 : i + 2]) for i, v in reversed(list(enumerate(path)))]

    left = next((c for c in top.children if c.a == first), None)
    right = next((c for c in top.children if c.b == last), None)
    ends = [c for c in (left, right) if c is not None]
    return [*(down(left, first, True) if left else []), fragment(top, ends), *(down(right, last, False)[::-1] if right else [])], opened


ROW = "kind string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, key binary, parent_key binary"
ITEM = "array<struct<depth:long,n:long,least:long,shared:long,leaves:long,kids:long,last:boolean>>"
FOREST = f"place long, first_seq binary, first_bytes array<long>, last_seq binary, last_bytes array<long>, items {ITEM}"
PART = f"{ROW}, {FOREST}, piece string"
NAMES = [x.split()[0] for x in f"{ROW}, place long, first_seq binary, first_bytes b, last_seq b, last_bytes b, items i, piece s".split(", ")]
ARROW = [
    pa.string(), *[pa.int64()] * 7, pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()),
    pa.list_(pa.struct([*[(k, pa.int64()) for k in ("depth", "n", "least", "shared", "leaves", "kids")], ("last", pa.bool_())])), pa.string(),
]


class Out:
    """Rows of PART by kind, in batches of bounded size."""

    def __init__(self) -> None:
        self.columns: dict[str, list] = {n: [] for n in NAMES}

    def add(self, **row) -> None:
        for n in NAMES:
            self.columns[n].append(row.get(n))

    def full(self) -> bool:
        return len(self.columns["kind"]) >= 20_000

    def batch(self) -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(self.columns[n], t) for n, t in zip(NAMES, ARROW, strict=True)], names=NAMES)
        self.columns = {n: [] for n in NAMES}
        return made


def ends_digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


def closed_rows(out: Out, top: Node, opened: set[int], seq: list[bytes], held: list[np.ndarray], keyed: bool) -> Iterator[pa.RecordBatch]:
    """A row for each depth of the nodes not in ``opened``, with what their parents are known by."""
    walk: list[tuple[Node, Node | None]] = [(top, None)]
    while walk:
        node, parent = walk.pop()
        walk += [(c, node) for c in node.children]
        if id(node) in opened:
            continue
        above = -1 if parent is None else parent.depth
        known = parent is not None and id(parent) not in opened
        for d in range(node.depth, above, -1):
            end = d == node.depth
            up = None if d == 0 else node.least if d > above + 1 else parent.least if known else None
            lost = d == above + 1 and parent is not None and not known
            out.add(
                kind="node", conv_id=node.least, depth=d, parent_conv_id=up, n_convs=node.n, n_children=node.kids if end else 1, n_leaves=node.leaves,
                saved_tokens=node.shared - (node.n - 1) * (int(held[node.rep][d - 2]) if d > 1 else 0), ends_sha256=None if keyed and end else ends_digest(node.ids or []) if end else NO_ENDS,
                key=prefix_key(seq[node.rep], d) if keyed and end else None, parent_key=prefix_key(seq[node.rep], above) if lost else None,
            )
            if out.full():
                yield out.batch()


def contract(out: Out, place: int, items: list[Node], seq: list[bytes], held: list[np.ndarray], top: Node, keyed: bool) -> Iterator[pa.RecordBatch]:
    """Returns the closed nodes, the contracted forest and, of the nodes that stay open, the conversations that end there."""
    kept, opened = spine(top, 0, len(items) - 1)
    yield from closed_rows(out, top, opened, seq, held, keyed)
    if not keyed:
        walk = [top]
        while walk:
            node = walk.pop()
            if id(node) in opened:
                walk += node.children
                ids = sorted(node.ids or [])
                for i in range(0, len(ids), PIECE):
                    out.add(kind="ends", place=place, depth=i, key=prefix_key(seq[node.rep], node.depth), piece=",".join(map(str, ids[i : i + PIECE])))
    low = min(range(len(kept)), key=lambda i: kept[i].depth)
    out.add(
        kind="forest", place=place, first_seq=seq[0], first_bytes=held[0].tolist(), last_seq=seq[-1], last_bytes=held[-1].tolist(),
        items=[{"depth": v.depth, "n": v.n, "least": v.least, "shared": v.shared, "leaves": v.leaves, "kids": v.kids, "last": i > low} for i, v in enumerate(kept)],
    )
    yield out.batch()


def partition_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted rows of a partition: ``place, conv_id, seq, sizes``."""
    place, ids, seq, held = 0, [], [], []
    for batch in batches:
        if batch.num_rows:
            place = batch.column("place")[0].as_py()
        ids += batch.column("conv_id").to_pylist()
        seq += batch.column("seq").to_pylist()
        sizes = batch.column("sizes")
        flat, cuts = sizes.flatten().to_numpy(), sizes.offsets.to_numpy()
        held += [np.cumsum(flat[a - cuts[0] : b - cuts[0]]) for a, b in zip(cuts, cuts[1:], strict=False)]
    if not ids:
        return
    rows = [Node(len(s) // WIDTH, 1, i, 0, 1, 0, k, k, k, [i]) for k, (i, s) in enumerate(zip(ids, seq, strict=True))]
    depth = [shared(a, b) for a, b in zip(seq, seq[1:], strict=False)]
    weight = [int(held[k][d - 1]) if d else 0 for k, d in enumerate(depth)]
    leaf = [-(d == r.depth) for d, r in zip(depth, rows, strict=False)]
    yield from contract(Out(), place, rows, seq, held, join_edges(rows, depth, weight, leaf), keyed=False)


def merged_forest(final: bool):
    """Adjacent contracted forests as one; the last of all closes every node, the root included."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["place"])
        seq = [r[f"{side}_seq"] for r in rows for side in ("first", "last")]
        held = [np.array(r[f"{side}_bytes"], np.int64) for r in rows for side in ("first", "last")]
        items, depth, weight, leaf = [], [], [], []
        for k, r in enumerate(rows):
            if k:
                d = shared(seq[2 * k - 1], seq[2 * k])
                depth.append(d)
                weight.append(int(held[2 * k][d - 1]) if d else 0)
                leaf.append(-(d == len(seq[2 * k - 1]) // WIDTH))
            for i, v in enumerate(r["items"]):
                if i:
                    depth.append(min(v["depth"], items[-1].depth))
                    weight.append(0)
                    leaf.append(0)
                items.append(Node(v["depth"], v["n"], v["least"], v["shared"], v["leaves"], v["kids"], 2 * k + v["last"], len(items), len(items)))
        top = join_edges(items, depth, weight, leaf)
        out = Out()
        if final:
            if top.depth:  # the root has one child and no end
                top = Node(0, top.n, top.least, top.shared, top.leaves, 1, top.rep, top.a, top.b, None, [top])
            parts = [*closed_rows(out, top, set(), seq, held, keyed=True), out.batch()]
        else:
            parts = list(contract(out, key[0].as_py(), items, seq, held, top, keyed=True))
        return pa.Table.from_batches(parts)

    return run


def hashed_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each key's pieces, which come one after the other."""
    at, digest, keys, made = None, None, [], []
    for batch in batches:
        for key, piece in zip(batch.column("key").to_pylist(), batch.column("piece").to_pylist(), strict=True):
            if key == at:
                digest.update(b"," + piece.encode())
            else:
                if at is not None:
                    keys.append(at)
                    made.append(digest.hexdigest())
                at, digest = key, hashlib.sha256(piece.encode())
    if at is not None:
        keys.append(at)
        made.append(digest.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(made, pa.string())], names=["key", "ends"])


def prefix_trie(conversations: DataFrame, partitions: int | None = None, fan: int = 256) -> DataFrame:
    """A row for each node of the trie of ``conversations(conv_id, seq, sizes)``, see ``rebuilt``.

    ``conv_id`` its smallest member, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` (over its subtree each node's (n_convs - 1) times its last text's bytes) and ``ends_sha256`` of the
    conversations that end there. Conversations without turns are members of the root alone; equal ones share all
    nodes; without any conversation there are no rows.

    The order is by sequence and id, so equal conversations spread over partitions too. ``partitions`` is that of
    Spark's shuffles unless given; ``fan`` forests meet in a task.
    """
    spark = conversations.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = conversations.select("conv_id", "seq", "sizes").repartitionByRange(n, "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    ordered = ordered.select(F.spark_partition_id().cast("long").alias("place"), "conv_id", "seq", "sizes")
    made = materialize(ordered.mapInArrow(partition_forest, PART), "trie-parts")
    names = [x.split()[0] for x in ROW.split(", ")]
    forest = [x.split()[0] for x in FOREST.split(", ")]
    parts, forests = [made.where("kind = 'node'").select(names)], made.where("kind = 'forest'").select(forest)
    pieces = made.where("kind = 'ends'").select("key", "place", "depth", "piece")
    closed = []
    size = n
    while True:
        final = size <= fan
        step = materialize(forests.groupBy(F.floor(F.col("place") / fan).cast("long").alias("group")).applyInArrow(merged_forest(final), PART), "trie-merged")
        closed.append(step.where("kind = 'node'").select(names))
        if final:
            break
        forests = step.where("kind = 'forest'").select(forest)
        size = -(-size // fan)
    tall = closed[0]
    for more in closed[1:]:
        tall = tall.unionByName(more)
    ends = pieces.repartition("key").sortWithinPartitions("key", "place", "depth").select("key", "piece").mapInArrow(hashed_pieces, "key binary, ends string")
    tall = materialize(tall.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", "ends", F.lit(NO_ENDS))).select(names), "trie-open")
    by_key = tall.where("key is not null").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent"))
    rows = parts[0].unionByName(tall)
    found = rows.where("parent_key is not null").join(by_key, "parent_key", "left").withColumn("parent_conv_id", F.col("parent")).select(names)
    return rows.where("parent_key is null").unionByName(found).select([c for c in names if c not in ("kind", "key", "parent_key")])


def op13_prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all rebuilt conversations; odd rows: see ``rebuilt`` and ``prefix_trie``."""
    return prefix_trie(rebuilt(conversations))


_CRC = """CAST(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [CAST(1000 + ascii(x) AS UBIGINT), 0, 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, x: CASE WHEN x >= 1000 THEN xor(a, CAST(x - 1000 AS UBIGINT)) WHEN a % 2 = 1 THEN xor(a // 2, CAST(3988292384 AS UBIGINT)) ELSE a // 2 END) AS UBIGINT)"""
OP13_SQL = f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x, octet_length(encode(coalesce(text, ''))) AS b
  FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, xor({_CRC}, CAST(4294967295 AS UBIGINT)) % 9 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT h.c, t.i, t.x, t.b FROM h JOIN t ON t.c = h.c - h.c % 5 AND t.i <= h.h UNION ALL SELECT h.c, t.i, t.x, t.b FROM h JOIN t ON t.c = h.c AND t.i > h.h),
g AS (SELECT c, list(x ORDER BY i) AS s, list(b ORDER BY i) AS b FROM r GROUP BY 1),
a AS (SELECT h.c, coalesce(s, []) AS s, coalesce(b, []) AS b FROM h LEFT JOIN g ON g.c = h.c),
m AS (SELECT c, d, sha256(array_to_string(s[1:d], ',')) AS k, CASE WHEN d > 0 THEN sha256(array_to_string(s[1:d-1], ',')) END AS p, CASE WHEN d > 0 THEN b[d] ELSE 0 END AS b, d = len(s) AS ends FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM a)),
n AS (SELECT d, k, any_value(p) AS p, min(c) AS conv_id, count(*) AS n, (count(*) - 1) * any_value(b) AS saved, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends FROM m GROUP BY d, k),
q AS (SELECT n.*, u.conv_id AS parent_conv_id, (SELECT count(*) FROM n z WHERE z.d = n.d + 1 AND z.p = n.k) AS kids FROM n LEFT JOIN n u ON u.d = n.d - 1 AND u.k = n.p),
s AS (SELECT m.d, m.k, w.d AS wd, w.k AS wk FROM m JOIN m w ON w.c = m.c AND w.d >= m.d GROUP BY ALL),
o AS (SELECT s.d, s.k, sum(w.saved) AS saved, sum((w.kids = 0)::INT) AS leaves FROM s JOIN q w ON w.d = s.wd AND w.k = s.wk GROUP BY 1, 2)
SELECT q.conv_id, CAST(q.d AS BIGINT) AS depth, q.parent_conv_id, q.n AS n_convs, q.kids AS n_children, CAST(o.leaves AS BIGINT) AS n_leaves, CAST(o.saved AS BIGINT) AS saved_tokens, q.ends AS ends_sha256
FROM q JOIN o ON o.d = q.d AND o.k = q.k
"""
