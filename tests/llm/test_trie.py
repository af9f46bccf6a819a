"""The trie against a dictionary of prefixes."""

import hashlib
import math
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import trie
from tessera.llm.common import table

from .oracle import same


def test_query_against_sql(spark, sf_dir):
    same(trie.op13_prefix_trie(table(spark, sf_dir, "conversations")), sf_dir, trie.OP13_SQL)


def brute(rows):
    """Nodes of the rebuilt conversations as tuples in the order of the result's columns."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append(c)
        ends.setdefault(whole, []).append(c)
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        saved[k] = (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0) + sum(saved[x] for x in kids.get(k, []))
        leaves[k] = sum(leaves[x] for x in kids.get(k, [])) or 1
    return sorted(
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()) for k, m in members.items()
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def result(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def made(n, seed):
    """Few texts, so that turns, prefixes and whole conversations recur; a third of all are one conversation."""
    rows = []
    for c in range(n):
        x = zlib.crc32(f"{seed}/{c}".encode())
        same_turns = x % 3 == 0
        for t in range(3 if same_turns else x // 7 % 7):
            v = 0 if same_turns else zlib.crc32(f"{seed}/{c}/{t}".encode()) % (2 if t < 4 else 5)
            rows.append((c, None if t == 0 and x % 2 else t, "user" if t % 2 else None, f"text é {v}" if v else None))
    return rows


@pytest.mark.parametrize(("n", "partitions", "fan"), [(1, 3, 2), (60, 1, 4), (400, 7, 2), (400, 40, 3), (900, 16, 256)])
def test_against_brute_force(spark, n, partitions, fan):
    rows = made(n, f"{n}-{partitions}")
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    assert result(trie.prefix_trie(trie.rebuilt(df), partitions, fan)) == brute(rows)


def test_equal_conversations_over_many_partitions(spark):
    """Families of one shape only: each conversation with h = 0 or its family's own is the same everywhere."""
    rows = [(c, t, "user", f"w{t}") for c in range(0, 1500, 5) for t in range(4)] + [(3, 0, "user", "w0"), (11, 5, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert result(trie.prefix_trie(trie.rebuilt(df), 9, 2)) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "x"), (0, 1, "user", "b"), (0, None, "user", "a"), (0, 2, None, None), (0, 2, None, None), (7, 0, "", ""), (-3, 0, "user", "n" * 100_000), (9, 30, "system", "long")]
    rows += [(20, t, "user", f"t{t}") for t in range(3000)] + [(22, t, "user", f"t{t}") for t in range(2500)] + [(25, t, "user", f"t{t}") for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"depth": F.lit("x"), "seq": F.lit(1), "family": F.lit(2)})
    for partitions in (1, 4):
        assert result(trie.prefix_trie(trie.rebuilt(df), partitions, 2)) == brute(rows)
    assert result(trie.op13_prefix_trie(df.limit(0))) == []
