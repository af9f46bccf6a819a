"""Removing repeated runs of lines, found by winnowing over line hashes.

A run is a sequence of a document's lines (trimmed; blank ones don't count). It is deleted
where it has at least ``min_words`` words and the same run stands earlier, in a document with a
smaller id or further up in the same one.

1. Winnowing: in every window that starts at a line and is just long enough to have
   ``min_words`` words, the smallest line hash is selected (of equal ones the last). Every run
   long enough holds a whole window, so both of its copies select the same line of it: the
   selected lines are guaranteed fingerprints.
2. Positions are joined by fingerprint: one that is selected at a single position has no copy,
   and what lies around it drops out. Only counts are shuffled by fingerprint, never pairs.
3. Matches extend both ways from each shared fingerprint: to the windows that run forward from a
   line and those that run back from a line around it. The shortest runs that hold a given line
   and enough words are all of these two kinds, so a line lies in a repeated run if, and only
   if, one of its windows is repeated.
4. Each window's first position is kept; the lines of its later ones go. A deleted line always
   has an earlier equal line, so one copy of everything stays.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import as_bytes
from tessera.scratch import materialize

MIN_WORDS = 50
_LINES = "doc_id long, text_hash long, low array<long>, high array<long>, words array<int>, picked array<int>"


def line_hashes(text: bytes) -> tuple[list[int], list[int], list[int]]:
    """128 bits of hash, in two halves, and the words of each line that has any."""
    low, high, words = [], [], []
    for line in text.split(b"\n"):
        if n := len(line.split()):
            h = xxhash.xxh3_128_intdigest(line.strip())
            low.append(h & 0x7FFFFFFFFFFFFFFF)
            high.append(h >> 65)
            words.append(n)
    return low, high, words


def forward_ends(words: np.ndarray, least: int) -> np.ndarray:
    """For each line the end (exclusive) of the shortest window from it with ``least`` words; too few: one past all."""
    total = np.concatenate(([0], np.cumsum(words)))
    return np.searchsorted(total, total[:-1] + least, "left")


def backward_starts(words: np.ndarray, least: int) -> np.ndarray:
    """For each line the start of the shortest window up to and with it; too few: -1."""
    total = np.concatenate(([0], np.cumsum(words)))
    return np.searchsorted(total, total[1:] - least, "right") - 1


def winnow(low: list[int], ends: np.ndarray) -> list[int]:
    """The places of the windows' minima, the last of equal ones."""
    n, held, fed, picked = len(low), deque(), 0, []
    for a, b in enumerate(ends.tolist()):
        if b > n:
            break
        while fed < b:
            while held and low[held[-1]] >= low[fed]:
                held.pop()
            held.append(fed)
            fed += 1
        while held[0] < a:
            held.popleft()
        if not picked or picked[-1] != held[0]:
            picked.append(held[0])
    return picked


def _index(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        for batch in batches:
            rows = []
            for text in as_bytes(batch, "text"):
                low, high, words = line_hashes(text)
                rows.append((low, high, words, winnow(low, forward_ends(np.array(words, np.int64), min_words))))
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *columns], names=["doc_id", "text_hash", "low", "high", "words", "picked"])

    return run


_B1, _B2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd bases of the window hashes


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n + 1, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def windows_around(low: np.ndarray, high: np.ndarray, words: np.ndarray, seeds: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Start, end (exclusive) and two hashes of each forward and backward window that holds a seed."""
    n = len(words)
    ends, starts = forward_ends(words, least), backward_starts(words, least)
    a = np.concatenate((np.flatnonzero(ends <= n), starts[starts >= 0]))
    b = np.concatenate((ends[ends <= n], np.flatnonzero(starts >= 0) + 1))
    marks = np.zeros(n + 1, np.int64)
    marks[seeds + 1] = 1
    marks = np.cumsum(marks)
    near = marks[b] > marks[a]
    both = np.unique(np.stack((a[near], b[near])), axis=1)
    a, b = both[0], both[1]
    hashes = []
    for values, base in ((low, _B1), (high, _B2)):
        # the sum over a window of hash * base^(n - place), shifted to start at base^0 of its end
        power = _powers(base, n)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values.astype(np.uint64) * power[n - 1 - np.arange(n)], dtype=np.uint64)))
        inverse = _powers(pow(base, -1, 1 << 64), n)
        hashes.append(((total[b] - total[a]) * inverse[n - b]).view(np.int64))
    return a, b, hashes[0], hashes[1]


def _windows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = batch.column("doc_id"), []
            for i in range(batch.num_rows):
                low, high, words, seeds = (np.asarray(batch.column(c)[i].values) for c in ("low", "high", "words", "seeds"))
                a, b, k1, k2 = windows_around(low, high, words.astype(np.int64), np.unique(seeds), min_words)
                parts.append((np.full(len(a), i), a, b, k1, k2))
            if not parts:
                continue
            row, a, b, k1, k2 = (np.concatenate(x) for x in zip(*parts, strict=True))
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [ids.take(row), batch.column("text_hash").take(row), *[pa.array(x.astype(np.int32)) for x in (a, b)], pa.array(k1), pa.array(k2)],
                names=["doc_id", "text_hash", "a", "b", "k1", "k2"],
            )

    return run


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, text_hash, runs``: the spans of a document's counted lines that are to go."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash"))
    lines = materialize(rows.mapInArrow(_index(min_words), _LINES), "line-hashes")
    ids = [F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("missing"), "text_hash"]
    picked = lines.select(*ids, F.explode("picked").alias("place"), "low")
    picked = picked.select("id", "missing", "text_hash", "place", F.expr("low[place]").alias("hash"))
    shared = picked.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    seeds = picked.join(shared, "hash", "left_semi").groupBy("id", "missing", "text_hash").agg(F.collect_set("place").alias("seeds"))
    around = lines.select(*ids, "doc_id", "low", "high", "words").dropDuplicates(["id", "missing", "text_hash"]).join(seeds, ["id", "missing", "text_hash"])
    found = around.select("doc_id", "text_hash", "low", "high", "words", "seeds").mapInArrow(_windows(min_words), "doc_id long, text_hash long, a int, b int, k1 long, k2 long")
    found = materialize(found, "line-windows")
    at = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_hash", "a")
    first = found.groupBy("k1", "k2").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = found.join(first, ["k1", "k2"]).where(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_hash", "a") > F.col("first"))
    return later.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("a", "b")).alias("runs"))


def delete_runs(text: bytes, runs: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The text without the runs, blank lines inside them included; how many counted lines went."""
    lines = text.split(b"\n")
    counted = [i for i, line in enumerate(lines) if line and not line.isspace()]
    go, gone = set(), set()
    for a, b in runs:
        gone.update(range(a, b))
    for k in gone:
        go.add(counted[k])
        if k + 1 in gone:
            go.update(range(counted[k], counted[k + 1]))
    return b"\n".join(line for i, line in enumerate(lines) if i not in go), len(gone)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated runs deleted from ``text``, plus ``n_lines`` and ``n_removed``.

    Nulls: a null text has no lines and stays null; rows without a ``doc_id`` come after all
    others. Rows that agree in ``doc_id`` and text are one document and get equal texts; rows
    that agree in ``doc_id`` alone are ordered by their text's hash. Empty tables give none.
    Columns of ``docs`` named ``n_lines`` or ``n_removed`` are replaced.
    """
    runs = repeated_runs(docs, min_words).select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("missing"), "text_hash", "runs")
    kept = docs.drop("n_lines", "n_removed")
    # a row's own columns stay inside a struct, where no name of them can clash
    key = [F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("missing"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")]
    keyed = kept.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns if c != "text"]).alias("row"), "text", *key)
    joined = keyed.join(runs, ["id", "missing", "text_hash"], "left").select("row", "text", "runs")
    fields = joined.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, removed = batch.column("text").cast(pa.binary()).to_pylist(), [], []
            for i, spans in enumerate(batch.column("runs").to_pylist()):
                text = texts[i] or b""
                n_lines.append(sum(1 for line in text.split(b"\n") if line and not line.isspace()))
                gone = 0
                if spans:
                    texts[i], gone = delete_runs(text, [(s["a"], s["b"]) for s in spans])
                removed.append(gone)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(removed, pa.int64())],
                names=["row", "text", "n_lines", "n_removed"],
            )

    counts = [T.StructField(n, T.LongType()) for n in ("n_lines", "n_removed")]
    done = joined.mapInArrow(run, T.StructType([fields["row"], fields["text"], *counts]))
    return done.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in kept.columns], "n_lines", "n_removed")


def op1_line_dedup(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the deduplicated texts; ``n_chars`` follows where there is one."""
    done = dedup_lines(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast("long"))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])


OP1_SQL = r"""
WITH raw AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
every AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS j FROM raw),
trimmed AS (
  SELECT doc_id, j, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS t, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM every),
lines AS (
  SELECT doc_id, j, t, w, row_number() OVER d AS i, sum(w) OVER (PARTITION BY doc_id ORDER BY j) AS c, sum(w) OVER (PARTITION BY doc_id ORDER BY j) - w AS c0
  FROM trimmed WHERE w > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY j)),
spans AS (
  SELECT a.doc_id, a.i AS lo, min(b.i) AS hi FROM lines a JOIN lines b ON a.doc_id = b.doc_id AND b.c >= a.c0 + 50 AND b.i >= a.i GROUP BY 1, 2
  UNION
  SELECT b.doc_id, max(a.i) AS lo, b.i AS hi FROM lines a JOIN lines b ON a.doc_id = b.doc_id AND b.c >= a.c0 + 50 AND b.i >= a.i GROUP BY 1, 3),
runs AS (
  SELECT s.doc_id, lo, hi, string_agg(t, chr(10) ORDER BY i) AS content FROM spans s JOIN lines l ON l.doc_id = s.doc_id AND l.i BETWEEN lo AND hi GROUP BY 1, 2, 3),
later AS (SELECT doc_id, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, lo) AS k FROM runs) WHERE k > 1),
gone AS (SELECT DISTINCT l.doc_id, l.j FROM later r JOIN lines l ON l.doc_id = r.doc_id AND l.i BETWEEN r.lo AND r.hi),
marked AS (
  SELECT t.doc_id, t.j, t.line, t.w, g.j IS NOT NULL AS out FROM trimmed t LEFT JOIN gone g ON g.doc_id = t.doc_id AND g.j = t.j),
around AS (
  SELECT *, last_value(CASE WHEN w > 0 THEN out END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
    first_value(CASE WHEN w > 0 THEN out END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM marked),
kept AS (
  SELECT doc_id, count(*) FILTER (w > 0) AS n_lines, count(*) FILTER (out) AS n_removed,
    string_agg(line, chr(10) ORDER BY j) FILTER (NOT out AND NOT (w = 0 AND coalesce(before, false) AND coalesce(after, false))) AS body
  FROM around GROUP BY 1)
SELECT k.doc_id, n_lines, n_removed, CASE WHEN r.text IS NULL THEN NULL ELSE coalesce(body, '') END AS text FROM kept k JOIN raw r ON r.doc_id = k.doc_id
"""
