import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import line_dedup
from tessera.llm.common import table


def slow(rows, least):
    """Every pair of equal lines, extended both ways: the lines of the later copy that go."""
    at = {}
    docs = sorted({(d is None, d or 0, t or "") for d, t in rows}, key=lambda r: r[:2])
    lines = {d: [x.strip().encode() for x in d[2].split("\n") if x.split()] for d in docs}
    go = {d: set() for d in docs}
    places = [(d, i) for d in docs for i in range(len(lines[d]))]
    for p, (d, i) in enumerate(places):
        at.setdefault(lines[d][i], []).append(p)
    for same in at.values():
        for y, p in enumerate(same):
            for q in same[:y]:
                (d, i), (e, j) = places[p], places[q]
                a = 0
                while i - a > 0 and j - a > 0 and lines[d][i - a - 1] == lines[e][j - a - 1]:
                    a += 1
                b = 1
                while i + b < len(lines[d]) and j + b < len(lines[e]) and lines[d][i + b] == lines[e][j + b]:
                    b += 1
                if sum(len(x.split()) for x in lines[d][i - a : i + b]) >= least:
                    go[d].update(range(i - a, i + b))
    return go


def check(spark, rows, least):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    go = slow(rows, least)
    got = line_dedup.dedup_lines(docs, least).collect()
    assert len(got) == len(rows)
    texts = {(d is None, d or 0): t for d, t in rows}
    for r in got:
        key = next(k for k in go if k[:2] == (r.doc_id is None, r.doc_id or 0))
        assert r.n_removed == len(go[key]), (r.doc_id, go[key])
        left = [x for x in (r.text or "").split("\n") if x.split()]
        full = [x for x in (texts[key[:2]] or "").split("\n") if x.split()]
        assert left == [x for i, x in enumerate(full) if i not in go[key]]


@pytest.mark.parametrize("seed", range(4))
def test_against_all_pairs(spark, seed):
    rng = np.random.default_rng(seed)
    pool = [" ".join(f"w{rng.integers(0, 30)}" for _ in range(int(rng.integers(1, 9)))) for _ in range(14)]
    rows = []
    for d in range(30):
        lines = [pool[int(i)] if rng.random() < 0.8 else f"only {d} {k}" for k, i in enumerate(rng.integers(0, len(pool), int(rng.integers(0, 20))))]
        if rows and rng.random() < 0.5:
            other = (rows[int(rng.integers(0, len(rows)))][1] or "").split("\n")
            a = int(rng.integers(0, len(other)))
            lines[3:3] = other[a : a + 7]
        rows.append((d, "\n".join("  " + x + "\r" if rng.random() < 0.1 else x for x in lines) if lines else None))
    check(spark, rows, 12)


def test_documents_against_all_pairs(spark, sf_dir):
    rows = [(r[0], r[1]) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    check(spark, rows, line_dedup.MIN_WORDS)


def test_a_passage_in_many_documents_stays_once(spark):
    passage = " ".join(f"p{i}" for i in range(51))
    rows = [(i, f"head {i}\n\n{passage}\ntail {i}") for i in range(40)]
    got = line_dedup.op1_line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.doc_id for r in got if passage in r.text] == [0]
    assert all(f"tail {r.doc_id}" in r.text for r in got)


def test_edge_rows(spark):
    long = " ".join(f"x{i}" for i in range(20_000))
    rows = [(1, long), (1, long), (2, long), (None, "a\n" + long), (3, None), (4, ""), (5, "\n\n"), (6, "a b c\n" * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_lines": F.lit("clash"), "low": F.lit(1), "n_chars": F.lit(0)})
    got = {(r.doc_id, r.n_removed) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {(1, 0), (2, 1), (None, 1), (3, 0), (4, 0), (5, 0), (6, 23 + 16)}
    assert line_dedup.without_repeats(docs).columns == docs.columns
    assert line_dedup.op1_line_dedup(docs.limit(0)).count() == 0


def test_query_against_sql(spark, sf_dir):
    from .oracle import same

    same(line_dedup.op1_line_dedup(table(spark, sf_dir, "documents")), sf_dir, line_dedup.OP1_SQL)


def test_columns_of_any_name_stay(spark):
    line = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, line, "mine"), (2, line + "\nmore", "yours")], "doc_id long, text string, x string")
    names = ["__run_id", "__run_missing", "__run_text", "id", "missing", "text_hash", "runs", "row"]
    got = line_dedup.dedup_lines(docs.withColumns({n: F.col("x") for n in names})).orderBy("doc_id").collect()
    assert [[r[n] for n in names] for r in got] == [["mine"] * 8, ["yours"] * 8]
    assert [r.text for r in got] == [line, "more"]
