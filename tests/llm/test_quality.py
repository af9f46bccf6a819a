import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality
from tessera.llm.common import WORD, table

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def slow_base(text):
    text = text or ""
    words = re.findall(WORD, text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    count, inside = {}, set()
    for i in range(len(words) - 2):
        count.setdefault(tuple(words[i : i + 3]), []).append(i)
    for at in count.values():
        if len(at) > 1:
            inside |= {i + k for i in at for k in range(3)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), n < 50 or 100 * len(inside) > 50 * n)


def test_base_columns_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    odd = [(9001, None), (9002, ""), (9003, "a b a b a b a b"), (9004, "é\x1c\xa0ü x\ry\n \n \n<|>" * 30), (9005, "w " * 60), (9006, "x" * 100_000), (None, "a\na\nb\x0b\nb\x0b")]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    got = quality.op4_quality_rules(docs, table(spark, sf_dir, "labels")).collect()
    want = {r.doc_id: slow_base(r.text) for r in docs.collect()}
    assert len(got) == len(want)
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == want[r.doc_id]
        assert not (r.base_failed and r.kept)


def test_held_out_accuracy(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    fitted, fresh = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    model = quality.train(docs, fitted, quality.Params(sample=300))
    rows = quality.judge(docs.join(fresh, "doc_id"), model).where("not base_failed").select("quality", "kept", "quality_score").collect()
    good = [r for r in rows if r.quality == 1]
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) / len(good) > 0.98
    assert sum(not r.kept for r in bad) / len(bad) > 0.9
    brier = np.mean([(r.quality_score - r.quality) ** 2 for r in rows])
    assert brier < 0.03


def test_reruns_agree(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    a = quality.train(docs.repartition(7), labels.repartition(3))
    b = quality.train(docs, labels)
    assert a.bias == b.bias and a.slope == b.slope and (a.weights is b.weights is None or np.array_equal(a.weights, b.weights))


def test_edge_tables(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("kept", F.lit("clash")).withColumn("good", F.lit(2)).withColumn("n_words", F.lit(1))
    labels = spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    kept = quality.keep_quality(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.op4_quality_rules(docs, labels).collect() if not r.base_failed}
    assert quality.op4_quality_rules(docs.limit(0), labels.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5])
def test_short_sequences_have_no_repeats(n):
    assert quality.repeated_window_words(np.arange(n), n) == 0


def test_a_repeated_document_does_not_swell_the_sample(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    many = docs.union(docs.where("doc_id = 0").crossJoin(spark.range(500)).drop("id"))
    a, b = quality.train(docs, labels), quality.train(many, labels)
    assert a.bias == b.bias
