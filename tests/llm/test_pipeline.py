import hashlib
from collections import Counter

import numpy as np

import corpus_pipeline
from tessera.llm import bpe, quality, simhash
from tessera.llm.common import table
from tessera.scratch import materialize

from .test_bpe import want
from .test_line_dedup import slow
from .test_simhash import slow_kept


def test_stages_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        seen.append(docs.collect())
    rejected, lined, single, mixed = seen
    judged = quality.op4_quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).where("kept")
    assert {r.doc_id for r in rejected} == {r.doc_id for r in judged.collect()}
    go = {k[1]: v for k, v in slow([(r.doc_id, r.text) for r in rejected], 50).items()}
    before = {r.doc_id: r.text for r in rejected}
    for r in lined:
        full = [x for x in before[r.doc_id].split("\n") if x.split()]
        assert [x for x in r.text.split("\n") if x.split()] == [x for i, x in enumerate(full) if i not in go[r.doc_id]]
        assert r.n_chars == len(r.text)
    # the stage's rule is five-word shingles of similarity 0.8, not op5's four differing bits
    assert {r.doc_id for r in single} == (left := slow_kept([(r.doc_id, r.text) for r in lined])) and len(single) == len(left)
    assert Counter(r.doc_id for r in mixed).most_common(1)[0][1] <= 3
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in single}
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    texts = {r.doc_id: r.text for r in mixed}
    assert Counter(r.doc_id for r in tokens) == Counter(r.doc_id for r in mixed)
    for r in tokens:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want(texts[r.doc_id])
        assert hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() == r.ids_sha256


def test_run_on_whole_and_empty_tables(spark, sf_dir, tmp_path):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    for t in ("documents", "labels"):
        table(spark, sf_dir, t).limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_rows_go_through(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(60)
    twice = materialize(docs.union(docs), "twice")
    assert simhash.keep_one(twice).count() == simhash.keep_one(materialize(docs, "once")).count()
    assert bpe.op6_bpe(twice).count() == 120
