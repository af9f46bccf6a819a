"""The queries of this subpackage: name -> (query, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, hilbert, html_text, line_dedup, mih, mixing, phrases, pii, quality, secrets, simhash, trie, warc
from tessera.llm.common import table


def _over(make: Callable[..., DataFrame], *names: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: make(*[table(spark, sf_dir, n) for n in names])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": _over(line_dedup.op1_line_dedup, "documents"),
        "op2_warc_revisits": _over(warc.op2_warc_revisits, "pages"),
        "op3_source_mix": _over(mixing.op3_source_mix, "documents"),
        "op3_mix_positions": _over(mixing.op3_mix_positions, "documents"),
        "op4_quality_rules": _over(quality.op4_quality_rules, "documents", "labels"),
        "op5_simhash_near_dedup": _over(simhash.op5_near_duplicates, "documents"),
        "op6_bpe": _over(bpe.op6_bpe, "documents"),
        "op7_hamming_topk": _over(mih.op7_hamming_topk, "embeddings"),
        "op8_pii_spans": _over(pii.op8_pii_spans, "documents"),
        "op9_secret_scan": _over(secrets.op9_secret_scan, "documents"),
        "op10_html_text": _over(html_text.op10_html_text, "pages"),
        "op11_hilbert_neighbours": _over(hilbert.op11_hilbert_neighbours, "embeddings"),
        "op12_collocations": _over(phrases.op12_collocations, "documents"),
        "op13_prefix_trie": _over(trie.op13_prefix_trie, "conversations"),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.OP1_SQL,
        "op2_warc_revisits": warc.OP2_SQL,
        "op3_source_mix": mixing.OP3_SQL,
        "op7_hamming_topk": mih.OP7_SQL,
        "op9_secret_scan": secrets.OP9_SQL,
        "op10_html_text": html_text.OP10_SQL,
        "op12_collocations": phrases.OP12_SQL,
        "op13_prefix_trie": trie.OP13_SQL,
    }
