from pyspark.sql import functions as F

from tessera.llm import warc
from tessera.llm.common import table
from tessera.scratch import scratch_path

from .oracle import same


def test_query_against_sql(spark, sf_dir):
    same(warc.op2_warc_revisits(table(spark, sf_dir, "pages")), sf_dir, warc.OP2_SQL)


def test_edge_rows(spark):
    odd = "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\nContent-Length: 5\r\n\r\né" + "x" * 200_000
    rows = [(3, "u\r\nX: y", odd), (1, None, odd), (2, "u", None), (5, "u", ""), (None, "u", ""), (7, "a", "b"), (7, "a", "b")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).withColumn("row", F.lit(0))
    got = sorted(map(tuple, warc.op2_warc_revisits(pages).collect()), key=str)
    assert [(r[0], r[1], r[3], r[4]) for r in got] == sorted(
        [(1, len(odd.encode()), "response", None), (3, len(odd.encode()), "revisit", 1), (2, 0, "response", None), (5, 0, "revisit", 2), (None, 0, "revisit", 2), (7, 1, "response", None), (7, 1, "revisit", 7)], key=str
    )
    assert warc.op2_warc_revisits(pages.limit(0)).count() == 0


def test_payloads_survive_a_rewrite(spark):
    rows = [(i, f"http://h/{i}", "same" if i % 3 else f"p{i}\r\n\r\n") for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, uri string, payload string")
    a, b = scratch_path(spark, "a"), scratch_path(spark, "b")
    warc.write_archives(warc.resolve(pages, min_bytes=10**6), a, records_per_file=3)
    assert warc.read_archives(spark, a).where("record_type = 'response'").count() == 20
    warc.dedup_archives(spark, a, b)
    back = warc.read_archives(spark, b)
    assert back.where("record_type = 'response'").count() == 8
    full = warc.join_revisits(back)
    assert {(r.page_id, r.payload_bytes) for r in full.collect()} == {(i, len(p)) for i, _, p in rows}
    assert sorted(r.payload for r in back.where("payload is not null").collect()) == sorted({p for *_, p in rows})
