"""WARC archives with revisit records: resolve by payload digest, write, read back.

Archives are written and read by Spark alone, so any store that Spark reaches will do. A
record is text (its payload is UTF-8), and the writer's line separator is the pair of line
ends that closes a record. Reading goes by each record's Content-Length, so a payload may hold
anything, record headers included.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.scratch import materialize, scratch_path

# Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

READ_SCHEMA = (
    "page_id long, uri string, date string, record_type string, payload_digest string, "
    "content_length long, payload string, actual_bytes long, actual_digest string"
)


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a string's UTF-8 bytes: each five hex digits are four letters."""
    hexed, letters, chars = F.sha1(payload), F.lit(BASE32), []
    for group in range(8):
        value = F.conv(F.substring(hexed, group * 5 + 1, 5), 16, 10).cast("int")
        chars += [F.substr(letters, F.shiftright(value, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*chars)


def with_rows(records: DataFrame) -> DataFrame:
    """``records`` plus ``file, row``, which tell rows apart and come out alike whenever they are evaluated.

    A scan of files has them; anything else is written as a table first, so that a task that runs
    again, or a second branch of the plan, can't number its rows otherwise.
    """
    try:
        return records.select("*", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        return materialize(records.select("*", F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row")), "warc-rows")


def resolve(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to`` and the rows that tell records apart.

    ``records``: ``page_id long, uri string, payload string``. Of records with equal payloads
    of at least ``min_bytes`` the one with the smallest ``page_id`` (nulls last; of repeated
    ids one row) is the response and the others revisit it. Only headers are shuffled by digest,
    a row for each digest and task; payloads meet the verdicts by row, so a payload that any
    number of pages share is no large group. A null payload is empty; a null ``page_id`` that
    becomes a response is referred to by null. An empty table gives none.
    """
    rows = with_rows(records.select("page_id", "uri", F.coalesce("payload", F.lit("")).alias("payload")))
    heads = rows.select("page_id", "file", "row", F.octet_length("payload").cast("long").alias("payload_bytes"), payload_digest(F.col("payload")).alias("payload_digest"))
    heads = materialize(heads, "warc-heads")
    key = F.struct(F.col("page_id").isNull().alias("missing"), "page_id", "file", "row")
    first = heads.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min(key).alias("first"))
    joined = heads.join(first, "payload_digest", "left")
    revisit = F.col("first").isNotNull() & ~((F.col("first.file") == F.col("file")) & (F.col("first.row") == F.col("row")))
    told = joined.select(
        "file", "row", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first.page_id")).alias("refers_to"), F.when(revisit, F.struct("first.file", "first.row")).alias("refers_to_row"),
    )
    return rows.join(told, ["file", "row"]).select("page_id", "uri", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "row", "refers_to_row")


def _record(date: str) -> Column:
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("\r\n"))
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[\\x00-\\x1f\\x7f]", "")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    urn = lambda *parts: F.concat_ws(":", F.lit("<urn:page"), *map(text, parts[:-1]), F.concat(text(parts[-1]), F.lit(">")))
    is_revisit = F.col("record_type") == "revisit"
    http = F.concat(line("HTTP/1.1 200 OK"), line("Content-Type: text/html; charset=utf-8"), line("Content-Length: ", F.col("payload_bytes").cast("string")), F.lit("\r\n"))
    block = F.when(is_revisit, http).otherwise(F.concat(http, F.col("payload")))
    refer = F.when(is_revisit, F.concat(line("WARC-Refers-To: ", urn("refers_to", "refers_to_row.file", "refers_to_row.row")), line("WARC-Profile: ", REVISIT_PROFILE))).otherwise("")
    head = F.concat(
        line(VERSION), line("WARC-Type: ", F.col("record_type")), line("WARC-Record-ID: ", urn("page_id", "file", "row")),
        line("WARC-Target-URI: ", clean(F.col("uri"))), line(f"WARC-Date: {date}"), line("WARC-Payload-Digest: sha1:", F.col("payload_digest")),
        refer, line("Content-Type: application/http; msgtype=response"), line("Content-Length: ", F.octet_length(block).cast("string")), F.lit("\r\n"),
    )
    return F.concat(head, block)


def write_archives(resolved: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 1000) -> None:
    """Gzipped archives of at most ``records_per_file`` records each, with fresh headers."""
    out = resolved.select(_record(date).alias("value"))
    out.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse_archive(content: bytes) -> Iterator[dict]:
    """The records of one archive, gzipped (in one stream or many) or not, one at a time."""
    raw = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    stream = io.BufferedReader(raw)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:60]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            head[name.strip().lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        http, _, payload = block.partition(b"\r\n\r\n")
        length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        number = re.fullmatch(r"<urn:page:(-?\d+)(?::.*)?>", head.get("warc-record-id", ""))
        response = head["warc-type"] == "response"
        yield {
            "page_id": int(number[1]) if number else None, "uri": head.get("warc-target-uri"), "date": head.get("warc-date"), "record_type": head["warc-type"],
            "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None, "content_length": int(length[1]) if length else None,
            "payload": payload.decode() if response else None, "actual_bytes": len(payload) if response else None,
            "actual_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode() if response else None,
        }


def read_archives(spark: SparkSession, path: str, payloads: bool = True, batch: int = 1000) -> DataFrame:
    """The records of all archives under ``path``; a response's length and digest are those of its bytes.

    ``payloads``: without them only what headers need leaves the tasks that read.
    """
    names = [f.split()[0] for f in READ_SCHEMA.split(", ") if payloads or f.split()[0] != "payload"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                held: list[dict] = []
                for record in parse_archive(content):
                    held.append({k: record[k] for k in names})
                    if len(held) == batch:
                        yield pd.DataFrame(held, columns=names)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, ", ".join(f for f in READ_SCHEMA.split(", ") if f.split()[0] in names))


def join_revisits(records: DataFrame) -> DataFrame:
    """Each record with the length and digest of the payload it stands for and the response it refers to.

    Revisits find their response by payload digest; one without a response keeps what its own
    headers say and refers to nothing. Only headers are shuffled, and the archives are read once.
    """
    heads = records.select("page_id", "uri", "record_type", "payload_digest", "content_length", "actual_bytes", "actual_digest")
    own = heads.where("record_type <> 'revisit'").select(
        "page_id", "uri", "record_type", F.col("actual_bytes").alias("payload_bytes"), F.col("actual_digest").alias("payload_digest"), F.lit(None).cast("long").alias("refers_to")
    )
    origin = heads.where("record_type = 'response'").groupBy(F.col("actual_digest").alias("origin")).agg(F.min(F.struct(F.col("page_id").isNull().alias("missing"), "page_id", "actual_bytes")).alias("o"))
    later = heads.where("record_type = 'revisit'").join(origin, F.col("payload_digest") == F.col("origin"), "left")
    later = later.select(
        "page_id", "uri", "record_type", F.coalesce("o.actual_bytes", "content_length").alias("payload_bytes"), "payload_digest", F.col("o.page_id").alias("refers_to")
    )
    return own.unionByName(later)


def dedup_archives(spark: SparkSession, source: str, target: str, min_bytes: int = 0) -> None:
    """Rewrite the archives of ``source`` into ``target`` with revisit records for repeated payloads.

    Revisits already in ``source`` get back the payload of the response that they refer to first.
    """
    records = read_archives(spark, source)
    origin = records.where("record_type = 'response'").groupBy(F.col("actual_digest").alias("origin")).agg(F.min("payload").alias("found"))
    full = records.join(origin, F.col("payload_digest") == F.col("origin"), "left")
    full = full.select("page_id", "uri", F.coalesce("payload", "found").alias("payload"))
    write_archives(resolve(full, min_bytes), target)


def op2_warc_revisits(pages: DataFrame) -> DataFrame:
    """Archives of all ``pages`` written to the shared folder and read back, one row a page; odd rows: see ``resolve``."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    records = pages.select("page_id", F.col("url").alias("uri"), F.col("html").alias("payload"))
    write_archives(resolve(records), path)
    back = join_revisits(materialize(read_archives(spark, path, payloads=False), "warc-read"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (
  SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha1(body) AS hx FROM p),
f AS (
  SELECT hx, list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((CAST('0x' || substr(hx, CAST((i // 4) * 5 + 1 AS INT), 5) AS INT) >> CAST((3 - i % 4) * 5 AS INT)) & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
    min(page_id) AS low
  FROM (SELECT hx, page_id FROM d) GROUP BY hx)
SELECT d.page_id, d.payload_bytes, f.payload_digest,
  CASE WHEN d.page_id = f.low THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN d.page_id = f.low THEN NULL ELSE f.low END AS refers_to
FROM d JOIN f ON d.hx = f.hx
"""
