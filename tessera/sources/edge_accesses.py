"""Accesses of edges as an append-only log in files, read as a stream with an offset for each tenant.

A commit is a folder ``commit=<n>`` that holds ``silo_id=<tenant>/part-*.parquet`` and counts once its ``_SUCCESS`` is there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


SCHEMA = "silo_id string, edge_id string, src long, dst long, edge_type string, context string, ts timestamp"


def with_edge_id(accesses: DataFrame) -> DataFrame:
    """An edge's id is that of its unordered pair of nodes and its type, whichever way it was walked."""
    x, y = F.least("src", "dst").cast("string"), F.greatest("src", "dst").cast("string")
    return accesses.withColumn("edge_id", F.sha2(F.concat_ws("|", "edge_type", x, y), 256))


def append_commit(accesses: DataFrame, path: str, number: int) -> None:
    """Write accesses (``silo_id, src, dst, edge_type, context, ts``) as a commit. Writing a number again replaces that commit."""
    rows = with_edge_id(accesses).select(F.col("silo_id").cast("string"), "edge_id", "src", "dst", "edge_type", "context", F.col("ts").cast("timestamp"))
    rows.where("silo_id is not null").write.mode("overwrite").partitionBy("silo_id").parquet(f"{path}/commit={number:012d}")


@dataclass
class _Part(InputPartition):
    silo: str
    file: str


class EdgeAccessReader(DataSourceStreamReader):
    """An offset is, for each tenant, the last commit read of it; a tenant that is new starts before its first."""

    def __init__(self, path: str, silos: set[str] | None) -> None:
        self.path, self.silos = path, silos

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def _commits(self) -> Iterator[tuple[int, str, list[str]]]:
        """Number, tenant and files of each tenant's part of each finished commit that this reader is for."""
        store, root = self._open()
        for c in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            number = re.fullmatch(r"commit=(\d+)", c.base_name)
            if not number or store.get_file_info(f"{c.path}/_SUCCESS").type == fs.FileType.NotFound:
                continue
            for t in store.get_file_info(fs.FileSelector(c.path)):
                silo = t.base_name.removeprefix("silo_id=")
                if silo != t.base_name and (self.silos is None or silo in self.silos):
                    yield int(number[1]), silo, sorted(f.path for f in store.get_file_info(fs.FileSelector(t.path)) if f.base_name.endswith(".parquet"))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        last: dict[str, int] = {}
        for number, silo, _ in self._commits():
            last[silo] = max(number, last.get(silo, -1))
        return last

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        new = [(n, silo, files) for n, silo, files in self._commits() if start.get(silo, -1) < n <= end.get(silo, -1)]
        return [_Part(silo, f) for _, silo, files in sorted(new) for f in files]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        store, _ = self._open()
        for batch in pq.ParquetFile(store.open_input_file(partition.file)).iter_batches():
            silo = pa.array([partition.silo] * batch.num_rows, pa.string())
            ts = batch.column("ts").cast(pa.timestamp("us", "UTC"))
            columns = [silo, *[batch.column(c) for c in ("edge_id", "src", "dst", "edge_type", "context")], ts]
            yield pa.RecordBatch.from_arrays(columns, names=["silo_id", "edge_id", "src", "dst", "edge_type", "context", "ts"])


class EdgeAccessSource(DataSource):
    """Options: ``path``, and ``silos`` (comma-separated; default all)."""

    @classmethod
    def name(cls) -> str:
        return "edge_accesses"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> EdgeAccessReader:
        silos = self.options.get("silos")
        return EdgeAccessReader(self.options["path"], set(silos.split(",")) if silos else None)


def edge_access_source(spark: SparkSession, path: str, silos: list[str] | None = None) -> DataFrame:
    """A stream of the log's accesses. The query's checkpoint is the cursor of every tenant: a restarted query reads nothing twice.

    ``path`` is local or any URI that Arrow opens. No log yet, a commit without ``_SUCCESS`` and one without a tenant's rows give nothing.
    """
    spark.dataSource.register(EdgeAccessSource)
    reader = spark.readStream.format("edge_accesses").option("path", path)
    return (reader.option("silos", ",".join(silos)) if silos else reader).load()
