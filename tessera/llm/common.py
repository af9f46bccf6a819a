"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    return [v or b"" for v in batch.column(name).cast(pa.binary()).to_pylist()]


def as_text(batch: pa.RecordBatch, name: str) -> list[str]:
    """A string column; null is empty."""
    return [v or "" for v in batch.column(name).to_pylist()]


def text_slices(batch: pa.RecordBatch, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``size`` bytes of text, a longer text alone: what is held at once stays bounded."""
    length = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(length) - length) // size
    cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
    for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def replace_column(batch: pa.RecordBatch, name: str, values: list, kind: pa.DataType) -> pa.RecordBatch:
    i = batch.schema.get_field_index(name)
    return batch.set_column(i, pa.field(name, kind), pa.array(values, kind))


def add_columns(df: DataFrame, schema: str, make: Callable[[pa.RecordBatch], list[tuple[list, pa.DataType]]]) -> DataFrame:
    """``df`` plus the columns of ``schema`` that ``make`` derives from each Arrow batch.

    A column of ``df`` that has the name of a new one is replaced.
    """
    new = T._parse_datatype_string(schema)
    names = [f.name for f in new]
    kept = df.drop(*names)
    out = T.StructType([*kept.schema.fields, *new.fields])
    lower = {n.lower() for n in names}
    assert not lower & {c.lower() for c in kept.columns}, "a new column clashes with one in another case"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [pa.array(v, t) for v, t in make(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    return kept.mapInArrow(run, out)


def order_id(name: str) -> Column:
    """An id as a value that sorts nulls last."""
    return F.struct(F.col(name).isNull().alias("missing"), F.col(name).alias("id"))


def hashed_share(h: Column, share: float) -> Column:
    """Whether a 64-bit hash lies in the first ``share`` of its range: the same rows in every run, found without a sort."""
    return F.lit(True) if share >= 1 else h < F.lit(int((2 * share - 1) * (1 << 63))).cast("long")
