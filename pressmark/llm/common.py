"""Helpers shared by the operators: tables, settled intermediate results, typed Arrow output."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shared_folder

SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later steps start from files every executor sees."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, although the body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``limit`` text bytes, so that memory follows the slice and not the batch."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    start = size = 0
    for i, value in enumerate(sizes.to_pylist()):
        if size and size + value > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += value
    yield batch.slice(start)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
