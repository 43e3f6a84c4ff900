"""Helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.shared import shared_dir, staged
from vitrine.workers import let_workers_import

__all__ = ["SLICE_BYTES", "WORD", "join_checked", "let_workers_import", "read", "shared_dir", "slices", "staged", "text_buffers"]

#: A word, in every operator that counts words: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Python works through a batch in slices of about this many bytes of text, so memory doesn't follow the batch.
SLICE_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def join_checked(df: DataFrame, small: DataFrame, on: list[str], how: str = "left", max_rows: int = 50_000) -> DataFrame:
    """Broadcasts `small` if a count shows max_rows rows at most; beyond that it is an ordinary shuffled join, which AQE splits where a key is hot."""
    fits = small.limit(max_rows + 1).count() <= max_rows
    return df.join(F.broadcast(small) if fits else small.hint("merge"), on, how)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data, offsets


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts come to about `most` bytes; one longer text is a run of its own."""
    _, offsets = text_buffers(batch.column(text))
    start = 0
    while start < len(batch):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end
