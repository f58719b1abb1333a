"""What the operators share: reading tables, bytes of Arrow columns, row numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a missing identifier where one is compared: it ranks behind every other.
LAST_ID = 2**63 - 1


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def numbered(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``id``, ``text`` and ``row``, a number that tells repeated rows apart.

    The numbers follow file and row order, so every scan of a stored table gives the
    same ones.
    """
    return docs.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(text_column).cast("string").alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )


def numbered_rows(docs: DataFrame, name: str) -> DataFrame:
    """All columns and the numbers of :func:`numbered`, for joining a decision back."""
    return docs.withColumn(name, F.monotonically_increasing_id())


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its values; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if buffers[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def texts(column: pa.Array) -> Iterator[bytes]:
    """Each value in UTF-8; null is empty."""
    data, offsets = utf8(column)
    view = memoryview(data)
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield bytes(view[start:end])


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most ``most`` bytes together, one row at least."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int) -> Iterator[pa.Table]:
    """Tables of ``least`` rows or more that end where the sorted ``keys`` change.

    No group is ever cut, and no more is held than one such table and one batch.
    """
    waiting: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if rows >= least:
            cut = _first_change(waiting[-1], batch, keys)
            if cut is not None:
                if cut:
                    waiting.append(batch.slice(0, cut))
                yield pa.Table.from_batches(waiting)
                waiting, rows = [], 0
                batch = batch.slice(cut)
        waiting.append(batch)
        rows += batch.num_rows
    if waiting:
        yield pa.Table.from_batches(waiting)


def _first_change(before: pa.RecordBatch, batch: pa.RecordBatch, keys: list[str]) -> int | None:
    same = np.ones(batch.num_rows, bool)
    for key in keys:
        last = before.column(key)[-1].as_py()
        same &= batch.column(key).to_numpy(zero_copy_only=False) == last
    return None if same.all() else int(np.argmin(same))
