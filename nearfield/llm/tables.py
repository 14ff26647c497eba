"""Tables that workers fill side by side and Spark adds up: dense counts, slice by slice, and bitmaps of hashes."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE = 1 << 16
_SCHEMA = "slice long, data binary"


def add_up(rows: DataFrame, size: int, begin: Callable[[], tuple[Callable[[np.ndarray, pa.RecordBatch], None], Callable[[np.ndarray], None]]]) -> np.ndarray:
    """The sum over all tasks of a table of `size` 64-bit counts.

    begin() is called in each task: it gives fill(table, batch), which adds a batch to its task's table, and
    finish(table). A task sends only slices that aren't all zero, compressed, as they are mostly zeros; slices are added by
    the executors, and the driver gets one table.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(-(-size // SLICE) * SLICE, np.int64)
        fill, finish = begin()
        for batch in batches:
            fill(table, batch)
        finish(table)
        own = table.reshape(-1, SLICE)
        for k in np.flatnonzero(own.any(axis=1)):
            yield pa.record_batch([pa.array([k], pa.int64()), pa.array([zlib.compress(own[k].tobytes(), 1)], pa.binary())], ["slice", "data"])

    def total(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(SLICE, np.int64)
        for batch in batches:
            for data in batch.column("data"):
                out += np.frombuffer(zlib.decompress(data.as_buffer()), np.int64)
        yield pa.record_batch([pa.array([key[0].as_py()], pa.int64()), pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())], ["slice", "data"])

    summed = rows.mapInArrow(count, _SCHEMA).groupBy("slice").applyInArrow(total, _SCHEMA)
    table = np.zeros(-(-size // SLICE) * SLICE, np.int64)
    for row in summed.select("slice", "data").toLocalIterator():
        table[row["slice"] * SLICE : (row["slice"] + 1) * SLICE] = np.frombuffer(zlib.decompress(row["data"]), np.int64)
    return table[:size]


def bitmap(hashes: DataFrame, size: int) -> np.ndarray:
    """A bit for each h of hashes, gathered as words of 64 bits: size / 64 rows at most, however many hashes there are."""
    got = (
        hashes.select(F.expr(f"shiftrightunsigned(h, 6) & {size // 64 - 1}L").alias("k"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
        .groupBy("k").agg(F.bit_or("bit").alias("bits")).toArrow()
    )
    table = np.zeros(size // 64, np.uint64)
    table[got.column("k").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return table


def in_bitmap(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes have their bit: all that the bitmap was made of, and a few others."""
    return (table[(h >> np.uint64(6)) & np.uint64(len(table) - 1)] >> (h & np.uint64(63)) & np.uint64(1)).astype(bool)
