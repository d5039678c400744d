"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import ship, written  # noqa: F401  (written is for the operators)

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes up to which a side is broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_if_small(df: DataFrame, bytes_of: Column) -> DataFrame:
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(bytes_of), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def release() -> None:
    """Gives a worker's free memory back: workers live on, and the next stage's need theirs."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    """mapInArrow, with this package on the workers, which keep no memory of a task."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        release()

    ship(df.sparkSession)
    return df.mapInArrow(lean, schema)


SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of texts, lower-cased; each word's place among them; and n + 1 offsets of the texts' words."""
    if not len(raw):
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~SEPARATOR[raw]
    cut = np.zeros(len(raw) + 1, dtype=bool)
    cut[offsets] = True
    starts = np.flatnonzero(word & (cut[:-1] | np.concatenate([[True], ~word[:-1]])))
    stops = np.flatnonzero(word & (cut[1:] | np.concatenate([~word[1:], [True]]))) + 1
    compact = LOWER[raw[word]]
    ends = np.concatenate([[0], np.cumsum(stops - starts)])
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(compact)]).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.searchsorted(starts, offsets)


def crc_mod(column: str, n: int) -> Column:
    """crc32(column as text) mod n; null where the column is null."""
    return F.crc32(F.col(column).cast("string")) % F.lit(n)


def ascii_lower(column: Column) -> Column:
    return F.translate(column, ASCII_UPPER, ASCII_LOWER)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and n + 1 byte offsets; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(offsets) else raw[:0], offsets - (offsets[0] if len(offsets) else 0)


def chunks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each; a longer text stands alone."""
    n, start = len(offsets) - 1, 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
        yield start, min(end, n)
        start = min(end, n)


def code_points(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts one after another, and how many each text has."""
    cps = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return cps, np.diff(heads[offsets])
