"""Helpers for text columns inside Arrow batches and for materialised intermediate tables."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from churnforge.session import cut_lineage

#: Texts are worked on in slices of about this many bytes, so that a task's memory does not follow the batch size.
SLICE_BYTES = 4 << 20


def materialise(df: DataFrame) -> DataFrame:
    """Compute once into the shared checkpoint folder; files go when the frame is no longer referenced."""
    return cut_lineage(df)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as the empty text. offsets has one entry more than rows."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows of about `limit` text bytes (one row at least)."""
    _, offsets = utf8(batch.column(text))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(batch.num_rows, max(start + 1, end))
        yield batch.slice(start, end - start)
        start = end


def give_back() -> None:
    """Return freed memory to the system: Python workers live on from stage to stage, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):                       # another C library keeps its own ways
        pass


def texts(column: pa.Array) -> list[str]:
    return pc.fill_null(column, "").to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64); arithmetic wraps around."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def held_out(id_col: str) -> Column:
    """Documents that no model may learn from: crc32 of the id as text leaves 1 modulo 3 (a null id does not)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def bounded_share(id_col: str, share: Column, seed: int) -> Column:
    """True for about `share` of the ids, the same ones in every run (a null id counts as one id)."""
    cell = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(seed)), F.lit(1_000_003))
    return cell < share * 1_000_003
