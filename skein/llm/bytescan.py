"""Texts of Arrow batches as one array of UTF-8 bytes, for passes that handle all bytes of a batch at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a pass holds at once; a longer text is a part of its own.
PART_BYTES = 4 << 20

_WHITE_BYTES = bytes([9, 10, 11, 12, 13, 32])
#: Whether a byte is ASCII white space: x20, x09 to x0D.
WHITE = np.zeros(256, np.bool_)
WHITE[list(_WHITE_BYTES)] = True


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows, from 0) and bytes of a string column; null is the empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, at, held = column.buffers()
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(at, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(held, np.uint8, at[-1] - at[0], at[0]) if held is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return at - at[0], data


def string_array(offsets: np.ndarray, data: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The string column of these offsets and bytes; rows that ``valid`` denies are null."""
    mask = None if valid is None or valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little"))
    at = pa.py_buffer(offsets.astype(np.int32))
    return pa.StringArray.from_buffers(len(offsets) - 1, at, pa.py_buffer(data), mask, -1 if mask is not None else 0)


def parts(batch: pa.RecordBatch, column: str, size: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts have ``size`` bytes together, or one text that is longer."""
    at, _ = text_bytes(batch.column(column))
    k = 0
    while k < batch.num_rows:
        end = max(k + 1, int(np.searchsorted(at, at[k] + size, "right")) - 1)
        yield batch.slice(k, end - k)
        k = end


def word_ends(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The place behind the last byte of every word, in order; words don't cross texts."""
    white = WHITE[data]
    last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    end = ~white
    end[:-1] &= white[1:]
    end[last] = ~white[last]
    return np.flatnonzero(end) + 1


def range_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` from each bound up to the next; bounds ascend and may repeat, the last is the end of ``values``."""
    sums = np.add.reduceat(np.append(values, values.dtype.type(0)), bounds[:-1], dtype=np.int64)
    sums[bounds[:-1] == bounds[1:]] = 0  # for an empty range reduceat takes its first value
    return sums
