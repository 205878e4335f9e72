"""Whole-batch numpy work on the UTF-8 buffers of Arrow columns.

Nothing here loops over rows or characters: a table of 256 byte classes is
looked up for all bytes of a batch, borders are where neighbouring bytes differ
in class, and running sums with the sum at each text's start taken off count
within texts.  A byte of 128 or more is part of a longer character in UTF-8, so
classes of ASCII characters can be told byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A-Z to a-z, every other byte to itself.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each begins and the last ends; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    whole = column.buffers()[2]
    data = np.frombuffer(whole, np.uint8) if whole is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The texts that follow each other in ``data``, cut at ``offsets``; nothing is copied."""
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def words(data: np.ndarray, offsets: np.ndarray, wordy: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Longest runs of bytes that ``wordy`` marks: where each begins, how many of them lie before each text's start (and in all), the words."""
    inside = wordy[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    begins[offsets[:-1][full]] = inside[offsets[:-1][full]]
    ends[offsets[1:][full] - 1] = inside[offsets[1:][full] - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    lengths = np.zeros(len(first) + 1, np.int64)
    np.cumsum(last - first + 1, out=lengths[1:])
    return first, np.searchsorted(first, offsets), texts(data[inside], lengths)


def by_size(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows dealt anew, some ``most`` bytes of ``column`` in each batch; a longer text comes alone."""
    held, size = [], 0
    for batch in batches:
        at = 0
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            upto = max(int(np.searchsorted(ends, before + most - size, "right")), at if held else at + 1)
            if upto > at:
                held.append(batch.slice(at, upto - at))
                size += int(ends[upto - 1] - before)
            if upto < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            at = upto
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
