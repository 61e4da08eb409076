"""Vectorised helpers over Arrow text columns, used inside Spark tasks.

A batch of texts is cut into slices of bounded bytes; each slice is one flat UTF-8 buffer on which
words, lines and shingles are found with numpy, for all its documents at once. Null texts are
empty. A single text may exceed the bound; it is then a slice of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

#: ASCII white space: 0x09-0x0D and 0x20.
_INSIDE = bytes(c not in b" \t\n\v\f\r" for c in range(256))
_LOWER = bytes(range(256)).lower()


def _give_back() -> None:
    """Return freed memory to the system, so that workers that wait for tasks stay small."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


class Flat:
    """The texts of consecutive rows in one buffer; row i is ``data[offs[i]:offs[i + 1]]``."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs, self.n = data, offs, len(offs) - 1

    def lower(self) -> Flat:
        """A-Z in lower case, other characters as they are."""
        return Flat(np.frombuffer(self.data.tobytes().translate(_LOWER), np.uint8), self.offs)

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of ``inside`` bytes; no run spans two rows."""
        size = len(self.data)
        if not size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = self.offs[1:-1]
        edges = edges[edges < size]
        first[edges] = inside[edges]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        last[edges[edges > 0] - 1] = inside[edges[edges > 0] - 1]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def words(self) -> Words:
        inside = np.frombuffer(self.data.tobytes().translate(_INSIDE), bool)
        starts, ends = self.runs(inside)
        return Words(self, starts, ends, self.data[inside])

    def row_of(self, starts: np.ndarray) -> np.ndarray:
        """The row in which each byte position lies."""
        return np.searchsorted(self.offs, starts, side="right") - 1

    def code_points(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Code points in each byte range."""
        heads = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80, dtype=np.int64)])
        return heads[ends] - heads[starts]


class Words:
    """Words in text order: byte ranges, the row bounds ``at`` (row i has words at[i]:at[i + 1])."""

    def __init__(self, flat: Flat, starts: np.ndarray, ends: np.ndarray, packed: np.ndarray):
        self.flat, self.starts, self.ends, self.packed = flat, starts, ends, packed
        self.at = np.searchsorted(starts, flat.offs)
        self.counts = np.diff(self.at)

    def __len__(self) -> int:
        return len(self.starts)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.flat.n), self.counts)

    def encode(self) -> tuple[np.ndarray, pa.Array]:
        """A code for each word, and the distinct words in the order of their codes."""
        return encode(self.packed, self.ends - self.starts)


def encode(packed: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Dictionary-encode strings that lie end to end in ``packed``."""
    offs = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offs[1:])
    strings = pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(packed)))
    coded = strings.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all members of the given ranges, range by range."""
    if not len(lengths):
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)


def flat_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, Flat]]:
    """(first row, row after the last, texts) for slices of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    offs = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, side="right")) - 1)
        b = min(b, len(column))
        yield a, b, Flat(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
        a = b
    _give_back()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
