"""Vectorised text kernels over Arrow string batches.

A *word* is a maximal run of ``[0-9a-z]`` or non-ASCII characters in the
lower-cased text; the SQL twin is
``string_split_regex(lower(text), '[^0-9a-z\\x{80}-\\x{10FFFF}]+')`` without
empty pieces.  Null text counts as empty text everywhere.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: SQL (RE2) class of the characters between words.
WORD_GAP = r"[^0-9a-z\x{80}-\x{10FFFF}]+"
#: Bytes of text handled at once: arrays of eight bytes a character stay in cache.
SLICE_BYTES = 1 << 20

_U = np.uint64
_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[48:58] = _WORD_BYTE[97:123] = _WORD_BYTE[128:] = True
_BYTE_CODE = np.random.Generator(np.random.PCG64(20240917)).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base & (2**64 - 1), dtype=np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.cumprod(have, out=have)
        _powers[base] = have
    return have[:n]


def power(n: int) -> np.ndarray:
    return _power(_BASE, n)


def power_inverse(n: int) -> np.ndarray:
    return _power(_BASE_INV, n)


def release() -> None:
    """Gives memory that is free in this process back to the machine, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # a C library without it


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a partition's batches, then ``release``."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def buffers(column: pa.Array, end: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each followed by ``end``, and the offsets (n + 1)."""
    text = pc.fill_null(column.cast(pa.large_string()), "")
    if end:
        text = pc.binary_join_element_wise(text, pa.scalar(end.decode(), pa.large_string()), pa.scalar("", pa.large_string()))
    _, offsets, data = text.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64, count=len(text) + 1, offset=8 * text.offset)
    body = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None and len(text) else np.zeros(0, np.uint8)
    return body, offs - offs[0]


def slices(batch: pa.RecordBatch, text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``size`` bytes of text; a longer text is a run of its own."""
    n = batch.num_rows
    if not n:
        return
    length = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(length) // size
    cuts = np.flatnonzero(np.diff(group)) + 1
    edges = [0, *cuts.tolist(), n]
    for a, b in zip(edges[:-1], edges[1:]):
        yield batch.slice(a, b - a)


def lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column)


def word_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes of lower-cased text belong to words."""
    return _WORD_BYTE[data]


class Words:
    """Words of a slice: byte bounds, 64-bit hashes and each text's range of words."""

    def __init__(self, column: pa.Array, lower: bool = True):
        self.data, self.offsets = buffers(lowered(column) if lower else column)
        inside = np.zeros(len(self.data) + 1, dtype=np.int8)
        inside[1:] = _WORD_BYTE[self.data]
        edge = np.diff(inside)
        self.starts = np.flatnonzero(edge == 1)
        self.ends = np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.starts, self.offsets)

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        total = np.zeros(n + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE_CODE[self.data] * _power(_BASE, n), out=total[1:])
            raw = (total[self.ends] - total[self.starts]) * _power(_BASE_INV, n + 1)[self.starts]
            return mix(raw + (self.ends - self.starts).astype(np.uint64))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all word n-grams and each text's range (n + 1 offsets).

        A text of 1 to n - 1 words has one gram, all its words; one without words has none.
        """
        word = self.hashes()
        count = np.diff(self.first)
        grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
        offs = np.concatenate(([0], np.cumsum(grams)))
        at = np.arange(offs[-1]) - np.repeat(offs[:-1], grams) + np.repeat(self.first[:-1], grams)
        with np.errstate(over="ignore"):
            acc = np.zeros(len(at), dtype=np.uint64)
            if count.size and count.min(initial=n) >= n:
                for k in range(n):
                    acc += mix(word[at + k] + _U(k * 0x632BE59BD9B4E019 % 2**64))
            else:
                span = np.repeat(np.minimum(count, n), grams)
                for k in range(n):
                    take = k < span
                    part = word[np.where(take, at + k, 0)] if len(word) else np.zeros(len(at), np.uint64)
                    acc += np.where(take, mix(part + _U(k * 0x632BE59BD9B4E019 % 2**64)), _U(0))
        return mix(acc), offs


def code_points(column: pa.Array, end: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by ``end``, and the offsets."""
    data, offs = buffers(column, end)
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    b = data[at].astype(np.uint32)
    pad = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.uint8)
    out = b.copy()
    two, three, four = (b >= 0xC0) & (b < 0xE0), (b >= 0xE0) & (b < 0xF0), b >= 0xF0
    if two.any():
        i = at[two]
        out[two] = ((b[two] & 0x1F) << 6) | (pad[i + 1] & 0x3F)
    if three.any():
        i = at[three]
        out[three] = ((b[three] & 0x0F) << 12) | ((pad[i + 1] & 0x3F).astype(np.uint32) << 6) | (pad[i + 2] & 0x3F)
    if four.any():
        i = at[four]
        out[four] = ((b[four] & 0x07) << 18) | ((pad[i + 1] & 0x3F).astype(np.uint32) << 12) | ((pad[i + 2] & 0x3F).astype(np.uint32) << 6) | (pad[i + 3] & 0x3F)
    rank = np.concatenate(([0], np.cumsum(lead)))
    return out, rank[offs]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
