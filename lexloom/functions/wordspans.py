"""Words of Arrow texts with their spans of bytes, by array operations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The white space beyond ASCII (see ``chars``), as bytes of UTF-8.
_WIDE = [bytes(chr(c), "utf-8") for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)]
_ASCII = np.zeros(256, dtype=bool)
_ASCII[9:14] = _ASCII[32] = True


def space_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 belong to white space."""
    out = _ASCII[data]
    if len(data) and data.max() > 127:
        for code in _WIDE:
            lead = np.flatnonzero(data[: len(data) - len(code) + 1] == code[0])
            for k in range(1, len(code)):
                lead = lead[data[lead + k] == code[k]]
            for k in range(len(code)):
                out[lead + k] = True
    return out


def word_spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row, start and stop (bytes from 1, half open) and text of each word, in order; null texts have none."""
    text = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, body = text.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64, count=len(text) + 1, offset=8 * text.offset)
    data = np.frombuffer(body, dtype=np.uint8)[offs[0] : offs[-1]] if body is not None and len(text) else np.zeros(0, np.uint8)
    offs = offs - offs[0]
    inside = ~space_bytes(data)
    # a word ends where its text does
    fresh = np.zeros(len(data) + 1, dtype=bool)
    fresh[offs] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | fresh[:-1]))
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    stops = np.flatnonzero(inside & (~after | fresh[1:])) + 1
    row = np.searchsorted(offs, starts, side="right") - 1
    sizes = np.concatenate(([0], np.cumsum(stops - starts))).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(sizes.tobytes()), pa.py_buffer(data[inside].tobytes()))
    base = offs[row]
    return row, starts - base + 1, stops - base + 1, words.cast(pa.string())
