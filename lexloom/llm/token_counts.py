"""Token counts of a byte-level BPE vocabulary, without making any identifier.

A piece of text (as the vocabulary's pattern splits it) starts as a linked list
of its bytes, with a heap of the adjacent pairs that have a rank.  The pair of
lowest rank (the leftmost of equals) is popped and merged while there is one;
entries whose symbols have since changed are skipped.  The count is the initial
symbols minus the merges, summed over the pieces.

Each Python worker remembers the counts of pieces it has seen, in two
generations of bounded size, so memory doesn't grow with the corpus; a
forgotten piece is counted again, with the same result.

Defined cases: null and empty texts have 0 tokens (and 0 bytes); rows are
counted one by one, so repeated rows and ids repeat; texts of any length are
counted whole; other columns are dropped, whatever their names.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import textkit as tk

#: Splits text into the pieces within which pairs merge.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces remembered in one generation; a longer piece than REMEMBER_BYTES isn't kept.
REMEMBER, REMEMBER_BYTES = 150_000, 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}


def count_piece(piece: bytes, ranks: dict[bytes, int]) -> int:
    """Symbols left of one piece after all merges."""
    n = len(piece)
    if n < 2 or piece in ranks:
        return min(n, 1)
    # a heap entry is rank * n + position: one integer, ordered by rank and then from the left
    get = ranks.get
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    parts.append(None)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [r * n + i for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapify(heap)
    left_over = n
    while heap:
        rank, i = divmod(heappop(heap), n)
        left = parts[i]
        if left is None:
            continue
        j = after[i]
        right = parts[j]
        if right is None or get(left + right) != rank:
            continue
        parts[i] = left = left + right
        parts[j] = None
        left_over -= 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := get(left + parts[k])) is not None:
                heappush(heap, r * n + i)
        if (h := before[i]) >= 0 and (r := get(parts[h] + left)) is not None:
            heappush(heap, r * n + h)
    return left_over


class Counter(dict):
    """piece -> count, with a younger and an older generation."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.older = ranks, {}

    def __missing__(self, piece: bytes) -> int:
        count = self.older.get(piece)
        if count is None:
            count = count_piece(piece, self.ranks)
        if len(piece) <= REMEMBER_BYTES:
            if len(self) >= REMEMBER:
                self.older = dict(self)
                self.clear()
            self[piece] = count
        return count


_loaded: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The vocabulary's counter of this worker."""
    if path not in _loaded:
        _loaded[path] = Counter(load_ranks(path))
    return _loaded[path]


# Classes of code points below 0x250 for the default pattern: 0 space, 1 letter, 2 number, 3 other.
_KIND = np.array([0 if chr(c).isspace() and not 0x1C <= c <= 0x1F else {"L": 1, "N": 2}.get(unicodedata.category(chr(c))[0], 3) for c in range(0x250)], dtype=np.int8)


def piece_starts(points: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where the pieces of PATTERN start, for texts of code points below 0x250 that follow each other without gaps."""
    n = len(points)
    kind = _KIND[points]
    first = np.zeros(n + 1, dtype=bool)
    first[offs] = True  # also marks the end
    change = np.ones(n, dtype=bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= first[:n]
    space = kind == 0
    # the last of a run of white space that is followed by something else in the same text stands alone, or joins what follows if it is a blank
    last = np.zeros(n, dtype=bool)
    last[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    start = change | last
    joined = np.zeros(n, dtype=bool)
    joined[1:] = last[:-1] & (points[:-1] == 32)
    start &= ~joined
    # contractions, where an apostrophe starts a piece
    for i in np.flatnonzero((points == 39) & start).tolist():
        tail = points[i + 1 : i + 3]
        if (first[i + 1 : i + 3]).any():
            tail = tail[: int(np.argmax(first[i + 1 : i + 3]))]
        t = "".join(map(chr, tail.tolist()))
        size = 2 if t[:1] in ("s", "t", "m", "d") and t else 3 if t in ("re", "ve", "ll") else 0
        if size:
            start[i + 1 : i + size] = False
            if i + size < n:
                start[i + size] = True
                # what follows starts anew: a lone blank there still joins its successor
                if last[i + size] and points[i + size] == 32 and i + size + 1 < n:
                    start[i + size + 1] = False
    return np.flatnonzero(start)


def count_slice(texts: pa.Array, count: Counter) -> np.ndarray:
    """Tokens of each text, for the default pattern."""
    points, offs = tk.code_points(texts, b"")
    out = np.zeros(len(texts), dtype=np.int64)
    size = np.diff(offs)
    strange = np.zeros(len(points) + 1, dtype=np.int64)
    np.cumsum(points >= 0x250, out=strange[1:])
    slow = strange[offs[1:]] > strange[offs[:-1]]
    for i in np.flatnonzero(slow).tolist():
        out[i] = sum(count[p.encode()] for p in splitter(PATTERN)(texts[i].as_py()))
    points = points[np.repeat(~slow, size)]
    offs = np.concatenate(([0], np.cumsum(size[~slow])))
    if not len(points):
        return out
    starts = piece_starts(points, offs)
    ends = np.append(starts[1:], len(points))
    total = np.zeros(len(points) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(tk.mix(points.astype(np.uint64) + np.uint64(1)) * tk.power(len(points)), out=total[1:])
        key = tk.mix((total[ends] - total[starts]) * tk.power_inverse(len(points) + 1)[starts] + (ends - starts).astype(np.uint64))
    _, at, back = np.unique(key, return_index=True, return_inverse=True)
    text = points.astype("<u4").tobytes().decode("utf-32-le")
    counts = np.array([count[text[a:b].encode()] for a, b in zip(starts[at].tolist(), ends[at].tolist())], dtype=np.int64)
    sums = np.concatenate(([0], np.cumsum(counts[back])))
    edge = np.searchsorted(starts, offs)
    out[~slow] = sums[edge[1:]] - sums[edge[:-1]]
    return out


def splitter(pattern: str):
    import regex

    return regex.compile(pattern).findall


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``id_col``, n_bytes and n_tokens of each text; ``vocabulary`` is a rank file that every executor can read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for batch in batches:
            for part in tk.slices(batch, batch.schema.names[1]):
                texts = pc.fill_null(part.column(1), "")
                if pattern == PATTERN:
                    tokens = count_slice(texts, count)
                else:
                    tokens = [sum(count[p.encode()] for p in splitter(pattern)(x.as_py())) for x in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(tokens, pa.int64())], names=[batch.schema.names[0], "n_bytes", "n_tokens"])

    return df.select(df[id_col].cast("bigint"), df[text_col].cast("string")).mapInArrow(tk.tidy(run), f"`{id_col}` bigint, n_bytes bigint, n_tokens bigint")
