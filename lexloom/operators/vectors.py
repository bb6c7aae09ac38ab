"""Pieces of many words at once, by arrays: few merges one after another, best
segmentations position by position, and longest matches piece by piece.  The results are those of ``word_pieces``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions import chars
from .models import BPE, ByteBPE, SentencePiece, Tokenizer, Unigram, WordPiece

#: Merges up to which each of them is looked for in all words.
FEW = 64
#: Cells of the table of a trie's steps; larger tries look steps up.
CELLS = 1 << 23
#: ids, and the start and stop in the word (bytes from 0) of all pieces, and how many each word has.
Pieces = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _ordered(model: BPE, sign: str) -> bool:
    """Whether merges in the order of their ranks give the same as the lowest rank at each step, and no text can make a sign or the unknown token."""
    made: dict[str, int] = {}
    for (left, right), rank in model.ranks.items():
        made[left + right] = max(rank, made.get(left + right, rank))
    later = any(max(made.get(left, 0), made.get(right, 0)) >= rank for (left, right), rank in model.ranks.items())
    forged = any(s and (left + right).count(s) != left.count(s) + right.count(s) for s in (sign, model.unknown) for left, right in model.ranks)
    return len(model.ranks) <= FEW and not later and not forged and len(model.unknown) > 1 and model.unknown not in made and (model.end is None or len(model.end) > 1)


class _Trie:
    """Tokens by their characters: edges (node, character) -> node, and the id at a node."""

    def __init__(self, tokens: dict[str, int]):
        edges: dict[int, int] = {}
        ids = [0]
        for token, k in tokens.items():
            node = 0
            for c in token:
                node = edges.setdefault(node << 21 | ord(c), len(ids))
                if node == len(ids):
                    ids.append(0)
            ids[node] = k
        self.keys = np.array(sorted(edges), dtype=np.int64)
        self.nodes = np.array([edges[k] for k in self.keys.tolist()], dtype=np.int64)
        ids[0] = 0
        self.ids = np.array(ids, dtype=np.int32)
        # steps as a table by node and letter (0: a letter of no token)
        code = np.unique(self.keys & (1 << 21) - 1)
        self.letter = np.zeros(int(code.max(initial=0)) + 2, dtype=np.int32)
        self.letter[code] = np.arange(1, len(code) + 1)
        self.table = None
        if len(ids) * (len(code) + 1) <= CELLS:
            self.table = np.full((len(ids), len(code) + 1), -1, dtype=np.int32)
            self.table[self.keys >> 21, self.letter[self.keys & (1 << 21) - 1]] = self.nodes

    def letters(self, code: np.ndarray) -> np.ndarray:
        return self.letter[np.minimum(code, len(self.letter) - 1)]

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(node), -1)
        if self.table is not None:
            return self.table[node, self.letters(code)].astype(np.int64)
        key = node << 21 | code
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.nodes[at], -1)


def _cached(model: Tokenizer, key: str, make):
    found = model.__dict__.setdefault("arrays", {})
    if key not in found:
        found[key] = make()
    return found[key]


def signed(model: Tokenizer, words: pa.Array, mark: str = "") -> np.ndarray:
    """Which words, each of which starts with ``mark``, have a sign of the model's own: they are left to the model."""
    inner = model.inner if isinstance(model, SentencePiece) else model
    bare = pc.utf8_slice_codeunits(words, len(mark), 1 << 30) if mark else words
    out = np.zeros(len(words), dtype=bool)
    for s in {mark, model.unknown, *(getattr(m, name, None) for m in (model, inner) for name in ("marker", "end", "prefix"))}:
        if s:
            out |= pc.match_substring(bare, s).to_numpy(zero_copy_only=False)
    return out


def pieces(model: Tokenizer, words: pa.Array, mark: str = "") -> Pieces | None:
    """The pieces of words, each of which starts with ``mark``; None for models and words that this can't be done for."""
    words = words.cast(pa.string())
    if not len(words):
        return None
    inner = model.inner if isinstance(model, SentencePiece) else model
    prefix = ""
    if isinstance(inner, WordPiece):
        return None if mark or not inner.prefix or inner.unknown.startswith(inner.prefix) or signed(inner, words).any() else _greedy(inner, words)
    if isinstance(inner, Unigram):
        prefix = inner.marker
    elif isinstance(model, SentencePiece):
        prefix = model.marker
    sign = mark or prefix
    if isinstance(model, SentencePiece) and model.marker != sign or (mark and prefix) or len(sign) > 1:
        return None
    bare = pc.utf8_slice_codeunits(words, len(mark), 1 << 30) if mark else words
    if signed(model, words, mark).any():
        return None
    if prefix:
        words = pc.binary_join_element_wise(prefix, words, "")
    total = pc.binary_length(bare).to_numpy(zero_copy_only=False).astype(np.int64)
    unknown = model.token_to_id(model.unknown)
    if isinstance(inner, Unigram):
        return _best(inner, words, sign, total, unknown)
    if isinstance(inner, BPE) and _cached(inner, "ordered", lambda: _ordered(inner, inner.end or sign)):
        return _merged(inner, words, sign, total, unknown)
    return None


def body(words: pa.Array) -> np.ndarray:
    """The bytes of all words, one after another."""
    words = words.cast(pa.large_string())
    _, offsets, data = words.buffers()
    if not len(words) or data is None:
        return np.zeros(0, np.uint8)
    offs = np.frombuffer(offsets, dtype=np.int64, count=len(words) + 1, offset=8 * words.offset)
    return np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]]


def codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words, and how many each has."""
    text = body(words).tobytes().decode()
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64), pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)


def _widths(code: np.ndarray) -> np.ndarray:
    """Bytes of characters."""
    return 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)


def _longest(trie: _Trie, code: np.ndarray, ends: np.ndarray, at: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The id (0 for none) and the characters of the longest token that starts at each of these places of words that end there."""
    found, size = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
    which, node = np.arange(len(at)), np.zeros(len(at), dtype=np.int64)
    for k in range(most):
        inside = at[which] + k < ends[which]
        which, node = which[inside], node[inside]
        node = trie.step(node, code[at[which] + k])
        which, node = which[node >= 0], node[node >= 0]
        if not len(which):
            break
        ids = trie.ids[node]
        there = ids > 0
        found[which[there]], size[which[there]] = ids[there], k + 1
    return found, size


def _greedy(model: WordPiece, words: pa.Array) -> Pieces:
    unknown = model.token_to_id(model.unknown)
    ids, prefix = model.vocabulary.ids, model.prefix
    first, later = _cached(model, "tries", lambda: (_Trie(ids), _Trie({t.removeprefix(prefix): k for t, k in ids.items() if t.startswith(prefix)})))
    code, sizes = codes(words)
    total = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.concatenate(([0], np.cumsum(_widths(code))))
    stops = np.cumsum(sizes)
    here, place = np.arange(len(words)), stops - sizes
    bad = (sizes > model.most_chars) if model.most_chars > 0 else np.zeros(len(words), dtype=bool)
    here, place = here[~bad & (sizes > 0)], place[~bad & (sizes > 0)]
    parts, trie = [], first
    while len(here):
        found, size = _longest(trie, code, stops[here], place, max(model.longest, 1))
        bad[here[found == 0]] = True
        here, place, found, size = here[found > 0], place[found > 0], found[found > 0], size[found > 0]
        parts.append((here, found, upto[place + size] - upto[place]))
        place = place + size
        more = place < stops[here]
        here, place, trie = here[more], place[more], later
    word, found, size = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*parts) if parts else ((), (), ())))
    order = np.argsort(word, kind="stable")
    return _given(word[order], found[order], size[order], bad, total, unknown)


def _given(word: np.ndarray, ids: np.ndarray, size: np.ndarray, bad: np.ndarray, total: np.ndarray, unknown: int) -> Pieces:
    """Pieces with their bytes as they follow one another; a bad word is one unknown piece."""
    if bad.any():
        keep = ~bad[word]
        lost = np.flatnonzero(bad)
        word, ids, size = (np.concatenate(x) for x in ((word[keep], lost), (ids[keep], np.full(len(lost), unknown)), (size[keep], total[lost])))
        order = np.argsort(word, kind="stable")
        word, ids, size = word[order], ids[order], size[order]
    ends = np.cumsum(size)
    first = np.searchsorted(word, np.arange(len(total)))
    base = np.concatenate(([0], ends))[first][word]
    return ids.astype(np.int32), ends - size - base, ends - base, np.bincount(word, minlength=len(total))


def _merged(model: BPE, words: pa.Array, sign: str, total: np.ndarray, unknown: int) -> Pieces:
    from .training import _joined

    if isinstance(model, ByteBPE):
        symbol = body(words).astype(np.int32)
        sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        names = list(chars.BYTE_CHAR)
    else:
        code, sizes = codes(words)
        seen = np.zeros(int(code.max(initial=0)) + 1, dtype=bool)
        seen[code] = True
        found = np.flatnonzero(seen)
        symbol = (np.cumsum(seen, dtype=np.int32) - 1)[code]
        names = [chr(c) for c in found.tolist()]
    word = np.repeat(np.arange(len(sizes)), sizes)
    if model.end is not None:
        names.append(model.end)
        stops = np.cumsum(sizes)
        symbol, word = np.insert(symbol, stops, len(names) - 1), np.insert(word, stops, np.arange(len(sizes)))
    number = {t: k for k, t in enumerate(names)}
    steps = []
    for left, right in sorted(model.ranks, key=model.ranks.get):
        if left in number and right in number:
            if left + right not in number:
                number[left + right] = len(names)
                names.append(left + right)
            steps.append((number[left], number[right], number[left + right]))
    symbol, word = _joined(symbol, word, steps)
    ids = np.array([model.vocabulary.ids.get(t, 0) for t in names], dtype=np.int64)[symbol]
    clean = [t.replace(model.end or sign, "") if model.end or sign else t for t in names]
    size = np.array([len(t) if isinstance(model, ByteBPE) else chars.byte_length(t) for t in clean], dtype=np.int64)[symbol]
    bad = np.zeros(len(total), dtype=bool)
    bad[word[ids == 0]] = True
    return _given(word, ids, size, bad, total, unknown)


def _best(model: Unigram, words: pa.Array, sign: str, total: np.ndarray, unknown: int) -> Pieces:
    trie, longest = _cached(model, "trie", lambda: _Trie(model.vocabulary.ids)), max(model.longest, 1)
    scores = _cached(model, "scores", lambda: np.array([0.0, *model.scores]))
    code, sizes = codes(words)
    ends = np.cumsum(sizes)
    word = np.repeat(np.arange(len(sizes)), sizes)
    # words from the longest to the shortest: the first so many have a letter at a position, and lie one after another there
    order = np.argsort(-sizes, kind="stable")
    most = int(sizes.max(initial=0))
    wide = np.searchsorted(-sizes[order], -np.arange(most), side="left")
    first = np.concatenate(([0], np.cumsum(wide)))
    token = [np.zeros(len(code), dtype=np.int32) for _ in range(longest)]
    rank = np.zeros(len(sizes), dtype=np.int64)
    rank[order] = np.arange(len(sizes))
    spot = first[np.arange(len(code)) - np.repeat(ends - sizes, sizes)] + rank[word]
    at, node = np.arange(len(code)), np.zeros(len(code), dtype=np.int64)
    for k in range(longest):
        inside = at + k < ends[word[at]]
        at, node = at[inside], node[inside]
        node = trie.step(node, code[at + k])
        at, node = at[node >= 0], node[node >= 0]
        if not len(at):
            break
        token[k][spot[at]] = trie.ids[node]
    scores = np.concatenate(([-np.inf], scores[1:]))
    # the best sum up to each position (of all words that reach it), the letters of its last piece and the piece
    sums: list[np.ndarray] = [np.zeros(len(sizes))]
    back, which = np.zeros(len(code), dtype=np.int32), np.zeros(len(code), dtype=np.int32)
    total_sum = np.zeros(len(sizes))
    for i in range(1, most + 1):
        n = wide[i - 1]
        best, size, piece = np.full(n, -np.inf), np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
        # of equal sums the longest last piece
        for k in range(min(longest, i), 0, -1):
            t = token[k - 1][first[i - k] : first[i - k] + n]
            if k > 1 and not t.any():
                continue
            sum_ = sums[i - k][:n] + scores[t]
            more = sum_ > best
            best = np.where(more, sum_, best)
            size[more] = k
            np.copyto(piece, t, where=more)
        back[first[i - 1] : first[i]], which[first[i - 1] : first[i]] = size, piece
        done = wide[i] if i < most else 0
        total_sum[order[done:n]] = best[done:]
        sums.append(best)
        if i >= longest:
            sums[i - longest] = sums[0][:0]
    bad = ~np.isfinite(total_sum)
    back, which = back[spot], which[spot]
    used = np.zeros(len(code), dtype=bool)
    here = np.flatnonzero(~bad & (sizes > 0))
    # the last letter of each piece
    place, base = ends[here] - 1, (ends - sizes)[here]
    while len(here):
        used[place] = True
        place = place - back[place]
        open_ = place >= base
        here, place, base = here[open_], place[open_], base[open_]
    letter = np.flatnonzero(used)
    width = _widths(code)
    if sign:
        width[code == ord(sign)] = 0
    upto = np.concatenate(([0], np.cumsum(width)))
    return _given(word[letter], which[letter], upto[letter + 1] - upto[letter + 1 - back[letter]], bad, total, unknown)
