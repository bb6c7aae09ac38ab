"""The tokenizer families: pure functions of a text over an immutable model.

No Spark here: models are sent to executors once and used inside Arrow batches by
``encode``.  Every family splits a text at white space and memoises the pieces of
a word; a word with a symbol that the vocabulary lacks is one unknown token.
Offsets are UTF-8 bytes, from 1, half open.
"""

from __future__ import annotations

import math
from functools import cached_property

import pyarrow as pa

from ..functions import chars
from .vocabulary import Vocabulary

Span = tuple[int, int]
#: Words remembered by a model in one process; then they are forgotten.  Longer ones aren't remembered.
MEMO, MEMO_CHARS = 100_000, 64


class Memo(dict):
    """key -> make(key), emptied when full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[key] = value
        return value


class Tokenizer:
    """What all families share."""

    format = ""
    #: Roles put before and after a text by ``encode(add_special_tokens=True)``.
    wrap = ("bos", "eos")

    def __init__(self, vocabulary: Vocabulary, name: str, version: str = "0.2.0"):
        self.vocabulary, self.name, self.version = vocabulary, name, version

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("memo", "id_memo", "span_memo", "names", "longest", "arrays")}

    @cached_property
    def memo(self) -> Memo:
        return Memo(self.word_pieces)

    @cached_property
    def id_memo(self) -> Memo:
        return Memo(lambda word: [self.token_to_id(p) for p in self.word_pieces(word)])

    @cached_property
    def span_memo(self) -> Memo:
        """Starts and stops, from 0 and one after another, of a word's pieces; None if they can't be told."""

        def make(word: str) -> list[int] | None:
            spans = self.word_spans(word, self.word_pieces(word), 0)
            return None if spans is None else [x for s in spans for x in s]

        return Memo(make)

    @cached_property
    def names(self) -> pa.Array:
        """The token of each id, from id 1."""
        return pa.array([self.id_to_token(i) for i in range(1, self.vocab_size() + 1)], pa.string())

    @cached_property
    def longest(self) -> int:
        """Characters of the longest token."""
        return max(map(len, self.vocabulary.tokens), default=0)

    def __call__(self, text: str) -> list[str]:
        return self.tokenize(text)

    def word_pieces(self, word: str) -> list[str]:
        raise NotImplementedError

    def normalize(self, text: str) -> str:
        return text

    needs_normalization = False

    def tokenize(self, text: str) -> list[str]:
        memo = self.memo
        return [p for w in chars.words(text) for p in memo[w]]

    def encode(self, text: str, add_special_tokens: bool = False, assume_normalized: bool = False) -> list[int]:
        ids = [self.token_to_id(p) for p in self.tokenize(text)]
        return self.wrapped(ids) if add_special_tokens else ids

    def wrapped(self, ids: list[int]) -> list[int]:
        before, after = (self.role_id(r) for r in self.wrap)
        return [*([before] if before is not None else []), *ids, *([after] if after is not None else [])]

    def kept(self, ids) -> list[str]:
        skip = self.vocabulary.skipped
        return [self.id_to_token(i) for i in ids if i not in skip]

    def decode(self, ids) -> str:
        raise NotImplementedError

    def token_to_id(self, token: str) -> int:
        return self.vocabulary.id_of(token)

    def id_to_token(self, ident: int) -> str:
        return self.vocabulary.token_of(ident)

    def vocab_size(self) -> int:
        return len(self.vocabulary)

    def special_tokens(self) -> dict[str, int]:
        return dict(self.vocabulary.specials)

    def special_ids(self) -> set[int]:
        return set(self.special_tokens().values())

    def role_id(self, role: str) -> int | None:
        return self.vocabulary.specials.get(role)

    def unk_id(self) -> int:
        return self.vocabulary.unknown_id

    def pad_id(self) -> int | None:
        return self.role_id("pad")

    def bos_id(self) -> int | None:
        return self.role_id("bos")

    def eos_id(self) -> int | None:
        return self.role_id("eos")

    @property
    def unknown(self) -> str:
        return self.vocabulary.tokens[self.unk_id() - 1]

    def model_info(self) -> dict[str, str]:
        return {"format": self.format, "model_name": self.name, "version": self.version, "normalizer": "none"}

    def strip(self, piece: str) -> str:
        """A piece without the family's decoration."""
        return piece

    def piece_bytes(self, piece: str, word: str, done: int) -> int | None:
        """Bytes of a word, of which ``done`` characters are used, that a piece covers; None if it can't be told."""
        size = len(self.strip(piece))
        return chars.byte_length(word[done : done + size]) if done + size <= len(word) else None

    def offsets(self, text: str, tokens: list[str], ids: list[int]) -> list[Span] | None:
        """The spans of a text's tokens, found word by word; None where words on their own give other pieces."""
        out: list[Span] = []
        at = 0
        ascii_only = text.isascii()
        used, total = 0, 0
        for match in chars.WORDS.finditer(text):
            word = match.group()
            if ascii_only:
                start = match.start() + 1
            else:
                total += chars.byte_length(text[used : match.start()])
                used, start = match.start(), total + 1
            pieces = self.tokenize(word)
            if tokens[at : at + len(pieces)] != pieces:
                return None
            at += len(pieces)
            spans = self.word_spans(word, pieces, start)
            if spans is None:
                return None
            out += spans
        return out if at == len(tokens) else None

    def word_spans(self, word: str, pieces: list[str], start: int) -> list[Span] | None:
        end, cursor, done, out = start + chars.byte_length(word), start, 0, []
        for piece in pieces:
            if piece == self.unknown:
                out.append((start, end))
                cursor, done = end, len(word)
                continue
            size = self.piece_bytes(piece, word, done)
            if size is None:
                return None
            done += len(self.strip(piece))
            out.append((cursor, cursor + size))
            cursor += size
        return out if cursor <= end else None


def merge(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Symbols after all merges: the pair of lowest rank everywhere at once, from the left, while there is one."""
    while len(symbols) > 1:
        best, rank = None, math.inf
        for pair in zip(symbols, symbols[1:]):
            r = ranks.get(pair, math.inf)
            if r < rank:
                best, rank = pair, r
        if best is None:
            break
        out, k, last = [], 0, len(symbols) - 1
        left, right = best
        while k <= last:
            if k < last and symbols[k] == left and symbols[k + 1] == right:
                out.append(left + right)
                k += 2
            else:
                out.append(symbols[k])
                k += 1
        symbols = out
    return symbols


class BPE(Tokenizer):
    """Byte-pair merges over characters; ``end`` is a symbol put after each word."""

    format = "bpe"

    def __init__(self, vocabulary: Vocabulary, ranks: dict[tuple[str, str], int], unknown: str, end: str | None, name: str):
        super().__init__(vocabulary, name)
        self.ranks, self.unknown_token, self.end = ranks, unknown, end

    @property
    def unknown(self) -> str:
        return self.unknown_token

    def symbols(self, word: str) -> list[str]:
        return list(word)

    def merged(self, symbols: list[str]) -> list[str]:
        out = merge(symbols, self.ranks)
        ids = self.vocabulary.ids
        return out if all(s in ids for s in out) else [self.unknown_token]

    def word_pieces(self, word: str) -> list[str]:
        return self.merged(self.symbols(word) + ([self.end] if self.end is not None else []))

    def strip(self, piece: str) -> str:
        return piece.replace(self.end, "") if self.end else piece

    def decode(self, ids) -> str:
        text = "".join(self.kept(ids))
        return chars.trim(text.replace(self.end, " ") if self.end else text)


class ByteBPE(BPE):
    """Merges over bytes, each written as a printable character."""

    format = "bytebpe"

    def symbols(self, word: str) -> list[str]:
        return [chars.BYTE_CHAR[b] for b in word.encode("utf-8")]

    def piece_bytes(self, piece: str, word: str, done: int) -> int | None:
        return len(self.strip(piece))

    def decode(self, ids) -> str:
        text = "".join(self.kept(ids))
        out = []
        for chunk in text.split(self.end) if self.end else [text]:
            if not chunk:
                continue
            if any(c not in chars.CHAR_BYTE for c in chunk):
                return self.unknown_token
            out.append(bytes(chars.CHAR_BYTE[c] for c in chunk).decode("utf-8", "replace"))
        return " ".join(out)


class WordPiece(Tokenizer):
    """Greedy longest prefixes; pieces after the first carry ``prefix``."""

    format = "wordpiece"
    wrap = ("cls", "sep")

    def __init__(self, vocabulary: Vocabulary, prefix: str, unknown: str, most_chars: int, name: str):
        super().__init__(vocabulary, name)
        self.prefix, self.unknown_token, self.most_chars = prefix, unknown, most_chars

    @property
    def unknown(self) -> str:
        return self.unknown_token

    def word_pieces(self, word: str) -> list[str]:
        if 0 < self.most_chars < len(word):
            return [self.unknown_token]
        ids, out, start, n, longest = self.vocabulary.ids, [], 0, len(word), self.longest
        while start < n:
            head = self.prefix if start else ""
            for stop in range(min(n, start + longest), start, -1):
                piece = head + word[start:stop]
                if piece in ids:
                    break
            else:
                return [self.unknown_token]
            out.append(piece)
            start = stop
        return out

    def strip(self, piece: str) -> str:
        return piece.removeprefix(self.prefix)

    def decode(self, ids) -> str:
        out, current = [], ""
        for token in self.kept(ids):
            if token.startswith(self.prefix):
                current += token.removeprefix(self.prefix)
                continue
            if current:
                out.append(current)
            current = token
        return " ".join([*out, current] if current else out)


class Unigram(Tokenizer):
    """The segmentation of largest log-probability; ``marker`` is put before each word."""

    format = "unigram"

    def __init__(self, vocabulary: Vocabulary, scores, unknown: str, marker: str, name: str):
        super().__init__(vocabulary, name)
        self.scores, self.unknown_token, self.marker = tuple(scores), unknown, marker
        if len(self.scores) != len(vocabulary):
            raise ValueError("scores and tokens differ in number")

    @property
    def unknown(self) -> str:
        return self.unknown_token

    def word_pieces(self, word: str) -> list[str]:
        return self.best(self.marker + word)

    def best(self, text: str) -> list[str]:
        """Of equal sums, the one whose last pieces start earliest."""
        n, ids, scores, longest = len(text), self.vocabulary.ids, self.scores, self.longest
        total, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
        for i in range(n):
            if total[i] == -math.inf:
                continue
            for j in range(i + 1, min(n, i + longest) + 1):
                k = ids.get(text[i:j])
                if k is not None and total[i] + scores[k - 1] > total[j]:
                    total[j], back[j] = total[i] + scores[k - 1], i
        if not math.isfinite(total[n]):
            return [self.unknown_token]
        out = []
        while n:
            out.append(text[back[n] : n])
            n = back[n]
        return out[::-1]

    def strip(self, piece: str) -> str:
        return piece.replace(self.marker, "") if self.marker else piece

    def decode(self, ids) -> str:
        text = "".join(self.kept(ids))
        return chars.trim(text.replace(self.marker, " ") if self.marker else text)


class SentencePiece(Tokenizer):
    """A wrapper that marks the start of each word, over merges or log-probabilities."""

    format = "sentencepiece"

    def __init__(self, inner: BPE | Unigram, marker: str, name: str):
        super().__init__(inner.vocabulary, name)
        self.inner, self.marker = inner, marker

    @property
    def unknown(self) -> str:
        return self.inner.unknown

    def word_pieces(self, word: str) -> list[str]:
        if isinstance(self.inner, Unigram):
            return self.inner.word_pieces(word)
        return self.inner.merged(self.inner.symbols(self.marker + word))

    def strip(self, piece: str) -> str:
        return piece.replace(self.marker, "") if self.marker else piece

    def decode(self, ids) -> str:
        text = "".join(self.kept(ids))
        return chars.trim(text.replace(self.marker, " ") if self.marker else text)


class Tiktoken(Tokenizer):
    """Greedy longest matches of bytes over the whole text, white space included; ids follow the ranks."""

    format = "tiktoken"

    def __init__(self, pieces: list[bytes], ranks: list[int], name: str):
        self.pieces, self.ranks = tuple(pieces), tuple(ranks)
        self.by_bytes = {p: k for k, p in enumerate(pieces, 1)}
        self.most_bytes = max(map(len, pieces), default=0)
        super().__init__(Vocabulary((), {}), name)

    def encode(self, text: str, add_special_tokens: bool = False, assume_normalized: bool = False) -> list[int]:
        if add_special_tokens:
            raise ValueError("this family has no special tokens to add")
        data, out, i, find = text.encode("utf-8"), [], 0, self.by_bytes.get
        n = len(data)
        while i < n:
            for size in range(min(self.most_bytes, n - i), 0, -1):
                k = find(data[i : i + size])
                if k is not None:
                    break
            else:
                raise ValueError(f"no token for byte 0x{data[i]:02x} at position {i + 1}")
            out.append(k)
            i += size
        return out

    def tokenize(self, text: str) -> list[str]:
        return [self.id_to_token(i) for i in self.encode(text)]

    def _bytes(self, ident: int) -> bytes:
        if not 1 <= ident <= len(self.pieces):
            raise IndexError(f"id {ident} is outside 1..{len(self.pieces)}")
        return self.pieces[ident - 1]

    def decode(self, ids) -> str:
        return readable(b"".join(self._bytes(i) for i in ids))

    def token_to_id(self, token: str) -> int:
        found = self.by_bytes.get(token.encode("utf-8"))
        if found is None:
            raise KeyError(f"no token {token!r}")
        return found

    def id_to_token(self, ident: int) -> str:
        return readable(self._bytes(ident))

    def vocab_size(self) -> int:
        return len(self.pieces)

    def unk_id(self) -> int:
        raise KeyError("this family has no unknown token")

    def offsets(self, text: str, tokens: list[str], ids: list[int]) -> list[Span] | None:
        out, cursor = [], 1
        for i in ids:
            out.append((cursor, cursor := cursor + len(self._bytes(i))))
        return out if cursor == chars.byte_length(text) + 1 else None


def readable(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return "".join(f"\\x{b:02X}" for b in data)


def inject_specials(ids: list[int], base: list[int], spans: list[Span]) -> list[Span] | None:
    """Spans of ``ids``: those of ``base`` where it first lies in them, and (0, 0) for what was put around it."""
    if not base:
        return [(0, 0)] * len(ids)
    for k in range(len(ids) - len(base) + 1):
        if ids[k : k + len(base)] == base:
            return [(0, 0)] * k + spans + [(0, 0)] * (len(ids) - k - len(base))
    return None


def result_offsets(model: Tokenizer, text: str, ids: list[int], add_special_tokens: bool) -> list[Span] | None:
    base = model.encode(text, assume_normalized=True)
    spans = model.offsets(text, [model.id_to_token(i) for i in base], base)
    if spans is None:
        return None
    if not add_special_tokens:
        return spans if ids == base else None
    return inject_specials(ids, base, spans)


def encode_result(model: Tokenizer, text: str, add_special_tokens: bool = True, assume_normalized: bool = False, return_offsets: bool = False, return_masks: bool = False) -> dict:
    """ids, tokens, offsets, masks and metadata of one text."""
    view = text if assume_normalized else model.normalize(text)
    ids = model.encode(text, add_special_tokens=add_special_tokens, assume_normalized=assume_normalized)
    special = model.special_ids() if return_masks else ()
    return {
        "ids": ids,
        "tokens": [model.id_to_token(i) for i in ids],
        "offsets": result_offsets(model, view, ids, add_special_tokens) if return_offsets else None,
        "attention_mask": [1] * len(ids) if return_masks else None,
        "token_type_ids": [0] * len(ids) if return_masks else None,
        "special_tokens_mask": [int(i in special) for i in ids] if return_masks else None,
        "metadata": {
            "format": model.model_info()["format"],
            "model_name": model.name,
            "add_special_tokens": add_special_tokens,
            "assume_normalized": assume_normalized,
            "offsets_coordinates": "utf8_codeunits",
            "offsets_reference": "input_text" if assume_normalized else "tokenizer_normalized_text",
        },
    }
