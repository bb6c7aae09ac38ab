"""Encoding of Arrow batches: each distinct word of a batch is encoded once, and the
arrays of all texts are put together from these by index arithmetic.

Families that split at white space, and tokenizer.json pipelines over them, take
this road; texts with added tokens, byte fallback and other cases are encoded one by
one, with the same results.  What is made is given slice by slice, so that memory is
bounded by the slice, not by the batch.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.wordspans import word_spans
from . import models, vectors
from .models import Tiktoken, Tokenizer
from .pipeline_json import BYTE_LEVEL_SPLIT, Pipeline, _trims, _with_prefix, normalize, pretokenize

#: Bytes of text that are encoded at once, and those whose words are summed at once, which takes no array of all tokens.
SLICE_BYTES, TOTAL_BYTES = 1 << 20, 1 << 22
SPAN = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
ENCODING = pa.struct([("ids", pa.list_(pa.int32())), ("tokens", pa.list_(pa.string())), ("offsets", pa.list_(SPAN)), ("attention_mask", pa.list_(pa.int32())), ("token_type_ids", pa.list_(pa.int32())), ("special_tokens_mask", pa.list_(pa.int32()))])


def slices(column: pa.Array, most: int | None = None) -> Iterator[pa.Array]:
    """Parts of about so many bytes."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // (most or SLICE_BYTES))) + 1
    edges = [0, *cuts.tolist(), len(column)]
    for a, b in zip(edges[:-1], edges[1:]):
        yield column.slice(a, b - a)


def _expand(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] of them), starts[1], ..."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _ends(model: Tokenizer) -> tuple[list[int], list[int]] | None:
    """The ids put before and after a text; None if they can't be told."""
    out = model.post(model.blocks["post_processor"], [-1]) if isinstance(model, Pipeline) else model.wrapped([-1])
    return (out[: out.index(-1)], out[out.index(-1) + 1 :]) if out.count(-1) == 1 else None


class Odd(Exception):
    """Rows (a mask) that can't be put together from words."""

    def __init__(self, rows: np.ndarray):
        super().__init__()
        self.rows = rows


@dataclass
class Units:
    """What is encoded on its own: its row, its start in the text (None if that can't be told) and its string; ``shift``: how far a row's starts are moved and the byte where its text ends."""

    row: np.ndarray
    start: np.ndarray | None
    words: pa.Array
    shift: tuple[np.ndarray, np.ndarray] | None = None
    mark: str = ""


def _cuts(base: Tokenizer, mark: str) -> bool:
    """Whether a text's pieces are those of its parts, cut before each mark: no merge and no token reaches over one, and sums are exact."""
    if len(mark) != 1:
        return False
    if type(base) is models.BPE:
        return base.end is None and not any(mark in r or mark in l[1:] for l, r in base.ranks)
    if type(base) is models.Unigram:
        return not base.marker and not any(mark in t[1:] for t in base.vocabulary.tokens) and all(abs(s) < 2**20 and (s * 2**12).is_integer() for s in base.scores)
    return False


def _marked_units(model: Pipeline, stage: dict, views: list[str]) -> Units | None:
    """Words, each of which has a mark before it, of texts with single blanks between."""
    mark = stage["replacement"]
    if not stage["add_prefix_space"] or effective_only(model.blocks["pre_tokenizer"]) is None:
        return None
    if "cuts" not in model.__dict__:
        model.cuts = _cuts(model.base, mark)
    if not model.cuts:
        return None
    column = pa.array(views, pa.string())
    row, start, stop, words = word_spans(column)
    size = pc.binary_length(column).to_numpy(zero_copy_only=False)
    space = size - np.bincount(row, weights=stop - start, minlength=len(views)).astype(np.int64)
    lead = np.array([v.startswith(" ") for v in views], dtype=np.int64)
    blanks = np.array([-1 if mark in v else v.count(" ") for v in views], dtype=np.int64)
    odd = (size > 0) & ((space != np.bincount(row, minlength=len(views)) - 1 + lead) | (blanks != space))
    if odd.any():
        raise Odd(odd)
    return Units(row, start, pc.binary_join_element_wise(mark, words.cast(pa.string()), ""), mark=mark)


def effective_only(block: dict | None) -> dict | None:
    """The block of marks, if nothing but splits at white space comes before it."""
    if block is not None and block["type"] == "Sequence":
        kinds = [b["type"] for b in block["pretokenizers"]]
        return block["pretokenizers"][-1] if kinds[-1:] == ["Metaspace"] and set(kinds[:-1]) <= {"WhitespaceSplit"} else None
    return block if block is not None and block["type"] == "Metaspace" else None


def _units(model: Tokenizer, column: pa.Array, assume_normalized: bool) -> Units | None:
    """None where no text is put together from words."""
    if isinstance(model, Tiktoken):
        return None
    if not isinstance(model, Pipeline):
        row, start, _, words = word_spans(column)
        return Units(row, start, words)
    stage, blocks = model.stage, model.blocks
    if isinstance(model.base, Tiktoken) or (blocks["model"].get("byte_fallback") and type(model.base).format != "bytebpe"):
        return None
    added = [c for p in model.passes for c, *_ in p]
    texts = ["" if t is None else t for t in column.to_pylist()]
    views = texts if assume_normalized or blocks["normalizer"] is None else [normalize(blocks["normalizer"], t) for t in texts]
    odd = np.array([any(c in t or c in v for c in added) for t, v in zip(texts, views)], dtype=bool)
    if odd.any():
        raise Odd(odd)
    trimmed = _trims(blocks["post_processor"])[0]
    if stage and stage["type"] == "Metaspace":
        units = _marked_units(model, stage, views)
        if units is None or trimmed:
            return None
        return units
    if stage and stage["type"] == "ByteLevel":
        whole = views
        views = [_with_prefix(stage, v) for v in views]
        if stage["use_regex"] and model.splits_bytes:
            found = [BYTE_LEVEL_SPLIT.findall(v) for v in views]
            row = np.repeat(np.arange(len(views)), [len(f) for f in found])
            words = pa.array([p for f in found for p in f], pa.string())
            if trimmed:
                return Units(row, None, words)
            # pieces are all of a text, one after another
            ends = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False), dtype=np.int64)
            first = np.concatenate(([0], ends))[np.searchsorted(row, row)]
            last = np.array([models.chars.byte_length(v) for v in whole], dtype=np.int64) + 1
            moved = np.array([len(v) - len(w) for v, w in zip(views, whole)], dtype=np.int64)
            return Units(row, np.concatenate(([0], ends[:-1])) - first + 1 if len(row) else ends, words, (moved, last))
    else:
        views = [pretokenize(blocks["pre_tokenizer"], v) for v in views]
    row, start, _, words = word_spans(pa.array(views, pa.string()))
    # places hold where only white space is split, and nothing is trimmed
    plain = stage and (stage["type"] in ("None", "WhitespaceSplit") or (stage["type"] == "ByteLevel" and not stage["add_prefix_space"]))
    return Units(row, start if plain and not trimmed else None, words)


Found = tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]


def _one_by_one(model: Tokenizer, column: pa.Array, add_special_tokens: bool, assume_normalized: bool, spans: bool) -> Found:
    rows, places, known = [], [], np.zeros(len(column), dtype=bool)
    for k, t in enumerate(column.to_pylist()):
        ids = [] if t is None else model.encode(t, add_special_tokens, assume_normalized)
        rows.append(np.array(ids, dtype=np.int32))
        if not spans:
            continue
        found = None if t is None else models.result_offsets(model, t if assume_normalized else model.normalize(t), ids, add_special_tokens)
        known[k] = found is not None
        places.append(np.zeros((len(ids), 2), np.int64) if found is None else np.array(found, dtype=np.int64).reshape(-1, 2))
    offs = np.concatenate(([0], np.cumsum([len(r) for r in rows], dtype=np.int64)))
    at = np.concatenate([np.zeros((0, 2), np.int64), *places]) if spans else None
    return np.concatenate([np.zeros(0, np.int32), *rows]), offs, at, known


def ids_of(model: Tokenizer, column: pa.Array, add_special_tokens: bool = False, assume_normalized: bool = False, spans: bool = False) -> Found:
    """All ids, each text's range in them, and, if wanted, the (start, stop) of each and the texts that have them; a null text has none."""
    how = add_special_tokens, assume_normalized, spans
    try:
        return _by_words(model, column, *how)
    except Odd as found:
        odd = found.rows
    edges = [0, *(np.flatnonzero(odd[1:] != odd[:-1]) + 1).tolist(), len(column)]
    parts = [(_one_by_one if odd[a] else ids_of)(model, column.slice(a, b - a), *how) for a, b in zip(edges[:-1], edges[1:])]
    bases = np.cumsum([0, *(len(p[0]) for p in parts)])
    offs = np.concatenate([[0], *(p[1][1:] + base for p, base in zip(parts, bases))])
    return np.concatenate([p[0] for p in parts]), offs, np.concatenate([p[2] for p in parts]) if spans else None, np.concatenate([p[3] for p in parts])


def _by_words(model: Tokenizer, column: pa.Array, add_special_tokens: bool, assume_normalized: bool, spans: bool) -> Found:
    units = _units(model, column, assume_normalized)
    ends = _ends(model) if add_special_tokens and not isinstance(model, Tiktoken) else ([], [])
    if units is None or ends is None or (spans and units.start is None):
        return _one_by_one(model, column, add_special_tokens, assume_normalized, spans)
    row, words = units.row, units.words
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    own = model.base if isinstance(model, Pipeline) else model
    bank, starts, stops, sizes, odd = _word_pieces(own, coded.dictionary, spans, units.mark)
    if units.mark:
        # where one word is unknown, so is the whole text
        odd[np.repeat(np.arange(len(sizes)), sizes)[bank == own.token_to_id(own.unknown)]] = True
    if spans and ends[0]:
        odd[np.repeat(np.arange(len(sizes)), sizes)[np.isin(bank, ends[0])]] = True
    if odd.any():
        rows = np.zeros(len(column), dtype=bool)
        rows[row[odd[codes]]] = True
        raise Odd(rows)
    places = np.cumsum(sizes) - sizes
    each = sizes[codes] if len(codes) else np.zeros(0, np.int64)
    take = _expand(places[codes] if len(codes) else each, each)
    counts = np.bincount(row, weights=each, minlength=len(column)).astype(np.int64) if len(row) else np.zeros(len(column), np.int64)
    known = np.full(len(column), spans)
    at = None
    if spans:
        at = np.stack((starts[take], stops[take]), axis=1) + np.repeat(units.start, each)[:, None]
        if units.shift is not None:
            moved, last = (np.repeat(x[row], each)[:, None] for x in units.shift)
            at = np.minimum(np.maximum(at - moved, 1), last)
    ids = bank[take]
    if not (ends[0] or ends[1]):
        return ids, np.concatenate(([0], np.cumsum(counts))), at, known
    there = ~np.array(column.is_null().to_numpy(zero_copy_only=False), dtype=bool)
    more = len(ends[0]) + len(ends[1])
    offs = np.concatenate(([0], np.cumsum(counts + more * there)))
    out = np.zeros(offs[-1], dtype=np.int32)
    inner = _expand(offs[:-1] + len(ends[0]) * there, counts)
    out[inner] = ids
    for k, i in enumerate(ends[0]):
        out[offs[:-1][there] + k] = i
    for k, i in enumerate(reversed(ends[1]), 1):
        out[offs[1:][there] - k] = i
    if at is not None:
        wide = np.zeros((offs[-1], 2), dtype=np.int64)
        wide[inner] = at
        at = wide
    return out, offs, at, known


def _word_pieces(own: Tokenizer, words: pa.Array, spans: bool, mark: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, starts, stops of the pieces of different words, how many each has, and which words' spans can't be told."""
    odd = np.zeros(len(words), dtype=bool)
    found = vectors.pieces(own, words, mark)
    if found is not None:
        return *found, odd
    signed = vectors.signed(own, words.cast(pa.string()), mark)
    if signed.any() and not signed.all():
        # these few words alone are left to the model
        which = [np.flatnonzero(~signed), np.flatnonzero(signed)]
        parts = [_word_pieces(own, words.take(pa.array(w)), spans, mark) for w in which]
        order = np.argsort(np.concatenate([np.repeat(w, p[3]) for w, p in zip(which, parts)]), kind="stable")
        bank, starts, stops = (np.concatenate([p[k][: len(p[0])] for p in parts]) for k in range(3))
        sizes = np.zeros(len(words), dtype=np.int64)
        for w, p in zip(which, parts):
            sizes[w], odd[w] = p[3], p[4]
        return bank[order], starts[order] if spans else starts[:0], stops[order] if spans else stops[:0], sizes, odd
    distinct = words.to_pylist()
    memo, span_memo = own.id_memo, own.span_memo
    ids = [memo[w] for w in distinct]
    sizes = np.array([len(f) for f in ids], dtype=np.int64)
    bank = np.fromiter(itertools.chain.from_iterable(ids), dtype=np.int32, count=int(sizes.sum()))
    relative: list = []
    if spans:
        for k, w in enumerate(distinct):
            s = _marked_spans(w[1:], [own.id_to_token(i) for i in ids[k]], mark) if mark else span_memo[w]
            odd[k] = s is None
            relative.append([0] * (2 * len(ids[k])) if s is None else s)
    at = np.fromiter(itertools.chain.from_iterable(relative), dtype=np.int64, count=2 * len(bank) if spans else 0).reshape(-1, 2)
    return bank, at[:, 0], at[:, 1], sizes, odd


def _marked_spans(word: str, pieces: list[str], mark: str) -> list[int]:
    """Starts and stops, from 0, of the pieces of a word that has a mark before it; the mark has no bytes."""
    out, done, cursor = [], 0, 0
    for piece in pieces:
        n = len(piece.replace(mark, ""))
        size = models.chars.byte_length(word[done : done + n])
        out += (cursor, cursor + size)
        done, cursor = done + n, cursor + size
    return out


def _list(values: pa.Array, offs: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), values)


def encoded_parts(model: Tokenizer, column: pa.Array, add_special_tokens: bool) -> Iterator[pa.Array]:
    """Lists of ids, slice by slice."""
    for part in slices(column):
        ids, offs, *_ = ids_of(model, part, add_special_tokens)
        yield _list(pa.array(ids), offs)


def token_parts(model: Tokenizer, column: pa.Array) -> Iterator[pa.Array]:
    """Lists of tokens, slice by slice."""
    for part in slices(column):
        ids, offs, *_ = ids_of(model, part)
        yield _list(model.names.take(pa.array(ids - 1)), offs)


def encoded(model: Tokenizer, column: pa.Array, add_special_tokens: bool) -> pa.Array:
    return pa.concat_arrays(encoded_parts(model, column, add_special_tokens))


def counted(model: Tokenizer, column: pa.Array, add_special_tokens: bool = False) -> pa.Array:
    return pa.array(np.concatenate([np.diff(ids_of(model, part, add_special_tokens)[1]) for part in slices(column)]), pa.int64())


TOTALS = pa.struct([(name, pa.int64()) for name in ("n_tokens", "starts", "stops", "products")] + [("apart", pa.bool_())])


#: The five sums of each text as in TOTALS, and the texts that have them.
Sums = tuple[list[np.ndarray], np.ndarray]


def _clashes(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The rows in which a span starts before the end of one before it, of those that have bytes."""
    wide = np.flatnonzero(stop > start)
    row, start, stop = row[wide], start[wide], stop[wide]
    # rows one after another, each in its own range of the numbers
    room = int(stop.max(initial=0)) + 1
    most = np.maximum.accumulate(stop + row * room)
    early = (start[1:] + row[1:] * room < most[:-1]) & (row[1:] == row[:-1])
    return row[1:][early]


def _totals_of_tokens(model: Tokenizer, column: pa.Array) -> Sums:
    _, offs, at, known = ids_of(model, column, spans=True)
    start, stop = at[:, 0], at[:, 1]
    sums = [np.diff(offs), *(np.diff(np.concatenate(([0], np.cumsum(x, dtype=np.int64)))[offs]) for x in (start, stop, start * stop))]
    apart = np.ones(len(column), dtype=bool)
    apart[_clashes(np.repeat(np.arange(len(column)), np.diff(offs)), start, stop)] = False
    return [*sums, apart], known


def _totals_of_words(model: Tokenizer, column: pa.Array) -> Sums | None:
    """The sums of texts by those of their different words; None where spans can't be told from words."""
    units = _units(model, column, False)
    if units is None or units.start is None or (units.shift is not None and units.shift[0].any()):
        return None
    row, base = units.row, np.asarray(units.start, dtype=np.int64)
    coded = units.words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    own = model.base if isinstance(model, Pipeline) else model
    bank, starts, stops, sizes, odd = _word_pieces(own, coded.dictionary, True, units.mark)
    word = np.repeat(np.arange(len(sizes)), sizes)
    if units.mark:
        # where one word is unknown, so is the whole text
        odd[word[bank == own.token_to_id(own.unknown)]] = True
    if odd.any():
        rows = np.zeros(len(column), dtype=bool)
        rows[row[odd[codes]]] = True
        raise Odd(rows)
    ends = np.cumsum(sizes)
    a, b, ab = (np.diff(np.concatenate(([0], np.cumsum(x, dtype=np.int64)))[np.concatenate(([0], ends))]) for x in (starts, stops, starts * stops))
    # the least start and the last stop of a word's spans that have bytes
    wide = np.flatnonzero(stops > starts)
    low, high = np.full(len(sizes), np.iinfo(np.int64).max), np.zeros(len(sizes), dtype=np.int64)
    np.minimum.at(low, word[wide], starts[wide])
    np.maximum.at(high, word[wide], stops[wide])
    inner = np.zeros(len(sizes), dtype=bool)
    inner[_clashes(word, starts, stops)] = True
    n, a, b, ab = (x[codes] if len(codes) else np.zeros(0, np.int64) for x in (sizes, a, b, ab))
    edges = np.searchsorted(row, np.arange(len(column) + 1))
    sums = [np.diff(np.concatenate(([0], np.cumsum(x, dtype=np.int64)))[edges]) for x in (n, n * base + a, n * base + b, n * base * base + base * (a + b) + ab)]
    apart = np.ones(len(column), dtype=bool)
    if len(codes):
        there = np.flatnonzero(high[codes] > 0)
        apart[_clashes(row[there], low[codes[there]] + base[there], high[codes[there]] + base[there])] = False
        apart[row[inner[codes]]] = False
    return [*sums, apart], np.ones(len(column), dtype=bool)


def _totals(model: Tokenizer, column: pa.Array) -> Sums:
    try:
        found = _totals_of_words(model, column)
        parts = [found] if found is not None else [_totals_of_tokens(model, part) for part in slices(column)]
    except Odd as found:
        odd = found.rows
        edges = [0, *(np.flatnonzero(odd[1:] != odd[:-1]) + 1).tolist(), len(column)]
        runs = [(odd[a], column.slice(a, b - a)) for a, b in zip(edges[:-1], edges[1:])]
        parts = [p for alone, run in runs for p in ([_totals_of_tokens(model, x) for x in slices(run)] if alone else [_totals(model, run)])]
    return [np.concatenate(x) for x in zip(*(p[0] for p in parts))], np.concatenate([p[1] for p in parts])


def total_parts(model: Tokenizer, column: pa.Array) -> Iterator[pa.Array]:
    """The structs of ``span_totals``, slice by slice; null where spans can't be told."""
    for part in slices(column, TOTAL_BYTES):
        sums, known = _totals(model, part)
        yield pa.StructArray.from_arrays([*(pa.array(x.astype(np.int64)) for x in sums[:4]), pa.array(sums[4])], fields=list(TOTALS), mask=pa.array(~known))


def result_parts(model: Tokenizer, column: pa.Array, add_special_tokens: bool, assume_normalized: bool, return_offsets: bool, return_masks: bool) -> Iterator[pa.Array]:
    """The structs of ``encode_result``, slice by slice."""
    for part in slices(column):
        ids, offs, at, known = ids_of(model, part, add_special_tokens, assume_normalized, return_offsets)
        n = len(part)
        tokens = _list(model.names.take(pa.array(ids - 1)), offs)
        spans = pa.nulls(n, ENCODING.field("offsets").type)
        if return_offsets:
            pairs = pa.StructArray.from_arrays([pa.array(at[:, k].astype(np.int32)) for k in (0, 1)], fields=list(SPAN))
            spans = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pairs, mask=pa.array(~known))
        masks = [pa.nulls(n, pa.list_(pa.int32()))] * 3
        if return_masks:
            special = np.isin(ids, sorted(model.special_ids())).astype(np.int32)
            masks = [_list(pa.array(x), offs) for x in (np.ones(len(ids), np.int32), np.zeros(len(ids), np.int32), special)]
        yield pa.StructArray.from_arrays([_list(pa.array(ids), offs), tokens, spans, *masks], fields=list(ENCODING))


def results(model: Tokenizer, column: pa.Array, add_special_tokens: bool, assume_normalized: bool, return_offsets: bool, return_masks: bool) -> pa.Array:
    return pa.concat_arrays(result_parts(model, column, add_special_tokens, assume_normalized, return_offsets, return_masks))
