"""Learning vocabularies from a text column.

Words are counted by Spark (combined before the shuffle), after which a trainer
sees each distinct word once.  Merges are learned on the driver while there are at
most DRIVER_WORDS distinct words, over arrays with an index from pairs to places, of which
a merge touches its own; beyond, by a job a merge over words as arrays of symbol numbers, from
which the driver gets the sums of the pairs only.  Both give the same
merges, as every tie is broken by the strings.  Unigram's expectation steps and
candidate counts are always jobs; sums are of decimals, so that neither order nor
partitioning changes a result.
"""

from __future__ import annotations

import functools
import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chars
from ..functions.normalizers import word_split
from ..functions.session import cut
from ..functions.wordspans import word_spans
from . import pipeline_json as pj
from . import vectors
from .arrays import slices
from .models import BPE, ByteBPE, SentencePiece, Tokenizer, Unigram, WordPiece
from .vocabulary import Vocabulary

#: Distinct words whose merges are learned on the driver, and letters for each on average (about 90 bytes a letter).
DRIVER_WORDS, WORD_LETTERS = 250_000, 12
#: Bytes of text whose words a task counts before they are shuffled.
COUNT_BYTES = 1 << 22
#: Jobs after which the table of words is written anew.
CUT_EVERY = 16
ROLE_ORDER = ("unk", "pad", "bos", "eos", "cls", "sep", "mask")
ALIASES = {"unknown": "unk", "padding": "pad", "begin": "bos", "end": "eos"}
MARKER = "▁"
Pair = tuple[str, str]


@dataclass(frozen=True)
class TrainingConfig:
    """What a trainer was asked for; options that a trainer doesn't have are None."""

    trainer: str
    vocab_size: int
    special_tokens: dict[str, str]
    min_frequency: int | None = None
    end_of_word_marker: str | None = None
    include_full_byte_alphabet: bool | None = None
    continuation_prefix: str | None = None
    max_input_chars_per_word: int | None = None
    seed_size: int | None = None
    num_iters: int | None = None
    max_subword_length: int | None = None
    prune_fraction: float | None = None
    whitespace_marker: str | None = None
    model_type: str | None = None
    pretokenizer: Callable[[str], list[str]] | None = None
    normalizer: dict | None = None
    byte_level: dict | None = None
    export_unk_token_null: bool | None = None
    model_name: str = "trained"
    version: str = "0.3.0"


@dataclass(frozen=True)
class TrainingResult:
    tokenizer: Tokenizer
    config: TrainingConfig
    #: vocab_tokens, merge_pairs or token_logprobs, and word_counts (a DataFrame).
    artifacts: dict = field(repr=False)


def special_map(tokens: dict[str, str], required: tuple[str, ...] = ("unk",)) -> dict[str, str]:
    """Roles by their usual names, in the usual order."""
    out: dict[str, str] = {}
    for name, token in tokens.items():
        role = ALIASES.get(name.lower(), name.lower())
        if out.setdefault(role, token) != token:
            raise ValueError(f"the role {role} is given two tokens")
        if not token:
            raise ValueError(f"the role {role} has an empty token")
    for role in required:
        if role not in out:
            raise ValueError(f"special_tokens must include {role}")
    order = {r: k for k, r in enumerate(ROLE_ORDER)}
    return dict(sorted(out.items(), key=lambda x: (order.get(x[0], len(order)), x[0])))


def _checked(config: TrainingConfig) -> TrainingConfig:
    for name in ("vocab_size", "min_frequency", "seed_size", "num_iters", "max_subword_length"):
        value = getattr(config, name)
        if value is not None and value < 1:
            raise ValueError(f"{name} must be positive")
    if config.prune_fraction is not None and not 0 <= config.prune_fraction < 1:
        raise ValueError("prune_fraction must be at least 0 and below 1")
    if config.max_input_chars_per_word is not None and config.max_input_chars_per_word < 0:
        raise ValueError("max_input_chars_per_word can't be negative")
    return config


# ---------------------------------------------------------------- words


def _pieces(text: Column, pretokenizer: Callable[[str], list[str]] | None) -> Column:
    if pretokenizer is None:
        return word_split(text)

    @F.pandas_udf("array<string>")
    def run(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in values:
            yield pd.Series([[] if v is None else [str(p) for p in pretokenizer(v)] for v in batch], dtype=object)

    return F.filter(run(text), lambda w: w != "")


def _words(texts: pa.Array, pretokenizer: Callable[[str], list[str]] | None) -> tuple[pa.Array, pa.Array]:
    """The different words of texts, and how often each is there."""
    if pretokenizer is None:
        found = word_spans(texts)[3].value_counts()
        return found.field("values"), found.field("counts")
    counts: Counter[str] = Counter()
    for text in texts.to_pylist():
        counts.update([] if text is None else map(str, pretokenizer(text)))
    counts.pop("", None)
    return pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())


def word_counts(df: DataFrame, text_col: str = "text", pretokenizer: Callable[[str], list[str]] | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, word, freq; null texts have no words.  Without keys, words are counted slice by slice before the shuffle."""
    if not keys:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch.column(0), COUNT_BYTES):
                    yield pa.RecordBatch.from_arrays([*_words(part, pretokenizer)], names=["word", "freq"])

        found = df.select(df[text_col].cast("string")).mapInArrow(run, "word string, freq bigint")
        return found.groupBy("word").agg(F.sum("freq").alias("freq"))
    words = df.select(*keys, F.explode(_pieces(df[text_col], pretokenizer)).alias("word"))
    return words.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("freq"))


def alphabet(counts: DataFrame) -> DataFrame:
    """symbol, freq of the characters of counted words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            code, sizes = vectors.codes(pc.fill_null(batch.column(0).cast(pa.string()), ""))
            keys, place = np.unique(np.concatenate((keys, code)), return_inverse=True)
            n = np.concatenate((sums, np.repeat(batch.column(1).to_numpy(zero_copy_only=False), sizes)))
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, place, n)
        yield pa.RecordBatch.from_arrays([pa.array([chr(c) for c in keys.tolist()], pa.string()), pa.array(sums)], names=["symbol", "freq"])

    found = counts.select("word", F.col("freq").cast("bigint")).mapInArrow(run, "symbol string, freq bigint")
    return found.groupBy("symbol").agg(F.sum("freq").alias("freq"))


def pair_counts(symbols: DataFrame) -> DataFrame:
    """left, right, n of adjacent symbols, of a table (symbols, freq)."""
    n = F.size("symbols") - 1
    pairs = F.arrays_zip(F.slice("symbols", F.lit(1), F.greatest(n, F.lit(0))).alias("l"), F.slice("symbols", F.lit(2), F.greatest(n, F.lit(0))).alias("r"))
    return symbols.select(F.explode(pairs).alias("p"), "freq").groupBy(F.col("p.l").alias("left"), F.col("p.r").alias("right")).agg(F.sum("freq").alias("n"))


def best_pair(pairs: DataFrame) -> DataFrame:
    """The most frequent pair; of equals the first by its strings."""
    return pairs.orderBy(F.desc("n"), "left", "right").limit(1)


def pair_scores(symbols: DataFrame) -> DataFrame:
    """left, right, n and score = n / (count of left * count of right)."""
    single = symbols.select(F.explode("symbols").alias("symbol"), "freq").groupBy("symbol").agg(F.sum("freq").alias("count"))
    left = single.select(F.col("symbol").alias("left"), F.col("count").alias("left_count"))
    right = single.select(F.col("symbol").alias("right"), F.col("count").alias("right_count"))
    joined = pair_counts(symbols).join(left, "left").join(right, "right")
    return joined.select("left", "right", "n", (F.col("n").cast("double") / (F.col("left_count").cast("double") * F.col("right_count").cast("double"))).alias("score"))


# ---------------------------------------------------------------- merges


class PairIndex:
    """Counts of adjacent symbols, kept up to date while pairs are merged.

    All words are one array of symbol numbers, linked to their neighbours; a merge
    touches the places of its pair only, all of them at once.
    """

    def __init__(self, symbols: pa.Array, freq: np.ndarray):
        coded = symbols.flatten().dictionary_encode()
        self.names: list[str] = coded.dictionary.to_pylist()
        self.number = {t: k for k, t in enumerate(self.names)}
        sizes = symbols.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        word = np.repeat(np.arange(len(sizes)), sizes)
        # a place of -1 is before and after each word
        at = np.arange(len(word)) + word + 1
        n = len(word) + len(sizes) + 1
        self.symbol = np.full(n, -1, dtype=np.int32)
        self.symbol[at] = coded.indices.to_numpy(zero_copy_only=False)
        self.freq = np.zeros(n, dtype=np.int64)
        self.freq[at] = freq[word]
        self.after = np.arange(1, n + 1, dtype=np.int32)
        self.before = np.arange(-1, n - 1, dtype=np.int32)
        self.single = np.bincount(self.symbol[at], weights=self.freq[at], minlength=len(self.names)).astype(np.int64).tolist()
        self.slot: dict[int, int] = {}
        self.codes: list[int] = []
        self.counts = np.zeros(1024, dtype=np.int64)
        self.where: dict[int, list[np.ndarray]] = defaultdict(list)
        self.heap: list[tuple[int, Pair]] = []
        self._count(at, 1)

    def _code(self, pair: Pair) -> int:
        return self.number[pair[0]] << 32 | self.number[pair[1]]

    def _pair(self, code: int) -> Pair:
        return self.names[code >> 32], self.names[code & 0xFFFFFFFF]

    def _count(self, at: np.ndarray, sign: int) -> None:
        """Adds or takes away the pairs that start at these places."""
        left, right = self.symbol[at], self.symbol[self.after[at]]
        there = (left >= 0) & (right >= 0)
        at, codes = at[there], left[there].astype(np.int64) << 32 | right[there]
        if not len(at):
            return
        order = np.argsort(codes, kind="stable")
        at, codes = at[order], codes[order]
        first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        sums = np.add.reduceat(self.freq[at], first).tolist()
        edges = [*first.tolist(), len(at)]
        for k, code in enumerate(codes[first].tolist()):
            slot = self.slot.get(code)
            if slot is None:
                slot = self.slot[code] = len(self.codes)
                self.codes.append(code)
                if slot == len(self.counts):
                    self.counts = np.concatenate((self.counts, np.zeros_like(self.counts)))
            self.counts[slot] += sign * sums[k]
            if sign > 0:
                self.where[code].append(at[edges[k] : edges[k + 1]])
            if self.counts[slot] > 0:
                heapq.heappush(self.heap, (-int(self.counts[slot]), self._pair(code)))

    def most_frequent(self) -> tuple[Pair | None, int]:
        while self.heap:
            n, p = self.heap[0]
            if self.counts[self.slot[self._code(p)]] == -n:
                return p, -n
            heapq.heappop(self.heap)
        return None, 0

    def best_scored(self, least: int) -> tuple[Pair | None, int, float]:
        counts = self.counts[: len(self.codes)]
        live = np.flatnonzero(counts >= max(least, 1))
        if not len(live):
            return None, 0, 0.0
        codes, n = np.array(self.codes, dtype=np.int64)[live], counts[live]
        single = np.array(self.single, dtype=np.float64)
        scores = n / (single[codes >> 32] * single[codes & 0xFFFFFFFF])
        best = scores.max()
        count, pair = min((-int(n[k]), self._pair(int(codes[k]))) for k in np.flatnonzero(scores == best))
        return pair, -count, float(best)

    def merge(self, pair: Pair, merged: str) -> None:
        left, right = (self.number[x] for x in pair)
        made = self.number.get(merged)
        if made is None:
            made = self.number[merged] = len(self.names)
            self.names.append(merged)
            self.single.append(0)
        at = np.unique(np.concatenate(self.where.pop(self._code(pair), [np.zeros(0, np.int64)])))
        at = at[(self.symbol[at] == left) & (self.symbol[self.after[at]] == right)]
        if left == right and len(at):
            # of a run of equal symbols every second place, from the left
            fresh = np.concatenate(([True], self.after[at[:-1]] != at[1:]))
            start = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            at = at[(np.arange(len(at)) - start) % 2 == 0]
        if not len(at):
            return
        second = self.after[at]
        beyond = self.after[second]
        self._count(np.unique(np.concatenate((self.before[at], at, second))), -1)
        joined = int(self.freq[at].sum())
        self.symbol[at], self.symbol[second] = made, -2
        self.after[at], self.before[beyond] = beyond, at
        for k, n in ((left, -joined), (right, -joined), (made, joined)):
            self.single[k] += n
        self._count(np.unique(np.concatenate((self.before[at], at))), 1)


#: Words in slabs: the symbols of many words, how many each word has, and how often it is there, as bytes.
SLAB = "codes binary, sizes binary, freq binary"


def _slab(symbol: np.ndarray, sizes: np.ndarray, freq: np.ndarray) -> pa.RecordBatch:
    narrow = symbol.astype(np.int16 if int(symbol.max(initial=0)) < 1 << 15 else np.int32)
    parts = narrow, sizes.astype(np.int32), freq.astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], names=["codes", "sizes", "freq"])


def _slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each slab all symbols, the word of each, and the words' frequencies."""
    for batch in batches:
        for row in range(batch.num_rows):
            codes, sizes, freq = (batch.column(k)[row].as_buffer() for k in range(3))
            sizes, freq = np.frombuffer(sizes, dtype=np.int32), np.frombuffer(freq, dtype=np.int64)
            total = int(sizes.sum(dtype=np.int64))
            symbol = np.frombuffer(codes, dtype=np.int16 if codes.size == 2 * total else np.int32)
            yield symbol, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), freq


def _joined(symbol: np.ndarray, word: np.ndarray, merges: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The same after merges (left, right, made), each everywhere at once and from the left."""
    own = False
    for left, right, made in merges:
        at = np.flatnonzero(symbol[:-1] == left)
        at = at[(symbol[at + 1] == right) & (word[at] == word[at + 1])]
        if left == right and len(at):
            # of a run of equal symbols every second place
            fresh = np.concatenate(([True], at[1:] != at[:-1] + 1))
            start = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            at = at[(np.arange(len(at)) - start) % 2 == 0]
        if len(at):
            if not own:
                symbol = symbol.astype(np.int32) if symbol.dtype == np.int16 and max(m for *_, m in merges) >= 1 << 15 else symbol.copy()
                own = True
            symbol[at] = made
            kept = np.ones(len(symbol), dtype=bool)
            kept[at + 1] = False
            symbol, word = symbol[kept], word[kept]
    return symbol, word


@dataclass(frozen=True)
class Spelling:
    """How words are spelled in symbols: their letters or bytes, the later ones with a prefix, and an end."""

    letters: tuple[str, ...] = ()
    byte: bool = False
    end: str | None = None
    prefix: str | None = None

    def size(self, word: str = "word") -> Column:
        return (F.octet_length(word) if self.byte else F.char_length(word)) + int(self.end is not None)

    def names(self) -> list[str]:
        first = list(chars.BYTE_CHAR) if self.byte else sorted(self.letters)
        more = [self.prefix + c for c in first] if self.prefix else []
        return [*first, *more, *([self.end] if self.end is not None and self.end not in first else [])]

    def codes(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The places in ``names`` of all words' symbols, and how many each word has."""
        if self.byte:
            symbol, sizes = vectors.body(words).astype(np.int64), pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
            n = 256
        else:
            code, sizes = vectors.codes(words)
            symbol, n = np.searchsorted(np.array(sorted(map(ord, self.letters)), dtype=np.int64), code), len(self.letters)
        stops = np.cumsum(sizes)
        if self.prefix:
            later = np.ones(len(symbol), dtype=bool)
            later[(stops - sizes)[sizes > 0]] = False
            symbol = symbol + n * later
        if self.end is not None:
            symbol, sizes = np.insert(symbol, stops, self.names().index(self.end)), sizes + 1
        return symbol.astype(np.int32), sizes


class PairJobs:
    """The same choices as those of PairIndex, by a job a merge over the words of a table.

    Words are written once as slabs of symbol numbers, and again after CUT_EVERY merges; those
    since then are done anew by each job.  Tasks give the sums of their pairs, and the driver has the sums of all.

    A merge of (a, b) changes the counts of pairs that start with b or end with a only, and each place of a new pair
    was one of these.  So their old counts bound all that isn't known, and while the first of
    the others is above these bounds, it is the most frequent pair without a job.
    """

    #: Cells up to which a task counts pairs in a square of symbols.
    SQUARE = 1 << 22

    def __init__(self, symbols: DataFrame, counts: DataFrame | None = None, spelling: Spelling | None = None):
        self.pending: list[tuple[int, int, int]] = []
        #: left, right, n and whether n is exact, else it is a bound; None: all pairs must be counted.
        self.known: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None = None
        if spelling is not None:
            self.names = spelling.names()
            self.number = {t: k for k, t in enumerate(self.names)}

            def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    yield _slab(*spelling.codes(batch.column(0).cast(pa.string())), batch.column(1).to_numpy(zero_copy_only=False))

            self.words = cut(counts.select("word", F.col("freq").cast("bigint")).mapInArrow(spelled, SLAB))
            return
        found = symbols.select(F.explode("symbols").alias("s")).distinct().collect()  # as many as the corpus has different letters
        self.names = sorted(r.s for r in found)
        self.number = {t: k for k, t in enumerate(self.names)}
        known = pa.array(self.names, pa.string())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column(0)
                codes = pc.index_in(lists.flatten().cast(pa.string()), known).to_numpy(zero_copy_only=False)
                yield _slab(codes, lists.value_lengths().to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False))

        self.words = cut(symbols.select("symbols", F.col("freq").cast("bigint")).mapInArrow(run, SLAB))

    def _sums(self, singles: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """left, right (-1: the symbol alone, if ``singles``) and n."""
        merges, size = list(self.pending), len(self.names) + 1
        square = size * size <= self.SQUARE

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells = np.zeros(size * size if square else 0, dtype=np.int64)
            keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for symbol, word, freq in _slabs(batches):
                symbol, word = _joined(symbol, word, merges)
                pair = np.flatnonzero(word[:-1] == word[1:])
                # symbols count from 1 here, 0 stands for none
                key = (symbol[pair].astype(np.int64) + 1) * size + symbol[pair + 1] + 1
                n = freq[word[pair]]
                if singles:
                    key, n = np.concatenate((key, (symbol.astype(np.int64) + 1) * size)), np.concatenate((n, freq[word]))
                if square:
                    np.add.at(cells, key, n)
                    continue
                keys, place = np.unique(np.concatenate((keys, key)), return_inverse=True)
                n = np.concatenate((sums, n))
                sums = np.zeros(len(keys), np.int64)
                np.add.at(sums, place, n)
            if square:
                keys = np.flatnonzero(cells)
                sums = cells[keys]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], names=["key", "n"])

        found = self.words.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
        key, n = (found.column(k).to_numpy() for k in ("key", "n"))
        return key // size - 1, key % size - 1, n

    def _first(self, left: np.ndarray, right: np.ndarray, n: np.ndarray) -> tuple[Pair | None, int]:
        """The largest n; of equals the first by its strings."""
        if not len(n):
            return None, 0
        most = n.max()
        return min((self.names[left[k]], self.names[right[k]]) for k in np.flatnonzero(n == most)), int(most)

    def most_frequent(self) -> tuple[Pair | None, int]:
        if self.known is not None:
            left, right, n, exact = self.known
            bound = n[~exact].max(initial=0)
            if (n[exact] > bound).any():
                return self._first(left[exact], right[exact], n[exact])
        found = self._sums(False)
        self.known = *found, np.ones(len(found[2]), dtype=bool)
        return self._first(*found)

    def best_scored(self, least: int) -> tuple[Pair | None, int, float]:
        left, right, n = self._sums(True)
        single = np.zeros(len(self.names))
        single[left[right < 0]] = n[right < 0]
        live = (right >= 0) & (n >= max(least, 1))
        if not live.any():
            return None, 0, 0.0
        left, right, n = left[live], right[live], n[live]
        scores = n / (single[left] * single[right])
        best = scores == scores.max()
        return *self._first(left[best], right[best], n[best]), float(scores.max())

    def merge(self, pair: Pair, merged: str) -> None:
        if merged not in self.number:
            self.number[merged] = len(self.names)
            self.names.append(merged)
            if self.known is not None:
                left, right, n, exact = self.known
                a, b = self.number[pair[0]], self.number[pair[1]]
                # of a run of equal symbols the new pairs were (a, a) itself
                there = (left != a) | (right != b) | (a == b)
                self.known = left[there], right[there], n[there], (exact & (left != b) & (right != a))[there]
        else:
            # pairs of a symbol that is there already get more places
            self.known = None
        self.pending.append((self.number[pair[0]], self.number[pair[1]], self.number[merged]))
        if len(self.pending) < CUT_EVERY:
            return
        merges, self.pending = self.pending, []

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for symbol, word, freq in _slabs(batches):
                symbol, word = _joined(symbol, word, merges)
                yield _slab(symbol, np.bincount(word, minlength=len(freq)), freq)

        self.words = cut(self.words.mapInArrow(run, SLAB))


def learn_merges(symbols: DataFrame, tokens: list[str], vocab_size: int, least: int, prefix: str | None = None, driver_words: int | None = None, counts: DataFrame | None = None, spelling: Spelling | None = None) -> tuple[list[Pair], list[float]]:
    """Merges until ``tokens`` (which grow) are enough, with a score each.  With a prefix pairs are chosen by score, else by frequency.

    ``counts`` (word, freq) and ``spelling``: what ``symbols`` is made of; jobs then spell the words themselves.
    """
    driver_words = DRIVER_WORDS if driver_words is None else driver_words
    there = set(tokens)
    merges: list[Pair] = []
    scores: list[float] = []

    def take(pair: Pair, score: float) -> str:
        left, right = pair
        merged = left + (right.removeprefix(prefix) if prefix is not None else right)
        merges.append(pair)
        scores.append(score)
        if merged not in there:
            there.add(merged)
            tokens.append(merged)
        return merged

    sized = symbols.select(F.size("symbols").alias("n")) if spelling is None else counts.select(spelling.size().alias("n"))
    total = sized.agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("letters")).first()
    if total.words <= driver_words and (total.letters or 0) <= WORD_LETTERS * driver_words:
        rows = symbols.select("symbols", "freq").toArrow()
        index = PairIndex(rows.column(0).combine_chunks(), rows.column(1).to_numpy())
    else:
        index = PairJobs(symbols, counts, spelling)
    while len(tokens) < vocab_size:
        if prefix is None:
            pair, n = index.most_frequent()
            score = float(n)
        else:
            pair, n, score = index.best_scored(least)
        if pair is None or n < least:
            break
        index.merge(pair, take(pair, score))
    return merges, scores


def _start(config: TrainingConfig, df: DataFrame, text_col: str, counts: DataFrame | None = None) -> DataFrame:
    # written once, as alphabets, candidates and merges all read it
    if counts is None:
        counts = cut(word_counts(df, text_col, config.pretokenizer))
    if not counts.take(1):
        raise ValueError("the corpus has no words to train on")
    return counts


def _unique(*groups) -> list[str]:
    return list(dict.fromkeys(t for g in groups for t in g))


def _room(config: TrainingConfig, tokens: list[str]) -> list[str]:
    if len(tokens) > config.vocab_size:
        raise ValueError(f"vocab_size = {config.vocab_size} is too small: {len(tokens)} tokens are needed at least")
    return tokens


def _chars(counts: DataFrame) -> list[str]:
    # as many as the corpus has different characters, at most those of Unicode
    return sorted(r.symbol for r in alphabet(counts).select("symbol").collect())


def _first_ranks(merges: list[Pair]) -> dict[Pair, int]:
    ranks: dict[Pair, int] = {}
    for k, p in enumerate(merges, 1):
        ranks.setdefault(p, k)
    return ranks


def _bpe_like(config: TrainingConfig, df: DataFrame, text_col: str, byte: bool, counts: DataFrame | None = None) -> TrainingResult:
    counts = _start(config, df, text_col, counts)
    end = config.end_of_word_marker or None
    specials = config.special_tokens
    letters = _byte_symbols() if byte else F.filter(F.split("word", ""), lambda c: c != "")
    symbols = counts.select(F.concat(letters, F.array(F.lit(end))) if end is not None else letters, "freq").toDF("symbols", "freq")
    if byte and config.include_full_byte_alphabet:
        base = list(chars.BYTE_CHAR)
    elif byte:
        base = sorted({c for r in counts.select(F.explode(letters).alias("c")).distinct().collect() for c in r.c})
    else:
        base = _chars(counts)
    tokens = _room(config, _unique(specials.values(), [end] if end is not None else [], base))
    spelling = Spelling(() if byte else tuple(base), byte, end)
    merges, _ = learn_merges(symbols, tokens, config.vocab_size, config.min_frequency, counts=counts, spelling=spelling)
    vocabulary = Vocabulary.build(tokens, specials)
    model = (ByteBPE if byte else BPE)(vocabulary, _first_ranks(merges), specials["unk"], end, config.model_name)
    return TrainingResult(model, config, {"vocab_tokens": tokens, "merge_pairs": merges, "pair_ranks": model.ranks, "word_counts": counts})


def _byte_symbols() -> Column:
    """The printable characters of a word's bytes, by a look-up in the JVM."""
    table = F.array(*[F.lit(c) for c in chars.BYTE_CHAR])
    codes = F.regexp_extract_all(F.hex(F.encode("word", "UTF-8")), F.lit("(..)"), F.lit(1))
    return F.transform(codes, lambda h: F.element_at(table, F.conv(h, 16, 10).cast("int") + 1))


def train_bpe_result(df: DataFrame, text_col: str = "text", *, vocab_size: int, min_frequency: int = 2, special_tokens: dict[str, str] | None = None, end_of_word_marker: str | None = "</w>", pretokenizer=None, model_name: str = "trained_bpe", counts: DataFrame | None = None) -> TrainingResult:
    """``counts``: the words of ``df`` by ``word_counts``, written, where they are there already; likewise below."""
    config = TrainingConfig("bpe", vocab_size, special_map(special_tokens or {"unk": "<UNK>", "pad": "<PAD>"}), min_frequency, end_of_word_marker, pretokenizer=pretokenizer, model_name=model_name)
    return _bpe_like(_checked(config), df, text_col, False, counts)


def train_bytebpe_result(df: DataFrame, text_col: str = "text", *, vocab_size: int, min_frequency: int = 2, special_tokens: dict[str, str] | None = None, end_of_word_marker: str | None = "</w>", include_full_byte_alphabet: bool = True, pretokenizer=None, model_name: str = "trained_bytebpe", counts: DataFrame | None = None) -> TrainingResult:
    config = TrainingConfig("bytebpe", vocab_size, special_map(special_tokens or {"unk": "<UNK>", "pad": "<PAD>"}), min_frequency, end_of_word_marker, include_full_byte_alphabet, pretokenizer=pretokenizer, model_name=model_name)
    return _bpe_like(_checked(config), df, text_col, True, counts)


WORDPIECE_SPECIALS = {"unk": "[UNK]", "pad": "[PAD]", "cls": "[CLS]", "sep": "[SEP]", "mask": "[MASK]"}


def train_wordpiece_result(df: DataFrame, text_col: str = "text", *, vocab_size: int, min_frequency: int = 2, special_tokens: dict[str, str] | None = None, continuation_prefix: str = "##", max_input_chars_per_word: int = 100, pretokenizer=None, model_name: str = "trained_wordpiece") -> TrainingResult:
    if not continuation_prefix:
        raise ValueError("continuation_prefix can't be empty")
    config = _checked(TrainingConfig("wordpiece", vocab_size, special_map(special_tokens or WORDPIECE_SPECIALS), min_frequency, continuation_prefix=continuation_prefix, max_input_chars_per_word=max_input_chars_per_word, pretokenizer=pretokenizer, model_name=model_name))
    counts = _start(config, df, text_col)
    if max_input_chars_per_word:
        counts = counts.where(F.length("word") <= max_input_chars_per_word)
        if not counts.take(1):
            raise ValueError(f"no word has at most {max_input_chars_per_word} characters")
    letters = _chars(counts)
    tokens = _room(config, _unique(config.special_tokens.values(), letters, [continuation_prefix + c for c in letters]))
    spelling = Spelling(tuple(letters), prefix=continuation_prefix)
    merges, scores = learn_merges(wordpiece_symbols(counts, continuation_prefix), tokens, vocab_size, min_frequency, continuation_prefix, counts=counts, spelling=spelling)
    model = WordPiece(Vocabulary.build(tokens, config.special_tokens), continuation_prefix, config.special_tokens["unk"], max_input_chars_per_word, model_name)
    return TrainingResult(model, config, {"vocab_tokens": tokens, "merge_pairs": merges, "merge_scores": scores, "word_counts": counts})


def wordpiece_symbols(counts: DataFrame, prefix: str = "##") -> DataFrame:
    """symbols, freq: the characters of words, all but the first with the prefix."""
    letters = F.filter(F.split("word", ""), lambda c: c != "")
    return counts.select(F.transform(letters, lambda c, i: F.when(i == 0, c).otherwise(F.concat(F.lit(prefix), c))).alias("symbols"), "freq")


# ---------------------------------------------------------------- unigram


#: Characters that a number of 64 bits has room for.
PACKED = 3


def _short_parts(longest: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of words of up to so many characters and how often they are there, summed batch by batch."""
    for batch in batches:
        code, sizes = vectors.codes(batch.column(0).cast(pa.string()))
        freq = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(code))
        # characters count from 1 here, so that parts of different lengths differ
        key = np.zeros(len(code), dtype=np.int64)
        for n in range(1, longest + 1):
            at = np.flatnonzero(left >= n)
            key[at] = key[at] << 21 | code[at + n - 1] + 1
            keys, place = np.unique(key[at], return_inverse=True)
            sums = np.zeros(len(keys), dtype=np.int64)
            np.add.at(sums, place, freq[at])
            letters = np.stack([(keys >> 21 * k & (1 << 21) - 1) - 1 for k in range(n - 1, -1, -1)], axis=1).astype("<u4")
            text = letters.tobytes().decode("utf-32-le")
            yield pa.RecordBatch.from_arrays([pa.array([text[i : i + n] for i in range(0, len(text), n)], pa.string()), pa.array(sums)], names=["token", "freq"])


def candidate_counts(words: DataFrame, max_subword_length: int) -> DataFrame:
    """token, freq: twice for a whole word, once for each character and each longer part up to the length."""
    if max_subword_length <= PACKED:
        parts = words.where("length(word) > 0").select("word", F.col("freq").cast("bigint"))
        short = parts.mapInArrow(functools.partial(_short_parts, max_subword_length), "token string, freq bigint")
        return short.union(parts.select("word", F.col("freq") * 2)).groupBy("token").agg(F.sum("freq").alias("freq"))
    spans = F.expr(f"flatten(transform(sequence(1, length(word)), i -> transform(sequence(1, least({max_subword_length}, length(word) - i + 1)), n -> substring(word, i, n))))")
    parts = words.where("length(word) > 0").select(F.explode(spans).alias("token"), "freq")
    return parts.union(words.where("length(word) > 0").select("word", F.col("freq") * 2)).groupBy("token").agg(F.sum("freq").alias("freq"))


def seed_tokens(candidates: DataFrame, letters: list[str], limit: int) -> list[str]:
    """The characters, then the most frequent candidates (of equals the longest, then by the string), up to the limit."""
    wanted = max(limit - len(letters), 0)
    # a character is among the candidates, so it can take no other's place
    ranked = candidates.orderBy(F.desc("freq"), F.desc(F.length("token")), "token").limit(wanted + len(letters)).collect()
    there = set(letters)
    more = [r.token for r in ranked if r.token not in there]
    return letters + more[:wanted]


def normalized_logs(weights) -> list[float]:
    floored = [max(w, 1e-12) for w in weights]
    total = math.fsum(floored)
    return [math.log(w / total) for w in floored]


def _posterior(word: str, freq: int, logs: dict[str, float], longest: int, out: dict[str, float]) -> None:
    """Adds the expected counts of a word's pieces."""
    n = len(word)
    add = lambda a, b: b if a == -math.inf else a if b == -math.inf else max(a, b) + math.log1p(math.exp(-abs(a - b)))
    edges = [[(j, t, logs[t]) for j in range(i + 1, min(n, i + longest) + 1) if (t := word[i:j]) in logs] for i in range(n)]
    forward, backward = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    for i in range(n):
        if forward[i] > -math.inf:
            for j, _, p in edges[i]:
                forward[j] = add(forward[j], forward[i] + p)
    if forward[n] == -math.inf:
        return
    for i in range(n - 1, -1, -1):
        for j, _, p in edges[i]:
            backward[i] = add(backward[i], p + backward[j])
    for i in range(n):
        if forward[i] > -math.inf:
            for j, t, p in edges[i]:
                if backward[j] > -math.inf:
                    out[t] += freq * math.exp(forward[i] + p + backward[j] - forward[n])


def expected_counts(words: DataFrame, tokens: list[str], logs: list[float]) -> list[float]:
    """How often each token is expected, over all segmentations of all words."""
    model = words.sparkSession.sparkContext.broadcast((dict(zip(tokens, logs)), max(map(len, tokens))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        logs, longest = model.value
        for batch in batches:
            rows: list[tuple[str, float]] = []
            for word, freq in zip(batch["word"], batch["freq"]):
                own: dict[str, float] = defaultdict(float)
                _posterior(word, int(freq), logs, longest, own)
                rows += own.items()
            yield pd.DataFrame(rows, columns=["token", "n"])

    parts = words.select("word", "freq").mapInPandas(run, "token string, n double")
    # decimals add up alike in any order
    found = parts.groupBy("token").agg(F.sum(F.col("n").cast("decimal(38,12)")).cast("double").alias("n")).collect()
    model.unpersist()
    by = {r.token: r.n for r in found}
    return [by.get(t, 0.0) for t in tokens]


def train_unigram_result(df: DataFrame, text_col: str = "text", *, vocab_size: int, seed_size: int = 200_000, num_iters: int = 5, max_subword_length: int = 6, prune_fraction: float = 0.2, special_tokens: dict[str, str] | None = None, whitespace_marker: str = MARKER, pretokenizer=None, model_name: str = "trained_unigram") -> TrainingResult:
    specials = special_map(special_tokens or {"unk": "<UNK>", "pad": "<PAD>"})
    config = _checked(TrainingConfig("unigram", vocab_size, specials, seed_size=seed_size, num_iters=num_iters, max_subword_length=max_subword_length, prune_fraction=prune_fraction, whitespace_marker=whitespace_marker, pretokenizer=pretokenizer, model_name=model_name))
    words = _start(config, df, text_col)
    if whitespace_marker:
        words = words.select(F.concat(F.lit(whitespace_marker), F.col("word")).alias("word"), "freq")
    values = _unique(specials.values())
    target = vocab_size - len(values)
    letters = [r.symbol for r in alphabet(words).orderBy(F.desc("freq"), "symbol").collect()]
    if target < max(1, len(letters)):
        raise ValueError(f"vocab_size = {vocab_size} is too small: {len(values) + len(letters)} tokens are needed at least")
    candidates = candidate_counts(words, max_subword_length).where(~F.col("token").isin(*values)).persist()
    tokens = seed_tokens(candidates, letters, max(target, min(seed_size, max(64, 4 * target))))
    side = df.sparkSession.createDataFrame([(t,) for t in tokens], "token string")
    freq = {r.token: r.freq for r in candidates.join(side, "token", "left_semi").collect()}
    candidates.unpersist()
    logs = normalized_logs([max(freq.get(t, 1), 1) for t in tokens])
    for _ in range(num_iters):
        logs = normalized_logs(expected_counts(words, tokens, logs))
    fixed = set(letters)
    while len(tokens) > target:
        expected = expected_counts(words, tokens, logs)
        excess = len(tokens) - target
        loose = sorted((expected[k], freq.get(t, 0), len(t), t, k) for k, t in enumerate(tokens) if t not in fixed)
        count = min(excess, max(1, math.ceil(len(tokens) * prune_fraction)) if prune_fraction else 1)
        gone = {x[4] for x in loose[:count]}
        kept = [k for k in range(len(tokens)) if k not in gone]
        tokens, logs = [tokens[k] for k in kept], normalized_logs([expected[k] for k in kept])
    for _ in range(num_iters):
        logs = normalized_logs(expected_counts(words, tokens, logs))
    final = values + tokens
    weights = [1e-4] * len(values) + [math.exp(x) for x in logs]
    scores = normalized_logs(weights)
    model = Unigram(Vocabulary.build(final, specials), scores, specials["unk"], whitespace_marker, model_name)
    return TrainingResult(model, config, {"vocab_tokens": final, "token_logprobs": scores, "word_counts": words})


def train_sentencepiece_result(df: DataFrame, text_col: str = "text", *, vocab_size: int, model_type: str = "unigram", special_tokens: dict[str, str] | None = None, whitespace_marker: str = MARKER, seed_size: int = 200_000, num_iters: int = 5, max_subword_length: int = 6, prune_fraction: float = 0.2, min_frequency: int = 2, pretokenizer=None, model_name: str = "trained_sentencepiece", counts: DataFrame | None = None) -> TrainingResult:
    if model_type not in ("unigram", "bpe"):
        raise ValueError(f"model_type {model_type!r} isn't unigram or bpe")
    if not whitespace_marker:
        raise ValueError("whitespace_marker can't be empty")
    specials = special_map(special_tokens or {"unk": "<unk>", "pad": "<pad>"})
    inner_name = f"{model_name}_inner"
    config = _checked(TrainingConfig("sentencepiece", vocab_size, specials, min_frequency, seed_size=seed_size, num_iters=num_iters, max_subword_length=max_subword_length, prune_fraction=prune_fraction, whitespace_marker=whitespace_marker, model_type=model_type, pretokenizer=pretokenizer, model_name=model_name))
    if model_type == "unigram":
        inner = train_unigram_result(df, text_col, vocab_size=vocab_size, seed_size=seed_size, num_iters=num_iters, max_subword_length=max_subword_length, prune_fraction=prune_fraction, special_tokens=specials, whitespace_marker=whitespace_marker, pretokenizer=pretokenizer, model_name=inner_name)
        return TrainingResult(SentencePiece(inner.tokenizer, whitespace_marker, model_name), config, inner.artifacts)
    counts = _start(config, df, text_col, counts)
    marked = F.when(F.col("word").startswith(whitespace_marker), F.col("word")).otherwise(F.concat(F.lit(whitespace_marker), F.col("word")))
    words = cut(counts.groupBy(marked.alias("word")).agg(F.sum("freq").alias("freq")))
    letters = _chars(words)
    tokens = _room(config, _unique(specials.values(), letters))
    symbols = words.select(F.filter(F.split("word", ""), lambda c: c != "").alias("symbols"), "freq")
    merges, _ = learn_merges(symbols, tokens, vocab_size, min_frequency, counts=words, spelling=Spelling(tuple(letters)))
    inner_model = BPE(Vocabulary.build(tokens, specials), _first_ranks(merges), specials["unk"], None, inner_name)
    return TrainingResult(SentencePiece(inner_model, whitespace_marker, model_name), config, {"vocab_tokens": tokens, "merge_pairs": merges, "pair_ranks": inner_model.ranks, "word_counts": words})


# ---------------------------------------------------------------- presets of tokenizer.json


def _added(model: Tokenizer, specials: dict[str, str]) -> list[dict]:
    ids = {model.token_to_id(t): t for t in reversed(specials.values())}
    return [{"content": t, "id": i, "special": True, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False} for i, t in sorted(ids.items())]


def _pipeline(inner: TrainingResult, config: TrainingConfig, parts: dict) -> TrainingResult:
    blocks = pj.family_blocks(inner.tokenizer) | {"added_tokens": _added(inner.tokenizer, config.special_tokens)} | parts
    return TrainingResult(pj.Pipeline(blocks, config.model_name, config.version), config, inner.artifacts | {"added_tokens": blocks["added_tokens"]})


def train_hf_bert_wordpiece_result(df: DataFrame, text_col: str = "text", *, vocab_size: int, min_frequency: int = 2, special_tokens: dict[str, str] | None = None, continuation_prefix: str = "##", max_input_chars_per_word: int = 100, clean_text: bool = True, handle_chinese_chars: bool = True, lowercase: bool = True, strip_accents: bool | None = None, model_name: str = "trained_bert_wordpiece") -> TrainingResult:
    specials = special_map(special_tokens or WORDPIECE_SPECIALS, ("unk", "pad", "cls", "sep", "mask"))
    normal = {"type": "BertNormalizer", "clean_text": clean_text, "handle_chinese_chars": handle_chinese_chars, "strip_accents": strip_accents, "lowercase": lowercase}
    inner = train_wordpiece_result(df, text_col, vocab_size=vocab_size, min_frequency=min_frequency, special_tokens=specials, continuation_prefix=continuation_prefix, max_input_chars_per_word=max_input_chars_per_word, pretokenizer=lambda t: [p for p, _ in pj.bert_pieces(pj.normalize(normal, t))], model_name=f"{model_name}_inner")
    config = replace(inner.config, trainer="hf_bert_wordpiece", pretokenizer=None, normalizer=normal, model_name=model_name)
    base = inner.tokenizer
    post = {"type": "BertProcessing"} | {r: (specials[r], base.token_to_id(specials[r])) for r in ("cls", "sep")}
    return _pipeline(inner, config, {"normalizer": normal, "pre_tokenizer": {"type": "BertPreTokenizer"}, "post_processor": post, "decoder": {"type": "WordPiece", "prefix": continuation_prefix}})


def _byte_pieces(normal: dict | None, level: dict) -> Callable[[str], list[str]]:
    def run(text: str) -> list[str]:
        work = pj._with_prefix(level, pj.normalize(normal, text))
        return pj.BYTE_LEVEL_SPLIT.findall(work) if level["use_regex"] else [work]

    return run


def train_hf_roberta_bytebpe_result(df: DataFrame, text_col: str = "text", *, vocab_size: int, min_frequency: int = 2, special_tokens: dict[str, str] | None = None, end_of_word_marker: str | None = "</w>", nfkc: bool = False, lowercase: bool = False, add_prefix_space: bool = True, trim_offsets: bool = True, use_regex: bool = True, model_name: str = "trained_roberta_bytebpe") -> TrainingResult:
    specials = special_map(special_tokens or {"unk": "<unk>", "pad": "<pad>", "bos": "<s>", "eos": "</s>", "mask": "<mask>"}, ("unk", "pad", "bos", "eos", "mask"))
    steps = [{"type": k} for k, wanted in (("NFKC", nfkc), ("Lowercase", lowercase)) if wanted]
    normal = {"type": "Sequence", "normalizers": steps} if len(steps) > 1 else steps[0] if steps else None
    level = {"type": "ByteLevel", "add_prefix_space": add_prefix_space, "trim_offsets": trim_offsets, "use_regex": use_regex}
    inner = train_bytebpe_result(df, text_col, vocab_size=vocab_size, min_frequency=min_frequency, special_tokens=specials, end_of_word_marker=end_of_word_marker, pretokenizer=_byte_pieces(normal, level), model_name=f"{model_name}_inner")
    config = replace(inner.config, trainer="hf_roberta_bytebpe", pretokenizer=None, normalizer=normal, byte_level=level, model_name=model_name)
    ends = {name: (specials[role], inner.tokenizer.token_to_id(specials[role])) for name, role in (("cls", "bos"), ("sep", "eos"))}
    post = {"type": "RobertaProcessing"} | ends | {"trim_offsets": trim_offsets, "add_prefix_space": add_prefix_space}
    return _pipeline(inner, config, {"normalizer": normal, "pre_tokenizer": level, "post_processor": post, "decoder": level})


def train_hf_gpt2_bytebpe_result(df: DataFrame, text_col: str = "text", *, vocab_size: int, min_frequency: int = 2, special_tokens: dict[str, str] | None = None, end_of_word_marker: str | None = "</w>", add_prefix_space: bool = False, trim_offsets: bool = True, use_regex: bool = True, export_unk_token_null: bool = True, model_name: str = "trained_gpt2_bytebpe") -> TrainingResult:
    specials = special_map(special_tokens or {"unk": "<|endoftext|>"})
    level = {"type": "ByteLevel", "add_prefix_space": add_prefix_space, "trim_offsets": trim_offsets, "use_regex": use_regex}
    inner = train_bytebpe_result(df, text_col, vocab_size=vocab_size, min_frequency=min_frequency, special_tokens=specials, end_of_word_marker=end_of_word_marker, pretokenizer=_byte_pieces(None, level), model_name=f"{model_name}_inner")
    config = replace(inner.config, trainer="hf_gpt2_bytebpe", pretokenizer=None, byte_level=level, export_unk_token_null=export_unk_token_null, model_name=model_name)
    blocks = pj.family_blocks(inner.tokenizer)["model"] | ({"unk_token": None} if export_unk_token_null else {})
    return _pipeline(inner, config, {"model": blocks, "pre_tokenizer": level, "post_processor": level, "decoder": level})


def _only_tokenizer(train):
    def run(*args, **options) -> Tokenizer:
        return train(*args, **options).tokenizer

    run.__name__ = train.__name__.removesuffix("_result")
    run.__doc__ = f"The tokenizer of {train.__name__}."
    return run


train_bpe = _only_tokenizer(train_bpe_result)
train_bytebpe = _only_tokenizer(train_bytebpe_result)
train_wordpiece = _only_tokenizer(train_wordpiece_result)
train_unigram = _only_tokenizer(train_unigram_result)
train_sentencepiece = _only_tokenizer(train_sentencepiece_result)
train_hf_bert_wordpiece = _only_tokenizer(train_hf_bert_wordpiece_result)
train_hf_roberta_bytebpe = _only_tokenizer(train_hf_roberta_bytebpe_result)
train_hf_gpt2_bytebpe = _only_tokenizer(train_hf_gpt2_bytebpe_result)
QUICK_TRAINERS = {"wordpiece": train_wordpiece_result, "hf_bert_wordpiece": train_hf_bert_wordpiece_result, "hf_roberta_bytebpe": train_hf_roberta_bytebpe_result, "hf_gpt2_bytebpe": train_hf_gpt2_bytebpe_result}
