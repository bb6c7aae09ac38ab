"""Language identification by rank-order profiles of character n-grams.

Grams of 1 to 3 characters are taken within each lower-cased word, padded with
``_`` on both sides (a lone ``_`` isn't a gram).  A text's grams are ranked by
frequency, equal ones by their characters, and the first ``top`` are compared to
each language's profile, ranked likewise: the out-of-place distance adds up how
far each gram's rank is from its rank in the profile, ``top`` if it isn't there.
The nearest language wins, of equals the alphabetically first.

Profiles are fitted on at most ``per_language`` labelled texts of each language,
those of the smallest md5 of their id; all texts are then classified.

Defined cases: a text without letters (or null, or empty) has no language and is
rejected, as is one whose distance is above ``reject_percent`` of the largest
possible; rows without a language label don't take part in the fit; with no
labelled row at all every text is without language; rows are classified one by
one, so repeated rows repeat; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk

TOP, PER_LANGUAGE, REJECT_PERCENT = 300, 300, 80
#: SQL class of the characters between words.
GAP = r"[^a-z\x{80}-\x{10FFFF}]+"
_PAD = ord("_")


def gram_table(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row for each character of all padded words with the grams of 1, 2, 3 characters that start there (-1: none), and each text's range.

    A gram is its code points, 21 bits each, the first in the highest bits, so integers order as the strings do.
    """
    points, offs = tk.code_points(tk.lowered(column))
    inside = np.zeros(len(points) + 1, dtype=np.int8)
    inside[1:] = (points >= 128) | ((points >= 97) & (points <= 122))
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    block = np.concatenate(([0], np.cumsum(ends - starts + 2)))
    chars = np.full(block[-1] + 2, _PAD, dtype=np.int64)
    at = np.flatnonzero(inside[1:])
    chars[at + np.repeat(block[:-1] + 1 - starts, ends - starts)] = points[at]
    n = block[-1]
    table = np.full((n, 3), -1, dtype=np.int64)
    one = chars[:n] << 42
    two = one | (chars[1 : n + 1] << 21)
    table[:, 0], table[:, 1], table[:, 2] = one, two, two | chars[2 : n + 2]
    table[block[:-1], 0] = -1
    table[block[1:] - 1] = -1
    table[block[1:] - 2, 2] = -1
    return table, block[np.searchsorted(starts, offs)]


def tally(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams in order, and how often each occurs."""
    grams = np.sort(grams, axis=None)
    grams = grams[np.searchsorted(grams, 0) :]
    first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else np.zeros(0, np.int64)
    return grams[first], np.diff(np.append(first, len(grams)))


class Profiles:
    """The ranks of each language's grams."""

    def __init__(self, ranked: dict[str, list[int]], top: int):
        self.languages, self.top = sorted(ranked), top
        self.grams = np.array(sorted({g for grams in ranked.values() for g in grams}), dtype=np.int64)
        self.ranks = np.full((len(self.languages), len(self.grams) + 1), -1, dtype=np.int32)
        for k, language in enumerate(self.languages):
            self.ranks[k, np.searchsorted(self.grams, ranked[language])] = np.arange(len(ranked[language]))

    def distances(self, grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
        grams = grams[np.argsort(-counts, kind="stable")[: self.top]]
        at = np.searchsorted(self.grams, grams)
        at[at < len(self.grams)] = np.where(self.grams[at[at < len(self.grams)]] == grams[at < len(self.grams)], at[at < len(self.grams)], len(self.grams))
        ranks = self.ranks[:, at]
        return np.where(ranks < 0, self.top, np.abs(ranks - np.arange(len(grams)))).sum(axis=1), len(grams)


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", top: int = TOP, per_language: int = PER_LANGUAGE) -> Profiles:
    """Profiles from at most ``per_language`` texts of each language."""
    labelled = df.select(df[id_col].cast("bigint").alias("id"), df[lang_col].cast("string").alias("lang")).where("lang is not null and id is not null")
    order = Window.partitionBy("lang").orderBy(F.md5(F.col("id").cast("string")), "id")
    chosen = labelled.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language).select("id").distinct()
    # the sample is bounded by its parameter, so it can be sent to all executors
    texts = df.select(df[id_col].cast("bigint").alias("id"), df[lang_col].cast("string").alias("lang"), df[text_col].cast("string").alias("text"))
    texts = texts.where("lang is not null").join(F.broadcast(chosen), "id", "left_semi").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                mine = batch.filter(pa.array(langs == lang))
                for part in tk.slices(mine, "text"):
                    grams, counts = tally(gram_table(part.column(1))[0])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])

    counts = texts.mapInArrow(tk.tidy(count), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = counts.withColumn("k", F.row_number().over(rank)).where(F.col("k") <= top).select("lang", "gram", "k").collect()
    ranked: dict[str, list[int]] = {}
    for lang, gram, _ in sorted(rows, key=lambda r: (r[0], r[2])):
        ranked.setdefault(lang, []).append(gram)
    return Profiles(ranked, top)


def _classify(column: pa.Array, profiles: Profiles, reject_percent: int) -> list[tuple]:
    """(language, distance, margin to the second, grams, keep) of each text."""
    table, offs = gram_table(column)
    out = []
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        if a == b or not profiles.languages:
            out.append((None, None, None, 0, False))
            continue
        distance, n = profiles.distances(*tally(table[a:b]))
        best = int(np.argmin(distance))
        least = int(distance[best])
        margin = int(np.delete(distance, best).min()) - least if len(distance) > 1 else None
        out.append((profiles.languages[best], least, margin, n, least * 100 <= reject_percent * profiles.top * n))
    return out


def identify(df: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", reject_percent: int = REJECT_PERCENT) -> DataFrame:
    """``id_col``, predicted, distance, margin, n_grams and keep of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, batch.schema.names[1]):
                cols = list(zip(*_classify(part.column(1), profiles, reject_percent)))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[batch.schema.names[0], "predicted", "distance", "margin", "n_grams", "keep"])

    return df.select(df[id_col].cast("bigint"), df[text_col].cast("string")).mapInArrow(tk.tidy(run), f"`{id_col}` bigint, predicted string, distance bigint, margin bigint, n_grams bigint, keep boolean")


def relabel(df: DataFrame, profiles: Profiles, text_col: str = "text", lang_col: str = "lang", reject_percent: int = REJECT_PERCENT) -> DataFrame:
    """The rows of ``df``, all columns, that aren't rejected, ``lang_col`` being the language found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, text_col):
                found = _classify(tk.column(part, text_col), profiles, reject_percent)
                at = part.schema.get_field_index(lang_col)
                part = part.set_column(at, lang_col, pa.array([x[0] for x in found], pa.string()))
                yield part.filter(pa.array([x[4] for x in found], pa.bool_()))

    return df.mapInArrow(tk.tidy(run), df.schema)


def oracle_sql(top: int = TOP, per_language: int = PER_LANGUAGE, reject_percent: int = REJECT_PERCENT) -> str:
    """The fit (on the bounded sample) and the classification of all documents."""
    return f"""
WITH words AS (SELECT doc_id, lang, '_' || unnest(list_filter(string_split_regex(lower(text), '{GAP}'), lambda x: x <> '')) || '_' AS w FROM documents),
counted AS (SELECT doc_id, lang, w, count(*) AS c FROM words GROUP BY ALL),
cells AS (SELECT doc_id, lang, w, c, n, unnest(range(1, length(w) + 2 - n)) AS i FROM counted, (SELECT unnest([1, 2, 3]) AS n) t),
grams AS (SELECT doc_id, lang, substr(w, i, n) AS gram, sum(c) AS c FROM cells WHERE substr(w, i, n) <> '_' GROUP BY ALL),
chosen AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS k FROM documents WHERE lang IS NOT NULL) WHERE k <= {per_language}),
totals AS (SELECT lang, gram, sum(c) AS c FROM grams JOIN chosen USING (doc_id) WHERE lang IS NOT NULL GROUP BY ALL),
profiles AS (SELECT * FROM (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY c DESC, gram) - 1 AS r FROM totals) WHERE r < {top}),
own AS (SELECT * FROM (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, gram) - 1 AS r FROM grams) WHERE r < {top}),
langs AS (SELECT DISTINCT lang FROM profiles),
apart AS (SELECT o.doc_id, l.lang, sum(CASE WHEN p.r IS NULL THEN {top} ELSE abs(o.r - p.r) END)::BIGINT AS d, count(*) AS n
  FROM own o CROSS JOIN langs l LEFT JOIN profiles p ON p.gram = o.gram AND p.lang = l.lang GROUP BY ALL),
best AS (SELECT doc_id, lang, d, n, row_number() OVER (PARTITION BY doc_id ORDER BY d, lang) AS k, lead(d) OVER (PARTITION BY doc_id ORDER BY d, lang) AS second FROM apart)
SELECT x.doc_id, b.lang AS predicted, b.d AS distance, b.second - b.d AS margin, coalesce(b.n, 0) AS n_grams, coalesce(b.d * 100 <= {reject_percent * top} * b.n, false) AS keep
FROM documents x LEFT JOIN best b ON b.doc_id = x.doc_id AND b.k = 1"""
