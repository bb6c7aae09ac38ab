"""License scan: an exact set-similarity join of text blocks with license templates.

A block is a line of a text, and with ``wrapped`` also a notice that is wrapped
over consecutive lines of a paragraph: the shortest runs of lines, none of them
blank but for comment marks, that reach the threshold while no shorter run
within them does.  Such a run is found with at most 1.5 times the template's
words in all, so that words scattered over a long paragraph aren't a notice, and
is numbered by its first line.  Block and template are sets of words.  A pair is
found when the template's containment, |block & template| / |template|, reaches
the threshold.

Template words are ordered by how often they occur in the whole corpus, rarest
first.  With an overlap of at least o = ceil(threshold * m) wanted of a template
of m words, every matching block has one of the template's first m - o + 1 words
(prefix filter), has at least o words (length filter), and after its first
common word at position i of the template and j among its own template words
at least o are left on both sides (positional filter).  Only what passes is
verified.  Templates are a fixed library, not data, so they go to every executor.

Defined cases: null and empty texts have no blocks; templates without words
never match; every row is scanned, so repeated rows and null ids repeat their
matches; blocks are numbered from 1, blank lines included; equal lines of a text
each match; a text is read whole; other columns are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

THRESHOLD_PERCENT = 80
TEMPLATES = {
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "All rights reserved.",
}
_WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def _hashes(tokens: list[str]) -> np.ndarray:
    return tk.Words(pa.array(tokens, pa.large_string())).hashes() if tokens else np.zeros(0, np.uint64)


class _Probe:
    """Membership of word hashes in a small set: a bit table first, then the sorted set."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        self.bits = np.zeros(1 << 16, dtype=bool)
        self.bits[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``hashes`` of members, and which member of the sorted keys."""
        at = np.flatnonzero(self.bits[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        k = np.searchsorted(self.keys, hashes[at])
        k[k == len(self.keys)] = 0
        ok = self.keys[k] == hashes[at] if len(self.keys) else np.zeros(len(at), bool)
        return at[ok], k[ok]


def word_counts(df: DataFrame, text_col: str, tokens: list[str]) -> dict[str, int]:
    """How often each of ``tokens`` occurs in all texts."""
    hashes = _hashes(tokens)
    order = np.argsort(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe, total = _Probe(hashes), np.zeros(len(tokens), dtype=np.int64)
        for batch in batches:
            for part in tk.slices(batch, batch.schema.names[0]):
                total += np.bincount(probe.find(tk.Words(part.column(0)).hashes())[1], minlength=len(tokens))
        yield pa.RecordBatch.from_arrays([pa.array(order.astype(np.int64)), pa.array(total)], names=["token", "n"])

    rows = df.select(df[text_col].cast("string").alias("text")).mapInArrow(tk.tidy(run), "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).collect()
    found = dict.fromkeys(tokens, 0)
    return found | {tokens[r.token]: r.n for r in rows}


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold_percent: int = THRESHOLD_PERCENT, wrapped: bool = False) -> DataFrame:
    """``id_col``, block, template, overlap, template_words and containment of every match."""
    library = {k: words(t) for k, t in (TEMPLATES if templates is None else templates).items() if words(t)}
    tokens = sorted(set().union(*library.values())) if library else []
    counts = word_counts(df, text_col, tokens) if tokens else {}
    rank = {t: k for k, t in enumerate(sorted(tokens, key=lambda t: (counts[t], t)))}
    ordered = {name: sorted(ws, key=rank.__getitem__) for name, ws in sorted(library.items())}
    need = {name: -(-threshold_percent * len(ws) // 100) for name, ws in ordered.items()}
    prefixes: dict[str, list[tuple[str, int]]] = {}
    for name, ws in ordered.items():
        for i, w in enumerate(ws[: len(ws) - max(need[name], 1) + 1]):
            prefixes.setdefault(w, []).append((name, i))
    keys = _hashes(sorted(prefixes))
    schema = f"`{id_col}` bigint, block bigint, template string, overlap bigint, template_words bigint, containment double"

    def match(block: set[str]) -> Iterator[tuple[str, int]]:
        own = sorted((w for w in block if w in rank), key=rank.__getitem__)
        tried = set()
        for j, w in enumerate(own):
            for name, i in prefixes.get(w, ()):
                m, o = len(ordered[name]), need[name]
                if name in tried:
                    continue
                tried.add(name)
                if len(block) < o or min(m - i, len(own) - j) < o:
                    continue
                overlap = len(library[name] & block)
                if overlap >= o:
                    yield name, overlap

    def take(text: tk.Words, ends: np.ndarray, n: int, start: int, stop: int, lines: dict[int, list[str]]) -> None:
        """Adds line ``n``, and those around it in its paragraph that a notice with a word in it may reach."""
        for step in (-1, 1):
            total, k = 0, n
            while start <= k < stop and total <= limit:
                if k not in lines:
                    a, b = (int(ends[k - 1]) + 1 if k else 0), int(ends[k])
                    lines[k] = _WORD.findall(text.data[a:b].tobytes().decode("utf-8", "replace"))
                if not lines[k]:
                    break
                total += len(lines[k]) if k != n else 0
                k += step

    def runs(lines: dict[int, list[str]]) -> Iterator[tuple[int, str, int]]:
        """First line, template and overlap of notices over several lines; lines: number -> words, of all lines that may be part of one."""
        best: dict[tuple[int, str], tuple[int, int]] = {}
        for first in sorted(lines):
            seen, total, last = set(), 0, first
            while lines.get(last) and total <= limit:
                seen = seen | set(lines[last])
                total += len(lines[last])
                for name, overlap in match(seen):
                    if total <= 1.5 * lengths[name] or last == first:
                        best.setdefault((first, name), (last, overlap))
                last += 1
        for (first, name), (last, overlap) in best.items():
            if last > first and not any(best.get((k, name), (last + 1,))[0] <= last for k in range(first + 1, last + 1)):
                yield first, name, overlap

    lengths = {name: len(_WORD.findall(t.lower())) for name, t in (TEMPLATES if templates is None else templates).items()}
    limit = 1.5 * max(lengths.values(), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = _Probe(keys)
        for batch in batches:
            found = []
            for part in tk.slices(batch, batch.schema.names[1]):
                text = tk.Words(part.column(1))
                at, _ = probe.find(text.hashes())
                ends = np.flatnonzero(text.data == 10)
                line = np.unique(np.searchsorted(ends, text.starts[at]))
                row = np.searchsorted(text.offsets, np.where(line > 0, ends[line - 1] + 1, 0), side="right") - 1 if len(line) else line
                near: dict[int, dict[int, list[str]]] = {}
                for n, r in zip(line.tolist(), row.tolist()):
                    if wrapped:
                        start = int(np.searchsorted(ends, text.offsets[r]))
                        stop = int(np.searchsorted(ends, text.offsets[r + 1]))
                        take(text, ends, n, start, stop, near.setdefault(r, {}))
                    a, b = (int(ends[n - 1]) + 1 if n else 0), int(ends[n])
                    block = set(_WORD.findall(text.data[a:b].tobytes().decode("utf-8", "replace")))
                    number = n - int(np.searchsorted(ends, text.offsets[r])) + 1
                    found += [(part.column(0)[r].as_py(), number, name, k, len(library[name]), k / len(library[name])) for name, k in match(block)]
                for r, lines in near.items():
                    start = int(np.searchsorted(ends, text.offsets[r]))
                    found += [(part.column(0)[r].as_py(), n - start + 1, name, k, len(library[name]), k / len(library[name])) for n, name, k in runs(lines)]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
            cols = list(zip(*found)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[batch.schema.names[0], "block", "template", "overlap", "template_words", "containment"])

    return df.select(df[id_col].cast("bigint"), df[text_col].cast("string")).mapInArrow(tk.tidy(run), schema)


def oracle_sql(templates: dict[str, str] = TEMPLATES, threshold_percent: int = THRESHOLD_PERCENT) -> str:
    values = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in templates.items())
    gap = tk.WORD_GAP
    return f"""
WITH templates(template, body) AS (VALUES {values}),
tw AS (SELECT template, unnest(list_distinct(list_filter(string_split_regex(lower(body), '{gap}'), lambda x: x <> ''))) AS w FROM templates),
tn AS (SELECT template, count(*) AS m FROM tw GROUP BY template),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS block FROM documents),
bw AS (SELECT doc_id, block, unnest(list_distinct(list_filter(string_split_regex(lower(line), '{gap}'), lambda x: x <> ''))) AS w FROM lines),
hits AS (SELECT doc_id, block, template, count(*) AS overlap FROM bw JOIN tw USING (w) GROUP BY ALL)
SELECT doc_id, block, template, overlap, m AS template_words, overlap / m AS containment
FROM hits JOIN tn USING (template) WHERE overlap * 100 >= {threshold_percent} * m"""
