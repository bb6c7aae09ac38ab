"""Spans of UTF-8 bytes as Column expressions: from 1, half open, (0, 0) for none.

A span is a struct of start and stop; a text is a string column.  All of these stay
in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COORDINATES, INDEX_BASE, STYLE, SENTINEL = "utf8_codeunits", 1, "half_open", (0, 0)


def offsets_coordinate_system() -> str:
    return COORDINATES


def offsets_index_base() -> int:
    return INDEX_BASE


def offsets_span_style() -> str:
    return STYLE


def offsets_sentinel() -> tuple[int, int]:
    return SENTINEL


def has_span(span: Column) -> Column:
    return ~((span["start"] == 0) & (span["stop"] == 0))


def has_nonempty_span(span: Column) -> Column:
    return has_span(span) & (span["stop"] > span["start"])


def span_ncodeunits(span: Column) -> Column:
    return F.when(has_span(span), F.greatest(F.lit(0), span["stop"] - span["start"])).otherwise(0)


def _data(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once a row, however often lambdas in it read it."""
    return F.transform(F.array(value), use)[0]


def _inside(data: Column, span: Column) -> Column:
    return (span["start"] >= 1) & (span["start"] <= span["stop"]) & (span["stop"] <= F.octet_length(data) + 1)


def _cut(data: Column, span: Column) -> Column:
    return F.substring(data, span["start"], span["stop"] - span["start"])


def _boundary(data: Column, index: Column) -> Column:
    last = F.octet_length(data) + 1
    byte = F.hex(F.substring(data, index, F.lit(1)))
    return F.coalesce((index >= 1) & (index <= last) & ((index == last) | ~F.substring(byte, 1, 1).isin("8", "9", "A", "B")), F.lit(False))


def _substring(data: Column, span: Column) -> Column:
    fine = _inside(data, span) & _boundary(data, span["start"]) & _boundary(data, span["stop"])
    return F.when(~has_nonempty_span(span), F.lit("")).when(fine, F.decode(_cut(data, span), "UTF-8"))


def span_codeunits(text: Column, span: Column) -> Column:
    """The bytes of a span; none of one that is empty, missing or outside the text."""
    data = _data(text)
    return F.when(has_nonempty_span(span) & _inside(data, span), _cut(data, span)).otherwise(F.lit(b""))


def is_valid_string_boundary(text: Column, index: Column) -> Column:
    """Whether a character starts at a byte, or the text ends before it."""
    return _boundary(_data(text), index)


def try_span_substring(text: Column, span: Column) -> Column:
    """The text of a span: empty for none, null if it doesn't fall on characters."""
    return _substring(_data(text), span)


def span_substrings(text: Column, spans: Column) -> Column:
    """``try_span_substring`` of each of an array of spans; the text is made into bytes once."""
    return _once(_data(text), lambda data: F.transform(spans, lambda s: _substring(data, s)))


def offsets_are_nonoverlapping(spans: Column, ignore_empty: bool = True) -> Column:
    """Whether each span starts where the one before it stopped, or later; missing ones don't count."""
    counted = F.filter(spans, has_nonempty_span if ignore_empty else has_span)
    following = F.slice(counted, F.lit(2), F.greatest(F.size(counted) - 1, F.lit(0)))
    before = F.slice(counted, F.lit(1), F.greatest(F.size(counted) - 1, F.lit(0)))
    return F.forall(F.zip_with(before, following, lambda a, b: b["start"] >= a["stop"]), lambda x: x)


def validate_offsets_contract(text: Column, spans: Column, require_string_boundaries: bool = False) -> Column:
    """Whether all spans are missing, or lie in the text."""

    def fine(data: Column, span: Column) -> Column:
        ok = _inside(data, span)
        if require_string_boundaries:
            ok &= _boundary(data, span["start"]) & _boundary(data, span["stop"])
        return ~has_span(span) | ok

    return _once(_data(text), lambda data: F.forall(spans, lambda s: fine(data, s)))


def assert_offsets_contract(text: Column, spans: Column, require_string_boundaries: bool = False) -> Column:
    """The spans; the query fails at a text that has a wrong one."""
    wrong = F.raise_error(F.concat(F.lit("a span lies outside its text: "), F.to_json(spans)))
    return F.when(validate_offsets_contract(text, spans, require_string_boundaries), spans).otherwise(wrong.cast("array<struct<start:int,stop:int>>"))
