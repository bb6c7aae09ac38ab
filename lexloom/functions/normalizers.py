"""Normalizers and pre-tokenizers as Column expressions, where Spark has what they need.

Those that Unicode tables are needed for (NFC, NFD, NFKC, accents) are in
``operators.encode.normalized``, as Arrow functions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import SPACE_CLASS, SPLIT_SPACE

_CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}]"
_BERT_PUNCTUATION = r"[!-/:-@\[-`{-~\p{P}]"
PUNCTUATION = r"[\p{P}$+<=>\^`|~]"
GPT2_SPLIT = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def word_split(text: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(text, SPLIT_SPACE), lambda w: w != "")


def literal_replacement(text: str) -> str:
    """A replacement in which no sign has a meaning of its own."""
    return re.sub(r"([\\$])", r"\\\1", text)


def lowercase(text: Column) -> Column:
    """Lower case, as long as the text has none of the letters whose lower case depends on what is around them."""
    return F.lower(text)


def replace(text: Column, pattern: str, content: str) -> Column:
    return F.regexp_replace(text, pattern, literal_replacement(content))


def prepend(text: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), text)


def bert_clean_text(text: Column) -> Column:
    """Without control and format characters; white space becomes blanks."""
    kept = F.regexp_replace(text, r"[\x{0}\x{FFFD}]|[\p{Cc}\p{Cf}&&[^\t-\r\x{85}]]", "")
    return F.regexp_replace(kept, f"[{SPACE_CLASS}]", " ")


def bert_chinese_spacing(text: Column) -> Column:
    return F.regexp_replace(text, f"({_CJK})", " $1 ")


def bert_pretokenize(text: Column) -> Column:
    """Words and lone punctuation marks, with blanks between."""
    return F.array_join(word_split(F.regexp_replace(text, f"({_BERT_PUNCTUATION})", " $1 ")), " ")


def digits(text: Column, individual: bool = False) -> Column:
    return F.regexp_replace(text, r"(\p{Nd})" if individual else r"(\p{Nd}+)", " $1 ")


def punctuation(text: Column, behavior: str = "isolated") -> Column:
    return F.regexp_replace(text, f"({PUNCTUATION})", " $1 " if behavior == "isolated" else " ")


def split(text: Column, pattern: str, behavior: str = "isolated") -> Column:
    return F.regexp_replace(text, f"({pattern})", " $1 " if behavior == "isolated" else " ")


def with_prefix_space(text: Column, add: bool = True) -> Column:
    return F.when((text != "") & ~text.startswith(" "), F.concat(F.lit(" "), text)).otherwise(text) if add else text


def metaspace(text: Column, replacement: str = "▁", add_prefix_space: bool = False) -> Column:
    return F.replace(with_prefix_space(text, add_prefix_space), F.lit(" "), F.lit(replacement))


def gpt2_split(text: Column, add_prefix_space: bool = False) -> Column:
    """The pieces within which byte-level merges happen."""
    return F.regexp_extract_all(with_prefix_space(text, add_prefix_space), F.lit(GPT2_SPLIT), F.lit(0))


def wordpiece_decoded(tokens: Column, prefix: str = "##") -> Column:
    """Words of pieces, with blanks between; pieces with the prefix go on the word before."""
    marked = F.transform(tokens, lambda t: F.when(t.startswith(prefix), F.substring(t, F.lit(len(prefix) + 1), F.length(t))).otherwise(F.concat(F.lit(" "), t)))
    return F.ltrim(F.array_join(marked, ""))


def marker_decoded(tokens: Column, marker: str) -> Column:
    """Pieces put together, a marker (of a word's end or start) being a blank."""
    return F.trim(F.replace(F.array_join(tokens, ""), F.lit(marker), F.lit(" ")))
