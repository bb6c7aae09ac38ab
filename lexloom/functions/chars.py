"""Character classes and case rules that every layer of the library agrees on.

White space is TAB to CR, blank, U+0085 and category Zs; the same class is given
to Spark, Python and SQL, as each has another default.
"""

from __future__ import annotations

import regex

#: For Java and RE2.
SPACE_CLASS = r"\t-\r \x{85}\p{Zs}"
SPLIT_SPACE = rf"[{SPACE_CLASS}]+"
_SPACE = r"[\t-\r \x85\p{Zs}]"
WORDS = regex.compile(rf"[^\t-\r \x85\p{{Zs}}]+")
SPACES = regex.compile(_SPACE)
_TRIM = regex.compile(rf"^{_SPACE}+|{_SPACE}+$")


def is_space(char: str) -> bool:
    return SPACES.match(char) is not None


def words(text: str) -> list[str]:
    return WORDS.findall(text)


def trim(text: str) -> str:
    return _TRIM.sub("", text)


def lower(text: str) -> str:
    """Lower case by each character on its own (no final sigma, no expansion)."""
    if text.isascii() or not ("Σ" in text or "İ" in text):
        return text.lower()
    return "".join(c if len(low := c.lower()) != 1 and c != "İ" else low[0] for c in text)


def byte_length(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def _printable_bytes() -> list[str]:
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


#: The printable character that stands for each byte, and back.
BYTE_CHAR = _printable_bytes()
CHAR_BYTE = {c: b for b, c in enumerate(BYTE_CHAR)}
BYTE_SPACE = BYTE_CHAR[32]


def to_byte_chars(text: str) -> str:
    return "".join([BYTE_CHAR[b] for b in text.encode("utf-8")])
