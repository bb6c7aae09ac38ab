"""The tokenizer.json format: parsing, encoding and writing.

Each block of the file is checked once and kept as a plain mapping with every
default filled in; a table of small functions, by the block's type, applies it.
So a parsed tokenizer is data that pickles and exports as it is.  Ids in the file
are from 0, in the library from 1; blocks here hold the library's.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cached_property, lru_cache
from pathlib import Path

import regex

from ..functions import chars
from .models import BPE, ByteBPE, SentencePiece, Span, Tokenizer, Unigram, WordPiece
from .vocabulary import SKIPPED_ROLES, Vocabulary, special_roles

#: The pieces within which byte-level merges happen.
BYTE_LEVEL_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_CJK = regex.compile("([一-鿿㐀-䶿\U00020000-\U0002a6df\U0002a700-\U0002b73f\U0002b740-\U0002ceaf豈-﫿\U0002f800-\U0002fa1f])")
_CONTROL = regex.compile(r"[\x00�]|[\p{Cc}\p{Cf}--[\t-\r\x85]]", regex.V1)
_PUNCT = regex.compile(r"[\p{P}$+<=>^`|~]")


class FormatError(ValueError):
    """A file that can't be read; the message has the place in the file."""


def unsupported(kind: str, name: str, at: str) -> FormatError:
    return FormatError(f"{kind} of type {name!r} at {at} isn't supported; use the model's vocab.json with merges.txt, or simplify the file")


# ---------------------------------------------------------------- parsing


class Block:
    """Typed access to a mapping of the file, with its place for messages."""

    def __init__(self, value, at: str):
        if not isinstance(value, dict):
            raise FormatError(f"{at} must be an object")
        self.value, self.at = value, at

    def need(self, key: str):
        if key not in self.value:
            raise FormatError(f"{self.at}.{key} is missing")
        return self.value[key]

    def text(self, key: str, default=...):
        v = self.need(key) if default is ... else self.value.get(key, default)
        if v is None and default is not ...:
            v = default
        if v is not None and not isinstance(v, str):
            raise FormatError(f"{self.at}.{key} must be a string")
        return v

    def flag(self, key: str, default):
        v = self.value.get(key)
        return default if v is None else bool(v)

    def number(self, key: str, default: int) -> int:
        v = self.value.get(key)
        return default if v is None else whole(v, f"{self.at}.{key}")

    def items(self, key: str) -> list:
        v = self.need(key)
        if not isinstance(v, list):
            raise FormatError(f"{self.at}.{key} must be an array")
        return v


def whole(value, at: str) -> int:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value != int(value):
        raise FormatError(f"{at} must be a whole number")
    return int(value)


def _tokens_by_id(vocab, at: str) -> list[str]:
    if not isinstance(vocab, dict) or not vocab:
        raise FormatError(f"{at} must be an object with tokens")
    placed = {whole(i, at): t for t, i in vocab.items()}
    if len(placed) != len(vocab) or set(placed) != set(range(len(vocab))):
        raise FormatError(f"{at}: ids must be 0, 1, 2, ... without gaps or repeats")
    return [placed[i] for i in range(len(vocab))]


def _merge_pairs(merges, at: str) -> list[tuple[str, str]]:
    if not isinstance(merges, list):
        raise FormatError(f"{at} must be an array")
    out = []
    for k, entry in enumerate(merges):
        pair = entry.split() if isinstance(entry, str) else entry
        if not isinstance(pair, list) or len(pair) != 2:
            raise FormatError(f"{at}[{k}] must be a pair")
        out.append((str(pair[0]), str(pair[1])))
    return out


def _pattern(value, at: str) -> str:
    found = value if isinstance(value, str) else value.get("Regex", value.get("String")) if isinstance(value, dict) else None
    if not isinstance(found, str):
        raise FormatError(f"{at} must be a pattern")
    try:
        regex.compile(found)
    except regex.error as error:
        raise FormatError(f"{at} isn't a valid pattern: {error}") from None
    return found


def parse_model(value, at: str = "$.model") -> dict:
    b = Block(value, at)
    kind = b.text("type").lower()
    if kind == "bpe":
        dropout = b.value.get("dropout")
        if dropout:
            raise FormatError(f"{at}.dropout = {dropout} isn't supported; set it to 0 or null")
        return {
            "type": "BPE",
            "vocab": _tokens_by_id(b.need("vocab"), f"{at}.vocab"),
            "merges": _merge_pairs(b.need("merges"), f"{at}.merges"),
            "unk_token": b.value.get("unk_token", "<unk>"),
            "continuing_subword_prefix": b.value.get("continuing_subword_prefix"),
            "end_of_word_suffix": b.text("end_of_word_suffix", "") or None,
            "fuse_unk": b.flag("fuse_unk", False),
            "byte_fallback": b.flag("byte_fallback", False),
            "dropout": dropout,
        }
    if kind == "wordpiece":
        return {
            "type": "WordPiece",
            "vocab": _tokens_by_id(b.need("vocab"), f"{at}.vocab"),
            "unk_token": b.text("unk_token", "[UNK]"),
            "continuing_subword_prefix": b.text("continuing_subword_prefix", "##"),
            "max_input_chars_per_word": b.number("max_input_chars_per_word", 100),
        }
    if kind == "unigram":
        tokens, scores = [], []
        for k, row in enumerate(b.items("vocab")):
            if not isinstance(row, list) or len(row) < 2 or isinstance(row[1], bool) or not isinstance(row[1], (int, float)):
                raise FormatError(f"{at}.vocab[{k}] must be [token, score]")
            tokens.append(str(row[0]))
            scores.append(float(row[1]))
        unknown = b.number("unk_id", 0)
        if not 0 <= unknown < len(tokens):
            raise FormatError(f"{at}.unk_id is outside the vocabulary")
        return {"type": "Unigram", "vocab": tokens, "scores": scores, "unk_id": unknown + 1, "byte_fallback": b.flag("byte_fallback", False)}
    raise unsupported("model", kind, at)


def parse_normalizer(value, at: str = "$.normalizer") -> dict | None:
    if value is None:
        return None
    b = Block(value, at)
    kind = b.text("type")
    if kind in ("Lowercase", "NFC", "NFD", "NFKC", "StripAccents"):
        return {"type": kind}
    if kind == "BertNormalizer":
        strip = b.value.get("strip_accents")
        return {"type": kind, "clean_text": b.flag("clean_text", True), "handle_chinese_chars": b.flag("handle_chinese_chars", True), "strip_accents": None if strip is None else bool(strip), "lowercase": b.flag("lowercase", False)}
    if kind == "Replace":
        return {"type": kind, "pattern": _pattern(b.need("pattern"), f"{at}.pattern"), "content": b.text("content", "")}
    if kind == "Prepend":
        return {"type": kind, "prepend": b.text("prepend")}
    if kind == "Sequence":
        return {"type": kind, "normalizers": [parse_normalizer(x, f"{at}.normalizers[{k}]") for k, x in enumerate(b.items("normalizers"))]}
    raise unsupported("normalizer", kind, at)


def _byte_level(b: Block) -> dict:
    return {"type": "ByteLevel", "add_prefix_space": b.flag("add_prefix_space", True), "trim_offsets": b.flag("trim_offsets", True), "use_regex": b.flag("use_regex", True)}


def _behavior(b: Block) -> str:
    found = b.text("behavior", "isolated").lower()
    if found not in ("isolated", "removed"):
        raise FormatError(f"{b.at}.behavior = {found!r} isn't supported")
    return found


def parse_pretokenizer(value, at: str = "$.pre_tokenizer") -> dict | None:
    if value is None:
        return None
    b = Block(value, at)
    kind = b.text("type")
    if kind == "ByteLevel":
        return _byte_level(b)
    if kind == "BertPreTokenizer":
        return {"type": kind}
    if kind in ("Whitespace", "WhitespaceSplit"):
        return {"type": "WhitespaceSplit"}
    if kind == "Metaspace":
        always = b.text("prepend_scheme", "").lower() == "always"
        return {"type": kind, "replacement": b.text("replacement", "▁"), "add_prefix_space": always or b.flag("add_prefix_space", False)}
    if kind == "Split":
        if b.flag("invert", False):
            raise FormatError(f"{at}.invert isn't supported")
        return {"type": kind, "pattern": _pattern(b.need("pattern"), f"{at}.pattern"), "behavior": _behavior(b)}
    if kind == "Digits":
        return {"type": kind, "individual_digits": b.flag("individual_digits", False)}
    if kind == "Punctuation":
        return {"type": kind, "behavior": _behavior(b)}
    if kind == "Sequence":
        return {"type": kind, "pretokenizers": [parse_pretokenizer(x, f"{at}.pretokenizers[{k}]") for k, x in enumerate(b.items("pretokenizers"))]}
    raise unsupported("pre_tokenizer", kind, at)


def _template_item(item, at: str) -> str:
    if isinstance(item, str):
        return item
    b = Block(item, at)
    if "Sequence" in b.value:
        return "$" + Block(b.value["Sequence"], f"{at}.Sequence").text("id").upper()
    if "SpecialToken" in b.value:
        return Block(b.value["SpecialToken"], f"{at}.SpecialToken").text("id")
    raise FormatError(f"{at} isn't an item of a template")


def _template_specials(value, at: str) -> dict[str, int]:
    if value is None:
        return {}
    entries = [(None, e, f"{at}[{k}]") for k, e in enumerate(value)] if isinstance(value, list) else [(n, e, f"{at}.{n}") for n, e in value.items()]
    out = {}
    for name, entry, place in entries:
        b = Block(entry, place)
        token = b.value.get("id") or next(iter(b.value.get("tokens") or []), name)
        ids = b.items("ids")
        if token is None or not ids:
            raise FormatError(f"{place} needs a token and its ids")
        out[str(token)] = whole(ids[0], f"{place}.ids[0]") + 1
    return out


def _token_pair(value, at: str) -> tuple[str, int]:
    if isinstance(value, list) and len(value) == 2:
        return str(value[0]), whole(value[1], at) + 1
    b = Block(value, at)
    return b.text("token"), whole(b.need("id"), f"{at}.id") + 1


def parse_postprocessor(value, at: str = "$.post_processor") -> dict | None:
    if value is None:
        return None
    b = Block(value, at)
    kind = b.text("type")
    if kind == "TemplateProcessing":
        listed = {k: [_template_item(x, f"{at}.{k}[{i}]") for i, x in enumerate(b.items(k))] for k in ("single", "pair") if b.value.get(k) is not None or k == "single"}
        return {"type": kind, "single": listed["single"], "pair": listed.get("pair", []), "special_tokens": _template_specials(b.value.get("special_tokens"), f"{at}.special_tokens")}
    if kind == "ByteLevel":
        return _byte_level(b)
    if kind in ("BertProcessing", "RobertaProcessing"):
        out = {"type": kind, "cls": _token_pair(b.need("cls"), f"{at}.cls"), "sep": _token_pair(b.need("sep"), f"{at}.sep")}
        return out | ({"trim_offsets": b.flag("trim_offsets", True), "add_prefix_space": b.flag("add_prefix_space", True)} if kind[0] == "R" else {})
    if kind == "Sequence":
        return {"type": kind, "processors": [parse_postprocessor(x, f"{at}.processors[{k}]") for k, x in enumerate(b.items("processors"))]}
    raise unsupported("post_processor", kind, at)


def parse_decoder(value, at: str = "$.decoder") -> dict | None:
    if value is None:
        return None
    b = Block(value, at)
    kind = b.text("type")
    if kind == "ByteLevel":
        return _byte_level(b)
    if kind == "WordPiece":
        return {"type": kind, "prefix": b.text("prefix", "##")}
    if kind == "BPEDecoder":
        return {"type": kind, "suffix": b.text("suffix", "</w>")}
    if kind == "Metaspace":
        return {"type": kind, "replacement": b.text("replacement", "▁"), "add_prefix_space": b.flag("add_prefix_space", True)}
    if kind == "Sequence":
        return {"type": kind, "decoders": [parse_decoder(x, f"{at}.decoders[{k}]") for k, x in enumerate(b.items("decoders"))]}
    raise unsupported("decoder", kind, at)


def parse_added(value, at: str = "$.added_tokens") -> list[dict]:
    if value is None:
        return []
    if not isinstance(value, list):
        raise FormatError(f"{at} must be an array")
    out = []
    for k, entry in enumerate(value):
        if isinstance(entry, dict) and "content" in entry and "id" in entry:
            b = Block(entry, f"{at}[{k}]")
            flags = {f: b.flag(f, f == "normalized") for f in ("special", "single_word", "lstrip", "rstrip", "normalized")}
            out.append({"content": b.text("content"), "id": whole(entry["id"], f"{b.at}.id") + 1} | flags)
    return out


def parse(root, at: str = "$") -> dict:
    """The blocks of a whole file, checked."""
    b = Block(root, at)
    cut, fill = b.value.get("truncation"), b.value.get("padding")
    if cut is not None:
        t = Block(cut, f"{at}.truncation")
        cut = {"max_length": t.number("max_length", 0), "strategy": t.text("strategy", "longest_first"), "stride": t.number("stride", 0), "direction": t.text("direction", "right")}
    if fill is not None:
        p = Block(fill, f"{at}.padding")
        length = p.value.get("length")
        strategy = p.value.get("strategy", "batch_longest")
        fill = {"strategy": strategy if isinstance(strategy, str) else json.dumps(strategy), "direction": p.text("direction", "right"), "pad_id": p.number("pad_id", 0) + 1, "pad_type_id": p.number("pad_type_id", 0), "pad_token": p.text("pad_token", "[PAD]"), "length": length or 0}
    return {
        "model": parse_model(b.need("model")),
        "normalizer": parse_normalizer(b.value.get("normalizer")),
        "pre_tokenizer": parse_pretokenizer(b.value.get("pre_tokenizer")),
        "post_processor": parse_postprocessor(b.value.get("post_processor")),
        "decoder": parse_decoder(b.value.get("decoder")),
        "added_tokens": parse_added(b.value.get("added_tokens")),
        "truncation": cut,
        "padding": fill,
    }


# ---------------------------------------------------------------- applying


@lru_cache(256)
def _compiled(pattern: str):
    return regex.compile(pattern)


def clean_text(text: str) -> str:
    return chars.SPACES.sub(" ", _CONTROL.sub("", text))


def _bert_normal(b: dict, text: str) -> str:
    if b["clean_text"]:
        text = clean_text(text)
    if b["handle_chinese_chars"]:
        text = _CJK.sub(r" \1 ", text)
    if b["lowercase"]:
        text = chars.lower(text)
    if b["lowercase"] if b["strip_accents"] is None else b["strip_accents"]:
        text = regex.sub(r"\p{Mn}+", "", unicodedata.normalize("NFD", text))
    return text


_NORMALIZE = {
    "Lowercase": lambda b, t: chars.lower(t),
    "NFC": lambda b, t: unicodedata.normalize("NFC", t),
    "NFD": lambda b, t: unicodedata.normalize("NFD", t),
    "NFKC": lambda b, t: unicodedata.normalize("NFKC", t),
    "StripAccents": lambda b, t: regex.sub(r"\p{M}+", "", unicodedata.normalize("NFD", t)),
    "BertNormalizer": _bert_normal,
    "Replace": lambda b, t: _compiled(b["pattern"]).sub(lambda m: b["content"], t),
    "Prepend": lambda b, t: b["prepend"] + t,
    "Sequence": lambda b, t: _chain(normalize, b["normalizers"], t),
}


def _chain(step, blocks, value):
    for b in blocks:
        value = step(b, value)
    return value


def normalize(block: dict | None, text: str) -> str:
    return text if block is None else _NORMALIZE[block["type"]](block, text)


_BERT_PIECE = regex.compile(r"[^\t-\r \x85\p{Zs}!-/:-@\[-`{-~\p{P}]+|[!-/:-@\[-`{-~\p{P}]")


def bert_pieces(text: str) -> list[tuple[str, int]]:
    """Words and lone punctuation marks, with their first character's place."""
    return [(m.group(), m.start()) for m in _BERT_PIECE.finditer(text)]


def _with_prefix(block: dict, text: str) -> str:
    return " " + text if block["add_prefix_space"] and text and not text.startswith(" ") else text


_PRETOKENIZE = {
    "WhitespaceSplit": lambda b, t: t,
    "BertPreTokenizer": lambda b, t: " ".join(_BERT_PIECE.findall(t)),
    "ByteLevel": _with_prefix,
    "Metaspace": lambda b, t: _with_prefix(b, t).replace(" ", b["replacement"]),
    "Split": lambda b, t: _compiled(b["pattern"]).sub((lambda m: f" {m.group()} ") if b["behavior"] == "isolated" else " ", t),
    "Digits": lambda b, t: _compiled(r"(\p{Nd})" if b["individual_digits"] else r"(\p{Nd}+)").sub(r" \1 ", t),
    "Punctuation": lambda b, t: _PUNCT.sub((lambda m: f" {m.group()} ") if b["behavior"] == "isolated" else " ", t),
    "Sequence": lambda b, t: _chain(pretokenize, b["pretokenizers"], t),
}


def pretokenize(block: dict | None, text: str) -> str:
    return text if block is None else _PRETOKENIZE[block["type"]](block, text)


def effective(block: dict | None) -> dict | None:
    """The one stage of a pre-tokenizer that spans can be followed through ({"type": "None"} if none is needed); None if there isn't one."""
    plain = {"type": "None"}
    if block is None:
        return plain
    if block["type"] in ("WhitespaceSplit", "BertPreTokenizer", "ByteLevel", "Metaspace"):
        return block
    if block["type"] != "Sequence":
        return None
    found = None
    for item in map(effective, block["pretokenizers"]):
        if item is None or (found and item["type"] not in ("None", "WhitespaceSplit") and item["type"] != found["type"]):
            return None
        if item["type"] not in ("None", "WhitespaceSplit"):
            found = item
    return found or plain


def uses_byte_level(block: dict | None) -> bool:
    return block is not None and (block["type"] == "ByteLevel" or any(map(uses_byte_level, block.get("pretokenizers", block.get("decoders", [])))))


_DECODE = {
    "ByteLevel": lambda b, t: t,
    "WordPiece": lambda b, t: t.replace(b["prefix"], "") if b["prefix"] else t,
    "BPEDecoder": lambda b, t: chars.trim(t.replace(b["suffix"], " ") if b["suffix"] else t),
    "Metaspace": lambda b, t: (chars.trim if b["add_prefix_space"] else str)(t.replace(b["replacement"], " ")),
    "Sequence": lambda b, t: _chain(apply_decoder, b["decoders"], t),
}


def apply_decoder(block: dict | None, text: str) -> str:
    return text if block is None else _DECODE[block["type"]](block, text)


def _role_of(token: str) -> str | None:
    exact = {"unk": ("<unk>", "<UNK>", "[UNK]"), "pad": ("[PAD]", "<pad>"), "bos": ("<s>", "[BOS]", "<|begin_of_text|>", "<|bos|>"), "eos": ("</s>", "[EOS]", "<|endoftext|>", "<|end_of_text|>", "<|eot_id|>"), "cls": ("[CLS]",), "sep": ("[SEP]",)}
    for role, spellings in exact.items():
        if token in spellings:
            return role
    low = token.lower()
    return next((role for part, role in (("pad", "pad"), ("bos", "bos"), ("eos", "eos"), ("eot", "eos"), ("unk", "unk")) if part in low), None)


def _post_specials(block: dict | None) -> dict[str, int]:
    if block is None:
        return {}
    if block["type"] == "TemplateProcessing":
        return dict(block["special_tokens"])
    if "cls" in block:
        return {block[k][0]: block[k][1] for k in ("cls", "sep")}
    return {t: i for item in block.get("processors", []) for t, i in _post_specials(item).items()}


def with_added(tokens: list[str], added: list[dict]) -> list[str]:
    """Tokens with the added ones at their ids; a taken id keeps its token, a gap is filled."""
    out = tokens + [None] * max(0, max((a["id"] for a in added), default=0) - len(tokens))
    for a in added:
        if a["id"] >= 1 and out[a["id"] - 1] is None:
            out[a["id"] - 1] = a["content"]
    return [f"<unused_{k}>" if t is None else t for k, t in enumerate(out, 1)]


def base_of(model: dict, name: str) -> Tokenizer:
    tokens = model["vocab"]
    if model["type"] == "BPE":
        unknown = model["unk_token"]
        if unknown is None:
            unknown = next((t for t in ("<|endoftext|>", "[UNK]") if t in tokens), None)
        if unknown is None:
            raise FormatError('the BPE model has no unknown token and none can be inferred: add "<|endoftext|>" or "[UNK]", or set unk_token')
        vocabulary = Vocabulary.build(tokens, special_roles(tokens, unknown))
        ranks = {pair: k for k, pair in enumerate(model["merges"], 1)}
        return (ByteBPE if model["byte_level"] else BPE)(vocabulary, ranks, unknown, model["end_of_word_suffix"], name)
    if model["type"] == "WordPiece":
        return WordPiece(Vocabulary.build(tokens, special_roles(tokens, model["unk_token"])), model["continuing_subword_prefix"], model["unk_token"], model["max_input_chars_per_word"], name)
    unknown = tokens[model["unk_id"] - 1]
    return Unigram(Vocabulary.build(tokens, special_roles(tokens, unknown)), model["scores"], unknown, "", name)


class Pipeline(Tokenizer):
    """A tokenizer.json: added tokens, normalizer, pre-tokenizer, model, post-processor, decoder."""

    format = "hf_tokenizer_json"
    needs_normalization = True

    def __init__(self, blocks: dict, name: str, version: str = "0.5.0"):
        model = dict(blocks["model"])
        added = blocks["added_tokens"]
        tokens = with_added(model["vocab"], added)
        if model["type"] == "Unigram":
            model["scores"] = model["scores"] + [-99.0] * (len(tokens) - len(model["vocab"]))
        if model["type"] == "BPE":
            model["byte_level"] = uses_byte_level(blocks["pre_tokenizer"]) or uses_byte_level(blocks["decoder"])
        model["vocab"] = tokens
        self.blocks = blocks | {"model": model}
        self.base = base_of(model, name)
        super().__init__(self.base.vocabulary, name, version)
        self.token_specials = {a["content"]: a["id"] for a in added if a["special"]} | _post_specials(blocks["post_processor"])
        self.roles = self.base.special_tokens() | {r: i for t, i in self.token_specials.items() if (r := _role_of(t))}
        passes: tuple[list, list, list] = ([], [], [])
        for a in added:
            which = 0 if a["special"] else 2 if a["normalized"] else 1
            content = normalize(blocks["normalizer"], a["content"]) if which == 2 else a["content"]
            if content:
                passes[which].append((content, a["id"], a["single_word"], a["lstrip"], a["rstrip"]))
        self.passes = [sorted(p, key=lambda x: (-len(x[0]), x[0])) for p in passes]

    @property
    def unknown(self) -> str:
        return self.base.unknown

    def model_info(self) -> dict[str, str]:
        return super().model_info() | {"normalizer": "hf_json"}

    def special_tokens(self) -> dict[str, int]:
        return dict(self.roles)

    def special_ids(self) -> set[int]:
        return {*self.roles.values(), *self.token_specials.values()}

    def role_id(self, role: str) -> int | None:
        return self.roles.get(role, self.base.role_id(role))

    def normalize(self, text: str) -> str:
        return normalize(self.blocks["normalizer"], text)

    @cached_property
    def stage(self) -> dict | None:
        return effective(self.blocks["pre_tokenizer"])

    def __getstate__(self):
        return {k: v for k, v in super().__getstate__().items() if k not in ("stage", "splits_bytes")}

    @cached_property
    def splits_bytes(self) -> bool:
        return isinstance(self.base, ByteBPE) and chars.BYTE_SPACE in self.vocabulary.ids

    # ---- segments

    def segments(self, text: str, assume_normalized: bool) -> list[tuple[str, int, int]]:
        """(text, id or 0, start in bytes from 0) of the added tokens and of what is between; starts are of the text as given."""
        out = []
        for piece, i, at in _split_added(text, self.passes[0]):
            for piece2, i2, at2 in [(piece, i, 0)] if i else _split_added(piece, self.passes[1]):
                if i2:
                    out.append((piece2, i2, at + at2))
                    continue
                view = piece2 if assume_normalized else self.normalize(piece2)
                out += [(p, k, at + at2 + a) for p, k, a in _split_added(view, self.passes[2])]
        return out

    def encode(self, text: str, add_special_tokens: bool = False, assume_normalized: bool = False) -> list[int]:
        ids: list[int] = []
        for piece, i, _ in self.segments(text, assume_normalized):
            ids += [i] if i else self.segment_ids(piece)
        return self.post(self.blocks["post_processor"], ids) if add_special_tokens else ids

    def tokenize(self, text: str) -> list[str]:
        return [self.id_to_token(i) for i in self.encode(text)]

    def segment_ids(self, text: str) -> list[int]:
        stage = self.stage
        if stage and stage["type"] == "ByteLevel":
            if stage["use_regex"] and self.splits_bytes:
                memo, ids = self.base.memo, self.token_to_id
                return [ids(p) for piece in BYTE_LEVEL_SPLIT.findall(_with_prefix(stage, text)) for p in memo[piece]]
            return self.model_ids(_with_prefix(stage, text))
        return self.model_ids(pretokenize(self.blocks["pre_tokenizer"], text))

    def model_ids(self, text: str) -> list[int]:
        fallback = self.blocks["model"].get("byte_fallback") and not isinstance(self.base, ByteBPE)
        if not fallback:
            return self.base.encode(text)
        out = []
        for word in chars.words(text):
            pieces = self.base.memo[word]
            out += [self.token_to_id(p) for p in (self.byte_tokens(word) if pieces == [self.unknown] else pieces)]
        return out

    def byte_tokens(self, word: str) -> list[str]:
        """A word as tokens of its bytes, if the vocabulary has them all."""
        ids, data = self.vocabulary.ids, word.encode("utf-8")
        mapped = [chars.BYTE_CHAR[b] for b in data]
        if mapped and all(p in ids for p in mapped):
            end = getattr(self.base, "end", None)
            return mapped + ([end] if end is not None and end in ids else [])
        coded = [f"<0x{b:02X}>" for b in data]
        return coded if coded and all(p in ids for p in coded) else [self.unknown]

    def post(self, block: dict | None, ids: list[int]) -> list[int]:
        if block is None:
            return self.wrapped(ids)
        if block["type"] == "Sequence":
            return _chain(self.post, block["processors"], ids)
        if "cls" in block:
            return [block["cls"][1], *ids, block["sep"][1]]
        if block["type"] == "ByteLevel":
            return ids
        out: list[int] = []
        for item in block["single"] or ["$A"]:
            if item.startswith(("$A", "$0")):
                out += ids
            elif item.startswith(("$B", "$1")):
                raise ValueError(f"template item {item!r} needs a pair of texts")
            else:
                out.append(block["special_tokens"].get(item) or self.token_specials.get(item) or self.token_to_id(item))
        return out

    def decode(self, ids) -> str:
        skip = {self.roles[r] for r in SKIPPED_ROLES if r in self.roles}
        return apply_decoder(self.blocks["decoder"], self.base.decode([i for i in ids if i not in skip]))

    # ---- spans

    def offsets(self, text: str, tokens: list[str], ids: list[int]) -> list[Span] | None:
        out: list[Span] = []
        at = 0
        for piece, i, start in self.segments(text, True):
            own = [i] if i else self.segment_ids(piece)
            if ids[at : at + len(own)] != own:
                return None
            at += len(own)
            spans = [(1, chars.byte_length(piece) + 1)] if i else self.segment_spans(piece, [self.id_to_token(k) for k in own], own)
            if spans is None or len(spans) != len(own):
                return None
            out += [(a + start, b + start) for a, b in spans]
        if at != len(ids):
            return None
        trim, prefix = _trims(self.blocks["post_processor"])
        if trim:
            stage = self.stage
            _trim_spans(tokens, out, stage["add_prefix_space"] if stage and stage["type"] == "ByteLevel" else prefix, text)
        return out

    def segment_spans(self, text: str, tokens: list[str], ids: list[int]) -> list[Span] | None:
        stage = self.stage
        if stage is None:
            return None
        kind = stage["type"]
        if kind in ("None", "WhitespaceSplit"):
            if self.blocks["model"].get("byte_fallback") and type(self.base) is BPE:
                spans = self._word_spans(text, tokens, lambda w: w, self.model_ids, self._fallback_bytes)
                if spans is not None:
                    return spans
            return self.base.offsets(text, tokens, ids)
        if kind == "BertPreTokenizer":
            return self._bert_spans(text, tokens)
        if kind == "Metaspace":
            return self._metaspace_spans(text, tokens, stage["replacement"])
        return self._byte_level_spans(text, tokens, ids, stage)

    def _word_spans(self, text, tokens, written, encode, size) -> list[Span] | None:
        """Word by word, with the bytes of each piece by ``size``."""
        out: list[Span] = []
        at = used = total = 0
        for m in chars.WORDS.finditer(text):
            word = m.group()
            total += chars.byte_length(text[used : m.start()])
            used, start = m.start(), total + 1
            end, cursor = start + chars.byte_length(word), start
            for piece in [self.id_to_token(i) for i in encode(written(word))]:
                if at >= len(tokens) or tokens[at] != piece:
                    return None
                at += 1
                if piece == self.unknown:
                    out.append((start, end))
                    cursor = end
                    continue
                n = size(piece, word, cursor - start)
                if n is None or cursor + n > end:
                    return None
                out.append((cursor, cursor + n))
                cursor += n
        return out if at == len(tokens) else None

    def _fallback_bytes(self, piece: str, word: str, done: int) -> int | None:
        clean = self.base.strip(piece)
        if len(clean) == 6 and clean.startswith("<0x") and clean.endswith(">"):
            return 1 if all(c in "0123456789abcdefABCDEF" for c in clean[3:5]) else None
        return chars.byte_length(clean)

    def _metaspace_spans(self, text: str, tokens: list[str], replacement: str) -> list[Span] | None:
        def size(piece: str, word: str, done: int) -> int:
            clean = len(piece.replace(replacement, ""))
            rest = word.encode("utf-8")[done:].decode("utf-8", "replace")
            return chars.byte_length(rest[:clean])

        if not replacement:
            return None
        return self._word_spans(text, tokens, lambda w: replacement + w, self.base.encode, size)

    def _bert_spans(self, text: str, tokens: list[str]) -> list[Span] | None:
        out: list[Span] = []
        used = start = 0
        for piece, place in bert_pieces(text):
            ids = self.model_ids(piece)
            own = [self.id_to_token(i) for i in ids]
            spans = self.base.offsets(piece, own, ids)
            if spans is None or tokens[len(out) : len(out) + len(own)] != own:
                return None
            start += chars.byte_length(text[used:place])
            used = place
            out += [(a + start, b + start) for a, b in spans]
        return out if len(out) == len(tokens) else None

    def _byte_level_spans(self, text: str, tokens: list[str], ids: list[int], stage: dict) -> list[Span] | None:
        work = _with_prefix(stage, text)
        shift = len(work) - len(text)
        if not (stage["use_regex"] and self.splits_bytes):
            spans = self.base.offsets(work, tokens, ids)
            if spans is None or not shift:
                return spans
            moved = [(a - shift, b - shift) for a, b in spans]
            return moved if all(a >= 1 for a, _ in moved) else None
        last, start, out = chars.byte_length(text) + 1, 1, []
        clamp = lambda x: min(max(x - shift, 1), last)
        for piece in BYTE_LEVEL_SPLIT.findall(work):
            spans = self.base.word_spans(piece, self.base.memo[piece], start)
            if spans is None:
                return None
            out += [(clamp(a), max(clamp(a), clamp(b))) for a, b in spans]
            start += chars.byte_length(piece)
        return out if len(out) == len(tokens) else None


def _split_added(text: str, patterns: list[tuple]) -> list[tuple[str, int, int]]:
    """(text, id or 0, bytes before it)."""
    if not text:
        return []
    if not patterns:
        return [(text, 0, 0)]
    alternatives = "|".join(dict.fromkeys(("[\\t-\\r \\x85\\p{Zs}]*" if p[3] else "") + regex.escape(p[0], special_only=False) for p in patterns))
    candidate = _compiled(alternatives)
    out, done, i = [], 0, 0
    while (hit := candidate.search(text, i)) is not None:
        i = hit.start()
        best = None
        for p in patterns:
            end = _match_added(text, i, p)
            if end is not None and (best is None or (end, len(p[0])) > (best[0], len(best[1][0]))):
                best = (end, p)
        if best is None:
            i += 1
            continue
        if done < i:
            out.append((text[done:i], 0, chars.byte_length(text[:done])))
        out.append((text[i : best[0]], best[1][1], chars.byte_length(text[:i])))
        done = i = best[0]
    if done < len(text):
        out.append((text[done:], 0, chars.byte_length(text[:done])))
    return out


def _match_added(text: str, i: int, pattern: tuple) -> int | None:
    content, _, single, left, right = pattern
    core = i
    while left and core < len(text) and chars.is_space(text[core]):
        core += 1
    if not text.startswith(content, core):
        return None
    end = core + len(content)
    if single and any(c == "_" or unicodedata.category(c)[0] in "LN" for c in text[max(core - 1, 0) : core] + text[end : end + 1]):
        return None
    while right and end < len(text) and chars.is_space(text[end]):
        end += 1
    return end


def _trims(block: dict | None) -> tuple[bool, bool]:
    if block is None:
        return False, False
    if block["type"] == "Sequence":
        return next((t for t in map(_trims, block["processors"]) if t[0]), (False, False))
    return block.get("trim_offsets", False), block.get("add_prefix_space", False)


def _trim_spans(tokens: list[str], spans: list[Span], prefix: bool, text: str) -> None:
    blank = lambda c: c == chars.BYTE_SPACE or chars.is_space(c)
    for k, (token, (a, b)) in enumerate(zip(tokens, spans)):
        if (a, b) == (0, 0) or not token:
            continue
        lead = next((n for n, c in enumerate(token) if not blank(c)), len(token))
        trail = next((n for n, c in enumerate(reversed(token[lead:])) if not blank(c)), len(token) - lead)
        if prefix and k == 0 and lead and a == 1 and token[0] == chars.BYTE_SPACE and not (text and chars.is_space(text[0])):
            lead -= 1
        a = min(a + lead, b)
        spans[k] = (a, max(b - trail, a))


# ---------------------------------------------------------------- reading and writing


def load_pipeline(path, name: str | None = None) -> Pipeline:
    path = Path(path)
    path = path / "tokenizer.json" if path.is_dir() else path
    try:
        root = json.loads(path.read_text(encoding="utf-8"))
    except json.JSONDecodeError as error:
        raise FormatError(f"{path} isn't JSON: {error}") from None
    return Pipeline(parse(root), name or path.name)


def _written(block: dict | None):
    """A block as the file has it."""
    if block is None:
        return None
    out = dict(block)
    for key in ("normalizers", "pretokenizers", "processors", "decoders"):
        if key in out:
            out[key] = [_written(x) for x in out[key]]
    if "pattern" in out:
        out["pattern"] = {"Regex": out["pattern"]}
    if out["type"] == "Split":
        out["invert"] = False
    for key in ("cls", "sep"):
        if key in out:
            out[key] = [out[key][0], out[key][1] - 1]
    if out["type"] == "TemplateProcessing":
        out |= {k: _written_template(out[k]) for k in ("single", "pair")}
        out["special_tokens"] = {t: {"id": t, "ids": [i - 1], "tokens": [t]} for t, i in out["special_tokens"].items()}
    return out


def _written_template(items: list[str]) -> list[dict]:
    out, second = [], 0
    for item in items:
        if item in ("$A", "$B"):
            second = int(item == "$B")
            out.append({"Sequence": {"id": item[1], "type_id": second}})
        else:
            out.append({"SpecialToken": {"id": item, "type_id": second}})
    return out


def _written_model(model: dict) -> dict:
    out = {k: v for k, v in model.items() if k not in ("byte_level", "scores")}
    if model["type"] == "Unigram":
        return out | {"vocab": [list(x) for x in zip(model["vocab"], model["scores"])], "unk_id": model["unk_id"] - 1}
    out["vocab"] = {t: k for k, t in enumerate(model["vocab"])}
    if "merges" in out:
        out["merges"] = [" ".join(p) for p in model["merges"]]
    return out


def ranked_pairs(ranks: dict[tuple[str, str], int]) -> list[tuple[str, str]]:
    return [p for p, _ in sorted(ranks.items(), key=lambda x: (x[1], x[0]))]


def family_blocks(model: Tokenizer) -> dict:
    """The blocks by which a tokenizer of another family is written."""
    inner = model.inner if isinstance(model, SentencePiece) else model
    split = {"type": "WhitespaceSplit"}
    flat = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
    marker = getattr(model, "marker", "")
    pre: dict = split
    decoder: dict | None = None
    if isinstance(model, ByteBPE):
        pre = {"type": "Sequence", "pretokenizers": [split, flat]}
        decoder = {"type": "Sequence", "decoders": [{"type": "BPEDecoder", "suffix": model.end}, flat]} if model.end is not None else flat
    elif isinstance(model, BPE) and model.end is not None:
        decoder = {"type": "BPEDecoder", "suffix": model.end}
    elif isinstance(model, WordPiece):
        decoder = {"type": "WordPiece", "prefix": model.prefix}
    if marker:
        pre = {"type": "Sequence", "pretokenizers": [split, {"type": "Metaspace", "replacement": marker, "add_prefix_space": True}]}
        decoder = {"type": "Metaspace", "replacement": marker, "add_prefix_space": True}
    tokens = list(model.vocabulary.tokens)
    if isinstance(inner, BPE):
        block = {"type": "BPE", "vocab": tokens, "merges": ranked_pairs(inner.ranks), "unk_token": inner.unknown_token, "continuing_subword_prefix": None, "end_of_word_suffix": inner.end, "fuse_unk": False, "byte_fallback": False, "dropout": None}
    elif isinstance(inner, WordPiece):
        block = {"type": "WordPiece", "vocab": tokens, "unk_token": inner.unknown_token, "continuing_subword_prefix": inner.prefix, "max_input_chars_per_word": inner.most_chars}
    elif isinstance(inner, Unigram):
        block = {"type": "Unigram", "vocab": tokens, "scores": list(inner.scores), "unk_id": inner.unk_id(), "byte_fallback": False}
    else:
        raise ValueError(f"the family {model.format} can't be written as tokenizer.json")
    roles = model.special_tokens()
    if isinstance(model, WordPiece):
        ends = [roles.get(r) for r in ("cls", "sep")]
        post = None if None in ends else {"type": "BertProcessing", "cls": (tokens[ends[0] - 1], ends[0]), "sep": (tokens[ends[1] - 1], ends[1])}
    else:
        bos, eos = ([tokens[roles[r] - 1]] if r in roles else [] for r in ("bos", "eos"))
        post = {"type": "TemplateProcessing", "single": [*bos, "$A", *eos], "pair": [*bos, "$A", *eos, "$B", *eos], "special_tokens": {t: model.token_to_id(t) for t in bos + eos}} if bos or eos else None
    added = [{"id": i, "content": tokens[i - 1], "special": True, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False} for i in sorted(set(roles.values()))]
    return {"model": block, "normalizer": None, "pre_tokenizer": pre, "post_processor": post, "decoder": decoder, "added_tokens": added, "truncation": None, "padding": None}


def dump(model: Tokenizer) -> dict:
    blocks = model.blocks if isinstance(model, Pipeline) else family_blocks(model)
    fill = blocks["padding"]
    return {
        "version": "1.0",
        "truncation": blocks["truncation"],
        "padding": fill and fill | {"pad_id": fill["pad_id"] - 1},
        "added_tokens": [a | {"id": a["id"] - 1} for a in sorted(blocks["added_tokens"], key=lambda a: (a["id"], a["content"]))],
        **{k: _written(blocks[k]) for k in ("normalizer", "pre_tokenizer", "post_processor", "decoder")},
        "model": _written_model(blocks["model"]),
    }


