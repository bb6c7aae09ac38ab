"""Reading tokenizer files, telling their format, and writing them."""

from __future__ import annotations

import base64
import json
import os
import struct
from dataclasses import dataclass, fields
from pathlib import Path

from ..functions import chars
from ..operators.models import BPE, ByteBPE, SentencePiece, Tiktoken, Tokenizer, Unigram, WordPiece
from ..operators.pipeline_json import Pipeline, dump, load_pipeline, ranked_pairs
from ..operators.vocabulary import Vocabulary, resolve_unknown, special_roles

MARKER = "▁"
SAMPLE_BYTES = 2048
SENTENCEPIECE_NAMES = ("spm.model", "spiece.model", "tokenizer.model", "tokenizer.model.v3", "sentencepiece.bpe.model")
_MODEL_SUFFIXES = (".model", ".model.v3")


def _lines(path: Path) -> list[str]:
    return [s for s in (chars.trim(line) for line in path.read_text(encoding="utf-8").split("\n")) if s]


def _existing(path, what: str) -> Path:
    path = Path(path)
    if not path.is_file():
        raise FileNotFoundError(f"no {what} at {path}")
    return path


def read_tokens(path) -> list[str]:
    """One token a line, stripped; blank lines are skipped."""
    tokens = _lines(_existing(path, "token list"))
    if not tokens:
        raise ValueError(f"{path} has no tokens")
    return tokens


def read_merges(path) -> list[tuple[str, str]]:
    out = []
    for line in _lines(_existing(path, "merges")):
        if line.startswith("#"):
            continue
        pair = chars.words(line)
        if len(pair) != 2:
            raise ValueError(f"{path}: {line!r} isn't a pair")
        out.append((pair[0], pair[1]))
    return out


def _ranks(pairs) -> dict[tuple[str, str], int]:
    return {p: k for k, p in enumerate(pairs, 1)}


def _vocabulary(tokens, unknown: str) -> Vocabulary:
    return Vocabulary.build(tokens, special_roles(tokens, unknown))


def _vocab_and_merges(path, merges) -> tuple[Path, Path]:
    path = Path(path)
    if merges is not None:
        return path, Path(merges)
    if path.is_dir():
        path = path / "vocab.txt"
    return path, path.parent / "merges.txt"


def load_bpe(path, merges=None, unk_token: str = "<unk>", end_of_word_marker: str | None = "</w>", model_name: str | None = None, _kind=BPE) -> BPE:
    """From a folder or vocab.txt with merges.txt beside it, or from both files.  The end marker is used if the vocabulary has it."""
    vocab, pairs = _vocab_and_merges(path, merges)
    tokens = read_tokens(vocab)
    unknown = resolve_unknown(tokens, unk_token)
    return _kind(_vocabulary(tokens, unknown), _ranks(read_merges(pairs)), unknown, end_of_word_marker or None, model_name or Path(path).name)


def load_bytebpe(path, merges=None, unk_token: str = "<unk>", end_of_word_marker: str | None = "</w>", model_name: str | None = None) -> ByteBPE:
    return load_bpe(path, merges, unk_token, end_of_word_marker, model_name, _kind=ByteBPE)


def load_wordpiece(path, continuation_prefix: str = "##", unk_token: str = "[UNK]", max_input_chars_per_word: int = 100, model_name: str | None = None) -> WordPiece:
    file = Path(path) / "vocab.txt" if Path(path).is_dir() else Path(path)
    tokens = read_tokens(file)
    if unk_token not in tokens:
        raise ValueError(f"{file} lacks the unknown token {unk_token!r}")
    return WordPiece(_vocabulary(tokens, unk_token), continuation_prefix, unk_token, max_input_chars_per_word, model_name or Path(path).name)


def load_unigram(path, whitespace_marker: str | None = None, unk_token: str = "<unk>", model_name: str | None = None) -> Unigram:
    """From token, score and perhaps role, tab-separated.  A missing unknown token comes first, with score -99."""
    file = _existing(Path(path) / "unigram.tsv" if Path(path).is_dir() else path, "unigram table")
    tokens, scores, roles, noted = [], [], {}, None
    for line in _lines(file):
        if line.startswith("#"):
            noted = line.removeprefix("# whitespace_marker=") if line.startswith("# whitespace_marker=") else noted
            continue
        row = line.split("\t")
        try:
            score = float(row[1])
        except (IndexError, ValueError):
            raise ValueError(f"{file}: {line!r} isn't a token with a score") from None
        tokens.append(row[0])
        scores.append(score)
        if len(row) > 2 and (role := chars.trim(row[2])):
            roles[role] = row[0]
    if not tokens:
        raise ValueError(f"{file} has no tokens")
    unknown = roles.get("unk", unk_token)
    if unknown not in tokens:
        tokens.insert(0, unknown)
        scores.insert(0, -99.0)
    roles = special_roles(tokens, unknown) | roles | {"unk": unknown}
    marker = whitespace_marker if whitespace_marker is not None else noted or ""
    return Unigram(Vocabulary.build(tokens, roles), scores, unknown, marker, model_name or Path(path).name)


# ---------------------------------------------------------------- SentencePiece


@dataclass
class Pieces:
    """What a SentencePiece file says."""

    kind: str
    tokens: list[str]
    scores: list[float]
    roles: dict[str, str]
    merges: list[tuple[str, str]]
    unknown: str = "<unk>"
    marker: str = MARKER

    def completed(self) -> Pieces:
        if "unk" not in self.roles:
            if self.unknown not in self.tokens:
                self.tokens.insert(0, self.unknown)
                self.scores.insert(0, -99.0)
            self.roles["unk"] = self.unknown
        return self


def _pieces_of_text(path: Path) -> Pieces:
    out = Pieces("unigram", [], [], {}, [])
    for line in _lines(path):
        if line.startswith("#"):
            continue
        if "=" in line:
            key, value = (chars.trim(x) for x in line.split("=", 1))
            if key == "type":
                out.kind = value.lower()
            elif key == "whitespace_marker":
                out.marker = value
            elif key == "unk_token":
                out.unknown = value
            continue
        row = line.split("\t")
        if row[0] == "piece" and len(row) >= 3:
            out.tokens.append(row[1])
            out.scores.append(float(row[2]))
            if len(row) > 3:
                out.roles[chars.trim(row[3])] = row[1]
        elif row[0] == "merge" and len(row) == 3:
            out.merges.append((row[1], row[2]))
        else:
            raise ValueError(f"{path}: can't read the row {line!r}")
    if not out.tokens:
        raise ValueError(f"{path} has no pieces")
    return out.completed()


class Wire:
    """Fields of a protocol-buffer message."""

    def __init__(self, data: bytes, path: Path):
        self.data, self.at, self.path = data, 0, path

    def _take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError(f"{self.path}: the message ends early")
        out = self.data[self.at : self.at + n]
        self.at += n
        return out

    def varint(self) -> int:
        out = shift = 0
        while True:
            (byte,) = self._take(1)
            out |= (byte & 0x7F) << shift
            if byte < 0x80:
                return out
            shift += 7
            if shift > 63:
                raise ValueError(f"{self.path}: a number is too long")

    def fields(self):
        """(number, wire type, value)."""
        while self.at < len(self.data):
            key = self.varint()
            wire = key & 7
            if wire == 0:
                value: int | bytes = self.varint()
            elif wire == 2:
                value = self._take(self.varint())
            elif wire in (1, 5):
                value = self._take(8 if wire == 1 else 4)
            else:
                raise ValueError(f"{self.path}: unknown wire type {wire}")
            yield key >> 3, wire, value


def _pieces_of_proto(data: bytes, path: Path) -> Pieces:
    out = Pieces("unigram", [], [], {}, [])
    for number, wire, message in Wire(data, path).fields():
        if (number, wire) != (1, 2):
            continue
        token, score, kind = "", -99.0, 1
        for n, w, value in Wire(message, path).fields():
            if (n, w) == (1, 2):
                token = value.decode("utf-8", "replace")
            elif (n, w) == (2, 5):
                (score,) = struct.unpack("<f", value)
            elif (n, w) == (3, 0):
                kind = value
        if not token:
            continue
        out.tokens.append(token)
        out.scores.append(score)
        if kind == 2:
            out.roles["unk"] = out.unknown = token
        elif role := {"<pad>": "pad", "<s>": "bos", "</s>": "eos"}.get(token):
            out.roles[role] = token
    if not out.tokens:
        raise ValueError(f"{path} has no pieces")
    return out.completed()


def _sentencepiece_file(path) -> Path:
    path = Path(path)
    if not path.is_dir():
        return _existing(path, "SentencePiece model")
    for name in SENTENCEPIECE_NAMES:
        if (path / name).is_file():
            return path / name
    models = sorted(p for p in path.iterdir() if p.name.lower().endswith(_MODEL_SUFFIXES))
    if len(models) != 1:
        raise FileNotFoundError(f"{path} needs one of {', '.join(SENTENCEPIECE_NAMES)}, or exactly one model file")
    return models[0]


def load_sentencepiece(path, kind: str = "auto", model_name: str | None = None) -> SentencePiece:
    file = _sentencepiece_file(path)
    if kind not in ("auto", "unigram", "bpe"):
        raise ValueError(f"kind {kind!r} isn't auto, unigram or bpe")
    if file.name.lower().endswith(_MODEL_SUFFIXES) and is_tiktoken_text(sample(file)):
        raise ValueError(f"{file} is a list of byte tokens with ranks; read it with load_tiktoken")
    found = None
    head = sample(file)[:256]
    if b"\0" not in head and (b"type=" in head or b"piece\t" in head):
        try:
            found = _pieces_of_text(file)
        except ValueError:
            pass  # then it may be a binary one that looks like text
    found = found or _pieces_of_proto(file.read_bytes(), file)
    if kind != "auto" and kind != found.kind:
        raise ValueError(f"{file} is of type {found.kind}, not {kind}")
    name = model_name or file.name
    vocabulary = Vocabulary.build(found.tokens, found.roles)
    if found.unknown not in vocabulary.ids:
        raise ValueError(f"{file} lacks the unknown token {found.unknown!r}")
    if found.kind == "unigram":
        return SentencePiece(Unigram(vocabulary, found.scores, found.unknown, found.marker, name), found.marker, name)
    if found.kind == "bpe":
        return SentencePiece(BPE(vocabulary, _ranks(found.merges), found.unknown, None, name), found.marker, name)
    raise ValueError(f"{file}: type {found.kind!r} isn't supported")


# ---------------------------------------------------------------- tiktoken and GPT-2 files


def sample(path) -> bytes:
    with open(path, "rb") as file:
        return file.read(SAMPLE_BYTES)


def is_tiktoken_text(data: bytes) -> bool:
    """Whether the first lines (six at most, the last may be cut off) are tokens in base64 with ranks."""
    try:
        lines = [x for x in data.decode("ascii").split("\n")[:6] if x.strip() and not x.startswith("#")]
    except UnicodeDecodeError:
        return False
    if len(data) == SAMPLE_BYTES and len(lines) > 1 and len(data.split(b"\n")) <= 6:
        lines.pop()
    return bool(lines) and all(_tiktoken_row(x) is not None for x in lines)


def _tiktoken_row(line: str) -> tuple[int, bytes] | None:
    row = line.split()
    if len(row) != 2 or not row[1].isdigit():
        return None
    try:
        return int(row[1]), base64.b64decode(row[0], validate=True)
    except ValueError:
        return None


def load_tiktoken(path, model_name: str | None = None) -> Tiktoken:
    """Ids follow the order of the ranks."""
    file = Path(path)
    if file.is_dir():
        found = sorted(file.glob("*.tiktoken"))
        other = file / "tokenizer.model"
        if len(found) != 1 and not (other.is_file() and is_tiktoken_text(sample(other))):
            raise FileNotFoundError(f"{file} needs exactly one *.tiktoken file")
        file = found[0] if len(found) == 1 else other
    _existing(file, "tiktoken file")
    if file.suffix.lower() != ".tiktoken" and not is_tiktoken_text(sample(file)):
        raise ValueError(f"{file} isn't a list of byte tokens with ranks")
    rows = []
    for line in _lines(file):
        if not line.startswith("#"):
            row = _tiktoken_row(line)
            if row is None:
                raise ValueError(f"{file}: can't read the row {line!r}")
            rows.append(row)
    rows.sort(key=lambda r: r[0])
    ranks = [r for r, _ in rows]
    if not rows or len(set(ranks)) != len(rows) or len({b for _, b in rows}) != len(rows):
        raise ValueError(f"{file} is empty, or has a rank or token twice")
    return Tiktoken([b for _, b in rows], ranks, model_name or Path(path).name)


def _json_vocab(path) -> list[str]:
    found = json.loads(_existing(path, "vocabulary").read_text(encoding="utf-8"))
    by_id = {i: t for t, i in found.items()}
    if set(by_id) != set(range(len(found))):
        raise ValueError(f"{path}: ids must be 0, 1, 2, ... without gaps or repeats")
    return [by_id[i] for i in range(len(found))]


def load_bpe_gpt2(vocab_json, merges_txt, byte_level: bool = True, unk_token: str = "<unk>", end_of_word_marker: str | None = None, model_name: str | None = None) -> BPE:
    """A missing unknown token comes first, so that all other ids move on by one."""
    tokens = _json_vocab(vocab_json)
    unknown = resolve_unknown(tokens, unk_token)
    if unknown not in tokens:
        tokens.insert(0, unknown)
    kind = ByteBPE if byte_level else BPE
    return kind(_vocabulary(tokens, unknown), _ranks(read_merges(merges_txt)), unknown, end_of_word_marker, model_name or Path(vocab_json).name)


def load_bpe_encoder(encoder_json, vocab_bpe, byte_level: bool = True, unk_token: str = "<unk>", end_of_word_marker: str | None = None, model_name: str | None = None) -> BPE:
    return load_bpe_gpt2(encoder_json, vocab_bpe, byte_level, unk_token, end_of_word_marker, model_name or Path(encoder_json).name)


def load_hf_tokenizer_json(path, model_name: str | None = None) -> Pipeline:
    return load_pipeline(path, model_name)


# ---------------------------------------------------------------- dispatch


@dataclass(frozen=True)
class FilesSpec:
    """Where a tokenizer's files are; only those that its format needs."""

    format: str = "auto"
    path: str | None = None
    vocab: str | None = None
    merges: str | None = None
    vocab_json: str | None = None
    merges_txt: str | None = None
    encoder_json: str | None = None
    vocab_bpe: str | None = None
    tokenizer_json: str | None = None
    vocab_txt: str | None = None
    unigram_tsv: str | None = None
    model_file: str | None = None
    encoding_file: str | None = None

    def given(self) -> dict[str, str]:
        return {f.name: v for f in fields(self) if f.name != "format" and (v := getattr(self, f.name)) is not None}


FORMATS = {
    **dict.fromkeys(("bpe", "bpe_files"), "bpe"),
    **dict.fromkeys(("bytebpe", "byte_bpe"), "bytebpe"),
    **dict.fromkeys(("bpe_gpt2", "gpt2"), "bpe_gpt2"),
    **dict.fromkeys(("bpe_encoder",), "bpe_encoder"),
    **dict.fromkeys(("wordpiece", "wordpiece_vocab"), "wordpiece"),
    **dict.fromkeys(("unigram", "unigram_tsv"), "unigram"),
    **dict.fromkeys(("sentencepiece", "sentencepiece_model", "sentencepiece_unigram", "sentencepiece_bpe"), "sentencepiece"),
    **dict.fromkeys(("tiktoken",), "tiktoken"),
    **dict.fromkeys(("hf_tokenizer_json", "hf_json"), "hf_tokenizer_json"),
}


def canonical_format(name: str) -> str:
    if name not in FORMATS:
        raise ValueError(f"unknown tokenizer format {name!r}")
    return FORMATS[name]


def detect_tokenizer_files(path) -> dict:
    """The files of a folder that may belong to a tokenizer."""
    folder = Path(path)
    there = {n: str(folder / n) if (folder / n).is_file() else None for n in ("tokenizer.json", "vocab.json", "encoder.json", "vocab.bpe", "vocab.txt", "merges.txt", "unigram.tsv")}
    names = sorted(os.listdir(folder))
    return there | {
        "sentencepiece_files": [str(folder / n) for n in names if n.lower().endswith(_MODEL_SUFFIXES)],
        "tiktoken_files": [str(folder / n) for n in names if n.lower().endswith(".tiktoken")],
    }


def detect_tokenizer_format(path) -> str:
    path = Path(path)
    if path.is_dir():
        f = detect_tokenizer_files(path)
        rules = (
            (f["tokenizer.json"], "hf_tokenizer_json"),
            (f["vocab.json"] and f["merges.txt"], "bpe_gpt2"),
            (f["encoder.json"] and f["vocab.bpe"], "bpe_encoder"),
            (f["sentencepiece_files"], "sentencepiece_model"),
            (len(f["tiktoken_files"]) == 1, "tiktoken"),
            (f["vocab.txt"] and f["merges.txt"], "bpe"),
            (f["vocab.txt"], "wordpiece_vocab"),
            (f["unigram.tsv"], "unigram_tsv"),
        )
    else:
        _existing(path, "tokenizer file")
        name = path.name.lower()
        model = name.endswith(_MODEL_SUFFIXES)
        rules = (
            (name == "tokenizer.json", "hf_tokenizer_json"),
            (name == "vocab.json", "bpe_gpt2"),
            (name == "encoder.json", "bpe_encoder"),
            (name.endswith(".tiktoken") or model and is_tiktoken_text(sample(path)), "tiktoken"),
            (model, "sentencepiece_model"),
            (name == "vocab.txt" and (path.parent / "merges.txt").is_file(), "bpe"),
            (name.endswith(".txt"), "wordpiece_vocab"),
            (name.endswith(".tsv"), "unigram_tsv"),
            (is_tiktoken_text(sample(path)), "tiktoken"),
        )
    for holds, found in rules:
        if holds:
            return found
    raise ValueError(f"can't tell the tokenizer format of {path}; give format=")


def _gpt2_files(path: Path) -> tuple[Path, Path]:
    folder = path if path.is_dir() else path.parent
    return folder / "vocab.json", folder / "merges.txt"


def _encoder_files(path: Path) -> tuple[Path, Path]:
    folder = path if path.is_dir() else path.parent
    return folder / "encoder.json", folder / "vocab.bpe"


def load_tokenizer(source, format: str = "auto", **options) -> Tokenizer:
    """From a registered key, a path, a pair (vocabulary, merges), a mapping of files, or a FilesSpec."""
    if isinstance(source, FilesSpec):
        return load_tokenizer(source.given(), source.format if format == "auto" else format, **options)
    if isinstance(source, dict):
        return _load_files(source, format, options)
    if isinstance(source, tuple):
        vocab, merges = map(Path, source)
        if format in ("auto", "bpe"):
            if vocab.suffix == ".json":
                return load_bpe_gpt2(vocab, merges, **options)
            return load_bpe(vocab, merges, **options)
        kind = canonical_format(format)
        if kind == "bpe_gpt2":
            return load_bpe(vocab, merges, **options) if vocab.name == "vocab.txt" else load_bpe_gpt2(vocab, merges, **options)
        load = {"bytebpe": load_bytebpe, "bpe_encoder": load_bpe_encoder}.get(kind)
        if load is None:
            raise ValueError(f"a pair of files isn't a {format} tokenizer")
        return load(vocab, merges, **options)
    if isinstance(source, str) and not os.path.exists(source):
        from . import registry

        if registry.known(source):
            found = registry.describe_model(source)
            if not found["exists"]:
                raise FileNotFoundError(f"the files of model {source!r} aren't here: register a local copy")
            return load_tokenizer(found["path"], found["format"], model_name=source, **options)
    path = Path(source)
    kind = canonical_format(detect_tokenizer_format(path) if format == "auto" else format)
    if kind == "hf_tokenizer_json" and path.is_dir() and not (path / "tokenizer.json").is_file() and _gpt2_files(path)[0].is_file():
        kind = "bpe_gpt2"
    if kind == "bpe_gpt2":
        return load_bpe_gpt2(*_gpt2_files(path), **options)
    if kind == "bpe_encoder":
        return load_bpe_encoder(*_encoder_files(path), **options)
    return _LOADERS[kind](path, **options)


_LOADERS = {"bpe": load_bpe, "bytebpe": load_bytebpe, "wordpiece": load_wordpiece, "unigram": load_unigram, "sentencepiece": load_sentencepiece, "tiktoken": load_tiktoken, "hf_tokenizer_json": load_hf_tokenizer_json}


def _load_files(files: dict, format: str, options: dict) -> Tokenizer:
    has = lambda *keys: all(files.get(k) is not None for k in keys)
    if has("path"):
        return load_tokenizer(files["path"], format, **options)
    if has("vocab", "merges"):
        return load_tokenizer((files["vocab"], files["merges"]), format, **options)
    for keys, load in ((("vocab_json", "merges_txt"), load_bpe_gpt2), (("encoder_json", "vocab_bpe"), load_bpe_encoder), (("tokenizer_json",), load_hf_tokenizer_json), (("vocab_txt",), load_wordpiece), (("unigram_tsv",), load_unigram), (("model_file",), load_sentencepiece), (("encoding_file",), load_tiktoken)):
        if has(*keys):
            return load(*(files[k] for k in keys), **options)
    raise ValueError(f"the files {sorted(files)} don't make a tokenizer")


_cache: dict[tuple, Tokenizer] = {}


def get_tokenizer_cached(source, format: str = "auto") -> Tokenizer:
    """The tokenizer of a key or path, loaded once in this process."""
    key = (str(source), format if format == "auto" else canonical_format(format))
    if key not in _cache:
        _cache.setdefault(key, load_tokenizer(source, key[1]))
    return _cache[key]


def clear_tokenizer_cache() -> None:
    _cache.clear()


def cached_tokenizers() -> list[tuple]:
    return sorted(_cache)


# ---------------------------------------------------------------- writing

EXPORT_FORMATS = {"wordpiece_vocab": "wordpiece_vocab", "wordpiece": "wordpiece_vocab", "bpe_files": "bpe_files", "bpe": "bpe_files", "bpe_gpt2": "bpe_files", "bytebpe": "bpe_files", "unigram_tsv": "unigram_tsv", "unigram": "unigram_tsv", "sentencepiece_model": "sentencepiece_model", "sentencepiece": "sentencepiece_model", "hf_tokenizer_json": "hf_tokenizer_json", "hf_json": "hf_tokenizer_json"}
_FAMILY_FORMAT = {WordPiece: "wordpiece_vocab", BPE: "bpe_files", ByteBPE: "bpe_files", Unigram: "unigram_tsv", SentencePiece: "sentencepiece_model", Pipeline: "hf_tokenizer_json"}


def _inner(model: Tokenizer, kinds: tuple, target: str) -> Tokenizer:
    inner = model.inner if isinstance(model, SentencePiece) else model
    if not isinstance(inner, kinds):
        raise ValueError(f"a {model.format} tokenizer can't be written as {target}")
    return inner


def _write(path: Path, lines) -> None:
    path.write_text("".join(f"{x}\n" for x in lines), encoding="utf-8")


def _roles_by_token(model: Tokenizer) -> dict[str, str]:
    return {model.vocabulary.tokens[i - 1]: r for r, i in sorted(model.vocabulary.specials.items(), reverse=True)}


def export_tokenizer(model: Tokenizer, folder, format: str) -> list[Path]:
    """Writes the files of a format into a folder; returns them."""
    if format not in EXPORT_FORMATS:
        raise ValueError(f"unknown export format {format!r}")
    target, folder = EXPORT_FORMATS[format], Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    if target == "wordpiece_vocab":
        _write(folder / "vocab.txt", _inner(model, (WordPiece,), target).vocabulary.tokens)
        return [folder / "vocab.txt"]
    if target == "bpe_files":
        inner = _inner(model, (BPE,), target)
        _write(folder / "vocab.txt", inner.vocabulary.tokens)
        _write(folder / "merges.txt", ["# merges", *(" ".join(p) for p in ranked_pairs(inner.ranks))])
        return [folder / "vocab.txt", folder / "merges.txt"]
    if target == "unigram_tsv":
        inner = _inner(model, (Unigram,), target)
        roles = _roles_by_token(inner)
        head = ["# token, score and role", f"# whitespace_marker={inner.marker}"]
        _write(folder / "unigram.tsv", head + ["\t".join([t, repr(s), *([roles[t]] if t in roles else [])]) for t, s in zip(inner.vocabulary.tokens, inner.scores)])
        return [folder / "unigram.tsv"]
    if target == "sentencepiece_model":
        inner = _inner(model, (Unigram, BPE), target)
        unigram = isinstance(inner, Unigram)
        roles = _roles_by_token(inner)
        marker = model.marker if isinstance(model, SentencePiece) else inner.marker if unigram else MARKER
        rows = [f"type={'unigram' if unigram else 'bpe'}", f"whitespace_marker={marker}", f"unk_token={inner.unknown}"]
        scores = inner.scores if unigram else [-1.0] * len(inner.vocabulary)
        rows += ["\t".join(["piece", t, repr(s), *([roles[t]] if t in roles else [])]) for t, s in zip(inner.vocabulary.tokens, scores)]
        rows += [] if unigram else ["\t".join(["merge", *p]) for p in ranked_pairs(inner.ranks)]
        _write(folder / "spm.model", rows)
        return [folder / "spm.model"]
    export_hf_tokenizer_json(model, folder / "tokenizer.json")
    return [folder / "tokenizer.json"]


def export_hf_tokenizer_json(model: Tokenizer, path) -> None:
    Path(path).write_text(json.dumps(dump(model), ensure_ascii=False, indent=2, sort_keys=True), encoding="utf-8")


def save_tokenizer(model: Tokenizer, folder, format: str = "internal") -> list[Path]:
    if format == "internal":
        if type(model) not in _FAMILY_FORMAT:
            raise ValueError(f"a {model.format} tokenizer can't be saved")
        format = _FAMILY_FORMAT[type(model)]
    return export_tokenizer(model, folder, format)
