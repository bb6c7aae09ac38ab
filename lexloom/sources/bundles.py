"""Bundles: a trained tokenizer's files with a manifest that says how to load them."""

from __future__ import annotations

import json
from dataclasses import asdict, replace
from pathlib import Path

from ..operators.models import BPE, ByteBPE, SentencePiece, Tokenizer, Unigram, WordPiece
from ..operators.pipeline_json import Pipeline
from ..operators.training import QUICK_TRAINERS, TrainingResult
from ..operators.vocabulary import Vocabulary
from . import files

MANIFEST, SCHEMA_VERSION = "manifest.json", 1
_KEYS = {"schema_version": int, "trainer": str, "load_format": str, "export_format": str, "files": dict, "load_kwargs": dict, "training_config": dict, "metadata": dict, "warnings": list}
_EXPORTS = {"bpe": "bpe", "bpe_gpt2": "bpe", "wordpiece": "wordpiece_vocab", "wordpiece_vocab": "wordpiece_vocab", "unigram": "unigram_tsv", "unigram_tsv": "unigram_tsv", "sentencepiece": "sentencepiece_model", "sentencepiece_model": "sentencepiece_model", "hf_tokenizer_json": "hf_tokenizer_json"}


def _export_format(model: Tokenizer, wanted: str) -> str:
    if wanted not in ("auto", "internal"):
        if wanted not in _EXPORTS:
            raise ValueError(f"unknown export format {wanted!r}")
        return _EXPORTS[wanted]
    for kind, found in ((Pipeline, "hf_tokenizer_json"), (WordPiece, "wordpiece_vocab"), (BPE, "bpe"), (Unigram, "unigram_tsv"), (SentencePiece, "sentencepiece_model")):
        if isinstance(model, kind):
            return found
    raise ValueError(f"a {model.format} tokenizer can't be bundled")


def _loading(model: Tokenizer, export: str) -> tuple[str, dict, dict]:
    """Load format, files by role, and options of the loader."""
    if export == "hf_tokenizer_json":
        return "hf_tokenizer_json", {"tokenizer_json": "tokenizer.json"}, {}
    specials = {"special_tokens": {r: model.id_to_token(i) for r, i in sorted(model.special_tokens().items())}}
    wanted = {"bpe": BPE, "wordpiece_vocab": WordPiece, "unigram_tsv": Unigram, "sentencepiece_model": (SentencePiece, Unigram, BPE)}[export]
    if not isinstance(model, wanted):
        raise ValueError(f"a {model.format} tokenizer can't be bundled as {export}")
    if export == "bpe":
        return ("bytebpe" if isinstance(model, ByteBPE) else "bpe"), {"vocab_txt": "vocab.txt", "merges_txt": "merges.txt"}, {"unk_token": model.unknown_token, "end_of_word_marker": model.end} | specials
    if export == "wordpiece_vocab":
        return "wordpiece", {"vocab_txt": "vocab.txt"}, {"continuation_prefix": model.prefix, "unk_token": model.unknown_token, "max_input_chars_per_word": model.most_chars} | specials
    if export == "unigram_tsv":
        return "unigram", {"unigram_tsv": "unigram.tsv"}, {"unk_token": model.unknown_token, "whitespace_marker": model.marker} | specials
    return "sentencepiece_model", {"spm_model": "spm.model"}, specials


def _plain_config(config) -> tuple[dict, list[str]]:
    out, warnings = {}, []
    for name, value in asdict(replace(config, pretokenizer=None)).items():
        if name == "pretokenizer":
            if config.pretokenizer is not None:
                warnings.append("the pretokenizer is a function and isn't kept")
        elif value is not None:
            out[name] = value
    return out, warnings


def manifest_of(result: TrainingResult, export: str) -> dict:
    load_format, named, options = _loading(result.tokenizer, export)
    config, warnings = _plain_config(result.config)
    info = {"model_name": result.config.model_name, "version": result.config.version, "tokenizer_type": type(result.tokenizer).__name__, "config_type": result.config.trainer}
    return {"schema_version": SCHEMA_VERSION, "trainer": result.config.trainer, "load_format": load_format, "export_format": export, "files": named, "load_kwargs": options, "training_config": config, "metadata": info, "warnings": warnings}


def write_training_manifest(folder, manifest: dict) -> Path:
    path = Path(folder) / MANIFEST
    path.write_text(json.dumps(manifest, sort_keys=True, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")
    return path


def read_training_manifest(folder) -> dict:
    path = Path(folder) / MANIFEST
    if not path.is_file():
        raise FileNotFoundError(f"no manifest at {path}")
    found = json.loads(path.read_text(encoding="utf-8"))
    if not isinstance(found, dict):
        raise ValueError(f"{path} must be an object")
    for key, kind in _KEYS.items():
        if key not in found:
            raise ValueError(f"{path} lacks {key}")
        if not isinstance(found[key], kind) or isinstance(found[key], bool):
            raise ValueError(f"{path}: {key} must be of type {kind.__name__}")
    if found["schema_version"] != SCHEMA_VERSION:
        raise ValueError(f"{path}: schema version {found['schema_version']} isn't supported")
    return found


def _inside(folder: Path, name) -> Path:
    """A file of the bundle; names that lead out of it are refused."""
    if not isinstance(name, str) or not name or Path(name).is_absolute():
        raise ValueError(f"the file name {name!r} must be relative")
    path = (folder / name).resolve()
    if not path.is_relative_to(folder.resolve()):
        raise ValueError(f"the file name {name!r} leads out of the bundle")
    if not path.is_file():
        raise FileNotFoundError(f"the bundle lacks {name}")
    return path


def save_training_bundle(result: TrainingResult, folder, export_format: str = "auto", overwrite: bool = False) -> Path:
    folder = Path(folder)
    if folder.exists() and any(folder.iterdir()) and not overwrite:
        raise FileExistsError(f"{folder} isn't empty; use overwrite=True")
    folder.mkdir(parents=True, exist_ok=True)
    export = _export_format(result.tokenizer, export_format)
    manifest = manifest_of(result, export)
    files.export_tokenizer(result.tokenizer, folder, export)
    write_training_manifest(folder, manifest)
    return folder


def load_training_bundle(folder) -> Tokenizer:
    folder = Path(folder)
    manifest = read_training_manifest(folder)
    named = {k: _inside(folder, v) for k, v in manifest["files"].items()}
    options = dict(manifest["load_kwargs"])
    specials = options.pop("special_tokens", {})
    name = manifest["metadata"].get("model_name")
    load = {
        "bpe": lambda: files.load_bpe(named["vocab_txt"], named["merges_txt"], model_name=name, **options),
        "bytebpe": lambda: files.load_bytebpe(named["vocab_txt"], named["merges_txt"], model_name=name, **options),
        "wordpiece": lambda: files.load_wordpiece(named["vocab_txt"], model_name=name, **options),
        "unigram": lambda: files.load_unigram(named["unigram_tsv"], model_name=name, **options),
        "sentencepiece_model": lambda: files.load_sentencepiece(named["spm_model"], model_name=name),
        "hf_tokenizer_json": lambda: files.load_hf_tokenizer_json(named["tokenizer_json"], model_name=name),
    }.get(manifest["load_format"])
    if load is None:
        raise ValueError(f"unknown load format {manifest['load_format']!r}")
    return _with_specials(load(), specials)


def _with_specials(model: Tokenizer, specials: dict[str, str]) -> Tokenizer:
    ids = model.vocabulary.ids
    more = {r: ids[t] for r, t in specials.items() if t in ids}
    if more:
        parts = [model, model.inner] if isinstance(model, SentencePiece) else [model]
        vocabulary = Vocabulary(model.vocabulary.tokens, ids, model.vocabulary.specials | more)
        for m in parts:
            m.vocabulary = vocabulary
    return model


def quick_train_bundle(df, folder, trainer: str = "wordpiece", text_col: str = "text", sanity_text: str = "hello world", overwrite: bool = False, export_format: str = "auto", **options) -> dict:
    """Trains, saves, loads again, and tries the tokenizer on a text."""
    if trainer not in QUICK_TRAINERS:
        raise ValueError(f"unknown trainer {trainer!r}; use one of {', '.join(QUICK_TRAINERS)}")
    result = QUICK_TRAINERS[trainer](df, text_col, **options)
    saved = save_training_bundle(result, folder, export_format, overwrite)
    model = load_training_bundle(saved)
    ids = model.encode(sanity_text)
    return {"bundle_directory": str(saved), "bundle_files": sorted(p.name for p in saved.iterdir()), "training_summary": {"trainer": trainer, "vocab_size": model.vocab_size(), "model_name": result.config.model_name}, "tokenizer": model, "sanity_encoded_ids": ids, "sanity_decoded_text": model.decode(ids)}
