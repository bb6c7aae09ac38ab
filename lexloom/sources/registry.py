"""The table of known models, and models registered on this machine.

There is no network here: a public model is known by name and format, and becomes
usable once a local copy is registered under its key.
"""

from __future__ import annotations

import json
import os
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import FilesSpec, canonical_format, detect_tokenizer_format

SHIPPED, PUBLIC, GATED, LOCAL = "shipped", "artifact_public", "installable_gated", "user_local"
#: key: (format, family, distribution)
BUILT_IN = {
    "core_bpe_en": ("bpe", "core", SHIPPED),
    "core_wordpiece_en": ("wordpiece_vocab", "core", SHIPPED),
    "core_sentencepiece_unigram_en": ("sentencepiece_model", "core", SHIPPED),
    **{f"tiktoken_{k}_base": ("tiktoken", "openai", PUBLIC) for k in ("o200k", "cl100k", "r50k", "p50k")},
    "openai_gpt2_bpe": ("bpe_gpt2", "openai", PUBLIC),
    "phi2_bpe": ("bpe_gpt2", "phi", PUBLIC),
    "roberta_base_bpe": ("bpe_gpt2", "roberta", PUBLIC),
    "bert_base_uncased_wordpiece": ("wordpiece_vocab", "bert", PUBLIC),
    "bert_base_multilingual_cased_wordpiece": ("wordpiece_vocab", "bert", PUBLIC),
    "t5_small_sentencepiece_unigram": ("sentencepiece_model", "t5", PUBLIC),
    "mistral_v1_sentencepiece": ("sentencepiece_model", "mistral", PUBLIC),
    "mistral_v3_sentencepiece": ("sentencepiece_model", "mistral", PUBLIC),
    "xlm_roberta_base_sentencepiece_bpe": ("sentencepiece_model", "xlm_roberta", PUBLIC),
    "qwen2_5_bpe": ("hf_tokenizer_json", "qwen", PUBLIC),
    "llama2_tokenizer": ("sentencepiece_model", "llama", GATED),
    "llama3_8b_tokenizer": ("hf_tokenizer_json", "llama", GATED),
}
SCHEMA = "name string, format string, family string, distribution string, shipped boolean, path string, description string"
#: The files of a model's folder.
EXPECTED = {
    "bpe": ("vocab.txt", "merges.txt"),
    "bytebpe": ("vocab.txt", "merges.txt"),
    "bpe_gpt2": ("vocab.json", "merges.txt"),
    "bpe_encoder": ("encoder.json", "vocab.bpe"),
    "wordpiece_vocab": ("vocab.txt",),
    "unigram_tsv": ("unigram.tsv",),
    "sentencepiece_model": ("spm.model",),
    "tiktoken": ("tokenizer.tiktoken",),
    "hf_tokenizer_json": ("tokenizer.json",),
}
#: Asking for one format finds these too.
WIDER = {"bpe": ("bpe", "bpe_gpt2", "bytebpe", "hf_tokenizer_json"), "sentencepiece": ("sentencepiece_model",), "wordpiece": ("wordpiece_vocab",), "unigram": ("unigram_tsv",)}
_local: dict[str, dict] | None = None


def home() -> Path:
    return Path(os.environ.get("LEXLOOM_HOME", Path.home() / ".lexloom"))


def _locals() -> dict[str, dict]:
    global _local
    if _local is None:
        file = home() / "models.json"
        _local = json.loads(file.read_text(encoding="utf-8")) if file.is_file() else {}
    return _local


def reload() -> None:
    """Forgets what was read of the local table."""
    global _local
    _local = None


def known(name: str) -> bool:
    return name in BUILT_IN or name in _locals()


def _rows() -> list[dict]:
    out = {n: {"name": n, "format": f, "family": fam, "distribution": d, "path": None, "description": ""} for n, (f, fam, d) in BUILT_IN.items()}
    for n in out:
        for folder in (Path(__file__).parent / "models", home() / "models"):
            if (folder / n).is_dir():
                out[n]["path"] = str(folder / n)
    for n, entry in _locals().items():
        out[n] = {"name": n, "distribution": LOCAL, "family": "local", "description": ""} | out.get(n, {}) | entry
    for row in out.values():
        row["shipped"] = row["distribution"] in (SHIPPED, PUBLIC)
    return sorted(out.values(), key=lambda r: r["name"])


def _matches(row: dict, format, family, distribution, shipped) -> bool:
    return (format is None or row["format"] in WIDER.get(format, (format,))) and (family is None or row["family"] == family) and (distribution is None or row["distribution"] == distribution) and (shipped is None or row["shipped"] == shipped)


def available_models(format: str | None = None, family: str | None = None, distribution: str | None = None, shipped: bool | None = None) -> list[str]:
    """Names, sorted; all conditions must hold."""
    return [r["name"] for r in _rows() if _matches(r, format, family, distribution, shipped)]


def models_frame(spark: SparkSession) -> DataFrame:
    cols = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in cols) for r in _rows()], SCHEMA)


def filter_models(models: DataFrame, format: str | None = None, family: str | None = None, distribution: str | None = None, shipped: bool | None = None) -> DataFrame:
    """The conditions of ``available_models`` on a table of models."""
    if format is not None:
        models = models.where(F.col("format").isin(*WIDER.get(format, (format,))))
    for name, value in (("family", family), ("distribution", distribution), ("shipped", shipped)):
        if value is not None:
            models = models.where(F.col(name) == value)
    return models


def describe_model(name: str) -> dict:
    row = next((r for r in _rows() if r["name"] == name), None)
    if row is None:
        raise KeyError(f"unknown model {name!r}")
    path, local = row["path"], _locals().get(name, {})
    exists = path is not None and os.path.exists(path)
    files = [] if not exists else [path] if os.path.isfile(path) else sorted(str(f) for f in Path(path).iterdir() if f.is_file())
    # nothing is fetched, so nothing is known of the places models come from
    upstream = {"license": local.get("license"), "upstream_repo": None, "upstream_ref": None, "artifact_name": None, "upstream_files": [], "provenance_urls": []}
    source = "missing" if not exists else LOCAL if name in _locals() else row["distribution"]
    return row | upstream | {"exists": exists, "files": files, "resolved_files": files, "expected_files": list(EXPECTED.get(row["format"], ())), "source": source, "notes": local.get("notes", "")}


def model_path(name: str) -> str:
    found = describe_model(name)
    if not found["exists"]:
        raise FileNotFoundError(f"the files of model {name!r} aren't here: register a local copy")
    return found["path"]


def recommended_defaults_for_llms() -> list[str]:
    return ["tiktoken_cl100k_base", "tiktoken_o200k_base", "mistral_v3_sentencepiece", "phi2_bpe", "qwen2_5_bpe", "roberta_base_bpe", "xlm_roberta_base_sentencepiece_bpe"]


def prefetch_models_status(names: list[str] | None = None) -> dict[str, dict]:
    """available, method, path and error of each model."""
    out = {}
    for name in names if names is not None else available_models(shipped=True):
        found = describe_model(name)
        out[name] = {"available": found["exists"], "method": "local" if found["exists"] else "none", "path": found["path"], "error": None if found["exists"] else "no local copy, and downloads aren't supported"}
    return out


def prefetch_models(names: list[str] | None = None) -> dict[str, bool]:
    return {n: s["available"] for n, s in prefetch_models_status(names).items()}


def asset_status(name: str) -> dict:
    return {"name": name} | prefetch_models_status([name])[name]


def print_asset_status(name: str) -> None:
    s = asset_status(name)
    print(f"{name}: {'available' if s['available'] else 'missing'} ({s['method']}) {s['path'] or s['error']}")


def register_local_model(name: str, source, format: str = "auto", description: str = "", family: str = "local", persist: bool = True) -> dict:
    """A path is registered where it is; a mapping of files (or FilesSpec) is copied into the library's folder."""
    if isinstance(source, FilesSpec):
        format = source.format if format == "auto" else format
        source = source.given()
    if isinstance(source, dict):
        folder = home() / "models" / name
        folder.mkdir(parents=True, exist_ok=True)
        names = {"vocab": "vocab.txt", "merges": "merges.txt", "vocab_json": "vocab.json", "merges_txt": "merges.txt", "encoder_json": "encoder.json", "vocab_bpe": "vocab.bpe", "tokenizer_json": "tokenizer.json", "vocab_txt": "vocab.txt", "unigram_tsv": "unigram.tsv"}
        for key, file in source.items():
            shutil.copyfile(file, folder / names.get(key, Path(file).name))
        source = folder
    path = Path(source).resolve()
    if not path.exists():
        raise FileNotFoundError(f"no model at {path}")
    found = detect_tokenizer_format(path) if format == "auto" else format
    canonical_format(found)
    entry = _locals()[name] = {"path": str(path), "format": found, "description": description, "family": family}
    if persist:
        home().mkdir(parents=True, exist_ok=True)
        (home() / "models.json").write_text(json.dumps(_locals(), indent=2, sort_keys=True, ensure_ascii=False), encoding="utf-8")
    return entry


def register_external_model(name: str, path, format: str = "auto", description: str = "") -> dict:
    """Deprecated: register_local_model without keeping it."""
    return register_local_model(name, path, format, description, persist=False)


def _offline(what: str):
    raise RuntimeError(f"{what} needs a network, which this library doesn't use: download the files yourself and register them with register_local_model")


def download_hf_files(repo: str, files: list[str], folder, token: str | None = None):
    if not repo or not files:
        raise ValueError("a repository and files are needed")
    _offline(f"downloading {repo}")


def install_model(name: str, token: str | None = None):
    if describe_model(name)["distribution"] == GATED and not token:
        raise PermissionError(f"{name} is gated: an access token is needed")
    _offline(f"installing {name}")


def install_llama2_tokenizer(token: str | None = None):
    return install_model("llama2_tokenizer", token)


def install_llama3_8b_tokenizer(token: str | None = None):
    return install_model("llama3_8b_tokenizer", token)
