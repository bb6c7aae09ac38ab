"""What is told of a model, and models registered under a known key."""

import pytest

from lexloom.sources import files, registry


def test_a_shipped_model_is_described_in_full():
    found = registry.describe_model("core_bpe_en")
    assert set(found) == {"artifact_name", "description", "distribution", "exists", "expected_files", "family", "files", "format", "license", "name", "notes", "path", "provenance_urls", "resolved_files", "shipped", "source", "upstream_files", "upstream_ref", "upstream_repo"}
    assert found["exists"] and found["shipped"] and found["source"] == "shipped"
    assert [f.rsplit("/", 1)[-1] for f in found["files"]] == sorted(found["expected_files"])
    with pytest.raises(KeyError):
        registry.describe_model("no such model")
    missing = registry.describe_model("llama3_8b_tokenizer")
    assert not missing["exists"] and missing["files"] == [] and missing["source"] == "missing"


def test_other_files_can_be_registered_under_a_known_key(tmp_path, monkeypatch):
    monkeypatch.setenv("LEXLOOM_HOME", str(tmp_path / "home"))
    registry.reload()
    try:
        own = tmp_path / "own"
        own.mkdir()
        (own / "vocab.txt").write_text("<unk>\n</w>\ng\no\ngo\n")
        (own / "merges.txt").write_text("g o\n")
        registry.register_local_model("core_bpe_en", own, "bpe")
        assert registry.describe_model("core_bpe_en")["path"] == str(own.resolve())
        assert files.load_tokenizer("core_bpe_en").encode("go") == [5, 2]
    finally:
        registry.reload()
        files.clear_tokenizer_cache()
