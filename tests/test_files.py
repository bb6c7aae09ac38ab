import base64
import json
import struct

import pytest

from lexloom.sources import files, registry
from tests.test_models import bpe, unigram, wordpiece


def test_token_and_merge_files(tmp_path):
    (tmp_path / "vocab.txt").write_text("<unk>\n  a \n\nb\n</w>\nab\n", encoding="utf-8")
    (tmp_path / "merges.txt").write_text("#version: 1\na b\n", encoding="utf-8")
    model = files.load_tokenizer(tmp_path)
    assert (model.format, model.vocabulary.tokens) == ("bpe", ("<unk>", "a", "b", "</w>", "ab"))
    assert model.tokenize("ab") == ["ab", "</w>"]
    assert files.load_tokenizer((tmp_path / "vocab.txt", tmp_path / "merges.txt"), "bytebpe").format == "bytebpe"
    (tmp_path / "merges.txt").write_text("a b c\n")
    with pytest.raises(ValueError):
        files.load_bpe(tmp_path)


def test_gpt2_files_put_a_missing_unknown_first(tmp_path):
    (tmp_path / "vocab.json").write_text(json.dumps({"a": 0, "b": 1, "ab": 2}))
    (tmp_path / "merges.txt").write_text("a b\n")
    model = files.load_tokenizer(tmp_path)
    assert (model.format, model.encode("ab"), model.id_to_token(1)) == ("bytebpe", [4], "<unk>")
    assert files.detect_tokenizer_format(tmp_path) == "bpe_gpt2"
    (tmp_path / "encoder.json").write_text(json.dumps({"a": 0, "<unk>": 1}))
    (tmp_path / "vocab.bpe").write_text("#v\n")
    assert files.load_tokenizer({"encoder_json": tmp_path / "encoder.json", "vocab_bpe": tmp_path / "vocab.bpe"}).encode("a") == [1]
    (tmp_path / "vocab.json").write_text(json.dumps({"a": 0, "b": 2}))
    with pytest.raises(ValueError):
        files.load_tokenizer(tmp_path, "gpt2")


def test_unigram_table(tmp_path):
    (tmp_path / "unigram.tsv").write_text("# whitespace_marker=▁\n▁a\t-1.5\n<p>\t-2\tpad\n", encoding="utf-8")
    model = files.load_tokenizer(tmp_path)
    assert (model.marker, model.scores[0], model.pad_id(), model.unk_id()) == ("▁", -99.0, 3, 1)
    assert files.load_unigram(tmp_path, whitespace_marker="_").marker == "_"


def test_sentencepiece_text_and_binary(tmp_path):
    (tmp_path / "spm.model").write_text("type=bpe\nwhitespace_marker=▁\npiece\t<unk>\t0\tunk\npiece\t▁\t0\npiece\ta\t0\npiece\t▁a\t0\nmerge\t▁\ta\n", encoding="utf-8")
    assert files.load_tokenizer(tmp_path).tokenize("aa") == ["▁a", "a"]
    with pytest.raises(ValueError):
        files.load_sentencepiece(tmp_path, "unigram")

    def piece(token, score, kind):
        body = b"\x0a" + bytes([len(token.encode())]) + token.encode() + b"\x15" + struct.pack("<f", score) + b"\x18" + bytes([kind])
        return b"\x0a" + bytes([len(body)]) + body

    data = piece("<unk>", 0, 2) + piece("<s>", 0, 3) + piece("▁a", -1, 1) + piece("", 0, 1) + b"\x12\x02hi"
    (tmp_path / "bin.model").write_bytes(data)
    model = files.load_tokenizer(tmp_path / "bin.model")
    assert (model.inner.format, model.encode("a", True), model.vocab_size()) == ("unigram", [2, 3], 3)
    (tmp_path / "bad.model").write_bytes(data[:-3])
    with pytest.raises(ValueError):
        files.load_sentencepiece(tmp_path / "bad.model")


def test_binary_model_of_the_public_kind_has_its_pieces():
    path = "/opt/tokenizers/piece_bpe_32k.model"
    sentencepiece = pytest.importorskip("sentencepiece")
    try:
        other = sentencepiece.SentencePieceProcessor(model_file=path)
    except OSError:
        pytest.skip("no such model here")
    model = files.load_sentencepiece(path)
    assert model.vocab_size() == other.get_piece_size()
    assert all(model.id_to_token(k + 1) == other.id_to_piece(k) for k in range(0, model.vocab_size(), 97))


def test_tiktoken_file(tmp_path):
    rows = [(b"b", 5), (b"a", 2), (b"ab", 9)]
    path = tmp_path / "x.tiktoken"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {r}\n" for t, r in rows))
    model = files.load_tokenizer(path)
    assert model.encode("abb") == [3, 2] and model.ranks == (2, 5, 9)
    other = tmp_path / "tokenizer.model"
    other.write_text(path.read_text())
    assert files.detect_tokenizer_format(other) == "tiktoken"
    with pytest.raises(ValueError):
        files.load_sentencepiece(other)
    path.write_text("YQ== 1\nYg== 1\n")
    with pytest.raises(ValueError):
        files.load_tiktoken(path)


@pytest.mark.parametrize("model, fmt", [(bpe(), "bpe"), (wordpiece(), "wordpiece"), (unigram("▁"), "unigram"), (unigram("▁"), "sentencepiece"), (bpe(None), "sentencepiece")])
def test_written_files_load_again(tmp_path, model, fmt):
    files.export_tokenizer(model, tmp_path, fmt)
    again = files.load_tokenizer(tmp_path)
    assert again.vocabulary.tokens == model.vocabulary.tokens
    assert again.special_tokens() == model.special_tokens()
    if fmt != "sentencepiece":
        assert again.tokenize("hello world") == model.tokenize("hello world")


def test_wrong_family_or_format(tmp_path):
    with pytest.raises(ValueError):
        files.export_tokenizer(bpe(), tmp_path, "wordpiece_vocab")
    with pytest.raises(ValueError):
        files.export_tokenizer(bpe(), tmp_path, "nonsense")
    with pytest.raises(ValueError):
        files.load_tokenizer(tmp_path, "nonsense")
    with pytest.raises(ValueError):
        files.detect_tokenizer_format(tmp_path)


def test_cache(tmp_path):
    files.save_tokenizer(wordpiece(), tmp_path)
    files.clear_tokenizer_cache()
    assert files.get_tokenizer_cached(tmp_path) is files.get_tokenizer_cached(str(tmp_path))
    assert len(files.cached_tokenizers()) == 1
    files.clear_tokenizer_cache()
    assert files.cached_tokenizers() == []


@pytest.mark.parametrize("key", ["core_bpe_en", "core_wordpiece_en", "core_sentencepiece_unigram_en"])
def test_shipped_models(key):
    model = files.load_tokenizer(key)
    assert model.decode(model.encode("hello world", True)) == "hello world"
    assert registry.asset_status(key)["available"]


def test_registry(tmp_path, monkeypatch, spark):
    monkeypatch.setenv("LEXLOOM_HOME", str(tmp_path / "home"))
    registry.reload()
    files.save_tokenizer(wordpiece(), tmp_path / "wp")
    assert "bert_base_uncased_wordpiece" in registry.available_models(format="wordpiece", shipped=True)
    assert registry.available_models(distribution="installable_gated") == ["llama2_tokenizer", "llama3_8b_tokenizer"]
    assert set(registry.available_models(format="bpe")) >= {"qwen2_5_bpe", "core_bpe_en"}
    registry.register_local_model("mine", tmp_path / "wp")
    registry.reload()
    assert registry.describe_model("mine")["format"] == "wordpiece_vocab"
    assert files.load_tokenizer("mine").tokenize("hello") == ["hello"]
    registry.register_local_model("copied", files.FilesSpec(vocab_txt=str(tmp_path / "wp" / "vocab.txt")))
    assert registry.model_path("copied").startswith(str(tmp_path / "home"))
    assert registry.prefetch_models(["mine", "phi2_bpe"]) == {"mine": True, "phi2_bpe": False}
    with pytest.raises(PermissionError):
        registry.install_llama2_tokenizer()
    with pytest.raises(RuntimeError):
        registry.install_llama3_8b_tokenizer("token")
    with pytest.raises(KeyError):
        registry.describe_model("nothing")
    frame = registry.models_frame(spark)
    assert [r.name for r in registry.filter_models(frame, format="bpe").orderBy("name").collect()] == registry.available_models(format="bpe")
    registry.reload()
