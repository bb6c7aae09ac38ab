"""Encoding by distinct words of a batch against encoding text by text, and vectorised word spans."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lexloom.functions import chars
from lexloom.functions.wordspans import word_spans
from lexloom.operators import arrays, models
from lexloom.operators.models import BPE, ByteBPE, SentencePiece, Tiktoken, Unigram, WordPiece
from lexloom.operators.pipeline_json import Pipeline, family_blocks
from lexloom.operators.vocabulary import Vocabulary

LETTERS = list("abcdeé日")
PARTS = ["abc", "b", "cab", "é", "日本", " ", "  ", "\n", " ", "　", " ", "x", "abé", ",", "d.e", "[CLS]", "A", "\x85", "🙂"]


def texts(n=120):
    rng = random.Random(3)
    return ["", None, "   ", "abc"] + ["".join(rng.choice(PARTS) for _ in range(rng.randrange(14))) for _ in range(n)]


def family(name):
    specials = {"unk": "[UNK]", "pad": "[PAD]", "cls": "[CLS]", "sep": "[SEP]", "bos": "[BOS]", "eos": "[EOS]"}
    first = list(specials.values())
    if name == "wordpiece":
        return WordPiece(Vocabulary.build([*first, *LETTERS, *("##" + c for c in LETTERS), "ab", "##bc"], specials), "##", "[UNK]", 0, "w")
    ranks = {("a", "b"): 1, ("ab", "c"): 2, ("c", "a"): 3}
    if name == "bpe":
        return BPE(Vocabulary.build([*first, "</w>", *LETTERS, "ab", "abc", "ca"], specials), ranks, "[UNK]", "</w>", "b")
    if name == "bytebpe":
        return ByteBPE(Vocabulary.build([*first, "</w>", *chars.BYTE_CHAR, "ab", "abc", "ca"], specials), ranks, "[UNK]", "</w>", "y")
    unigram = Unigram(Vocabulary.build([*first, "▁", *LETTERS, "ab", "▁a", "bc"], specials), [-9.0] * 6 + [-2.0] + [-3.0] * 7 + [-2.5, -2.0, -3.0], "[UNK]", "▁", "u")
    return unigram if name == "unigram" else SentencePiece(unigram, "▁", "s")


def models_of():
    named = {n: family(n) for n in ("wordpiece", "bpe", "bytebpe", "unigram", "sentencepiece")}
    named |= {f"json_{n}": Pipeline(family_blocks(m), n) for n, m in named.items()}
    blocks = family_blocks(family("wordpiece"))
    bert = {"type": "BertNormalizer", "clean_text": True, "handle_chinese_chars": True, "strip_accents": None, "lowercase": True}
    named["bert"] = Pipeline(blocks | {"normalizer": bert, "pre_tokenizer": {"type": "BertPreTokenizer"}, "added_tokens": []}, "bert")
    level = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}
    named["level"] = Pipeline(family_blocks(family("bytebpe")) | {"pre_tokenizer": level, "post_processor": level, "decoder": level, "added_tokens": []}, "level")
    named["tiktoken"] = Tiktoken([bytes([b]) for b in range(256)] + [b"ab", b"abc"], list(range(258)), "t")
    return named


@pytest.mark.parametrize("name", sorted(models_of()))
@pytest.mark.parametrize("special", [False, True])
def test_batches_are_encoded_as_texts_are(name, special):
    model, rows = models_of()[name], texts()
    if name == "tiktoken" and special:
        with pytest.raises(ValueError):
            arrays.encoded(model, pa.array(rows), True)
        return
    got = arrays.results(model, pa.array(rows), special, False, True, True).to_pylist()
    for t, r in zip(rows, got):
        if t is None:
            continue
        want = models.encode_result(model, t, special, False, True, True)
        spans = None if want["offsets"] is None else [{"start": a, "stop": b} for a, b in want["offsets"]]
        assert r == {k: want[k] for k in ("ids", "tokens", "attention_mask", "token_type_ids", "special_tokens_mask")} | {"offsets": spans}, t
    plain = arrays.results(model, pa.array(rows), special, True, False, False).to_pylist()
    assert all(r["offsets"] is None and r["special_tokens_mask"] is None for r in plain)
    assert [r["ids"] for t, r in zip(rows, plain) if t is not None] == [model.encode(t, special, True) for t in rows if t is not None]
    if not special:
        assert arrays.counted(model, pa.array(rows)).to_pylist() == [0 if t is None else len(model.encode(t)) for t in rows]
    assert arrays.encoded(model, pa.array([], pa.string()), special).to_pylist() == []


def test_slices_change_nothing(monkeypatch):
    model, rows = family("bpe"), pa.array(texts())
    whole = arrays.encoded(model, rows, True)
    monkeypatch.setattr(arrays, "SLICE_BYTES", 16)
    assert arrays.encoded(model, rows, True).equals(whole) and arrays.encoded(model, rows.slice(7, 40), True).equals(whole.slice(7, 40))


def test_word_spans_are_those_of_the_pattern():
    rows = texts(400) + ["a", "b"]
    for column in (pa.array(rows), pa.array(rows).slice(5, 200)):
        row, start, stop, words = word_spans(column)
        want = []
        for k, t in enumerate(column.to_pylist()):
            for m in chars.WORDS.finditer(t or ""):
                a = chars.byte_length(t[: m.start()]) + 1
                want.append((k, a, a + chars.byte_length(m.group()), m.group()))
        assert list(zip(row.tolist(), start.tolist(), stop.tolist(), words.to_pylist())) == want
    assert len(word_spans(pa.array([], pa.string()))[0]) == 0 and np.all(word_spans(pa.array([None, ""]))[0] == 0)


def marked(exact=True):
    unigram = Unigram(Vocabulary.build(["[UNK]", "▁", *LETTERS, "ab", "▁a", "bc"], {"unk": "[UNK]"}), [-9.0, -2.0] + [-3.0 if exact else -3.1] * 7 + [-2.5, -2.0, -3.0], "[UNK]", "▁", "u")
    merges = BPE(Vocabulary.build(["[UNK]", "▁", *LETTERS, "▁a", "▁ab", "bc"], {"unk": "[UNK]"}), {("▁", "a"): 1, ("▁a", "b"): 2, ("b", "c"): 3}, "[UNK]", None, "b")
    return [Pipeline(family_blocks(SentencePiece(m, "▁", "s")), "marked") for m in (unigram, merges)]


@pytest.mark.parametrize("kind", [0, 1])
def test_marked_words_are_encoded_on_their_own(kind, monkeypatch):
    """Texts with single blanks are put together from words; others, and those with an unknown letter, are encoded whole."""
    model, alone = marked()[kind], []
    one = arrays._one_by_one
    monkeypatch.setattr(arrays, "_one_by_one", lambda m, column, *how: alone.extend(column.to_pylist()) or one(m, column, *how))
    plain = ["abc cab é日 b", " abc a", "", None, "a"]
    odd = ["ab  c", "a\nb", "a ", "ab x c", "a▁b c", "a [UNK] b"]
    rows = [t for pair in zip(plain, odd) for t in pair] + odd[5:]
    got = arrays.results(model, pa.array(rows), False, False, True, False).to_pylist()
    assert sorted(alone) == sorted(odd)
    for t, r in zip(rows, got):
        if t is not None:
            want = models.encode_result(model, t, False, False, True)
            assert (r["ids"], r["offsets"] and [(o["start"], o["stop"]) for o in r["offsets"]]) == (want["ids"], want["offsets"] and [tuple(o) for o in want["offsets"]]), t


def test_marks_are_no_cuts_where_pieces_reach_over_them():
    over = BPE(Vocabulary.build(["[UNK]", "▁", "a", "a▁"], {"unk": "[UNK]"}), {("a", "▁"): 1}, "[UNK]", None, "b")
    assert not arrays._cuts(over, "▁") and not arrays._cuts(marked(False)[0].base, "▁") and all(arrays._cuts(m.base, "▁") for m in marked())


@pytest.mark.parametrize("prefix", [False, True])
def test_byte_level_spans_are_by_arrays(prefix, monkeypatch):
    level = {"type": "ByteLevel", "add_prefix_space": prefix, "trim_offsets": False, "use_regex": True}
    model = Pipeline(family_blocks(family("bytebpe")) | {"pre_tokenizer": level, "post_processor": level, "decoder": level, "added_tokens": []}, "level")
    rows = texts()
    want = [None if t is None else models.encode_result(model, t, False, False, True) for t in rows]
    monkeypatch.setattr(arrays, "_one_by_one", None)
    for t, w, r in zip(rows, want, arrays.results(model, pa.array(rows), False, False, True, False).to_pylist()):
        if t is not None:
            assert r["ids"] == w["ids"] and [(o["start"], o["stop"]) for o in r["offsets"]] == [tuple(o) for o in w["offsets"]], t


def test_results_come_slice_by_slice_and_long_words_are_not_remembered(monkeypatch):
    monkeypatch.setattr(arrays, "SLICE_BYTES", 16)
    model, rows = family("bpe"), pa.array(["abc " * 10] * 8 + ["a" * 100])
    assert len(list(arrays.result_parts(model, rows, False, False, True, True))) > 3
    assert len(list(arrays.encoded_parts(model, rows, True))) > 3
    memo = family("wordpiece").id_memo
    assert memo["abc"] and len(memo["a" * 100]) > 1 and list(memo) == ["abc"]


@pytest.mark.parametrize("name", ["bpe", "bytebpe", "unigram", "sentencepiece", "marked"])
def test_pieces_of_many_words_are_those_of_each(name):
    from lexloom.operators import vectors

    rng = random.Random(7)
    words = sorted({"".join(rng.choice("aaabbcdeé日x🙂"[: 9 + rng.randrange(5)]) for _ in range(rng.randrange(1, 14))) for _ in range(500)})
    for model, mark in [(family(name), "")] if name != "marked" else [(m.base, "▁") for m in marked() + marked(False)]:
        ids, start, stop, sizes = vectors.pieces(model, pa.array([mark + w for w in words]), mark)
        edges = np.concatenate(([0], np.cumsum(sizes)))
        for k, w in enumerate(words):
            part = slice(edges[k], edges[k + 1])
            want = model.word_pieces(mark + w)
            assert [model.id_to_token(i) for i in ids[part]] == want
            spans = arrays._marked_spans(w, want, mark) if mark and want != [model.unknown] else [x for s in model.word_spans(w, want, 0) for x in s]
            assert [x for s in zip(start[part].tolist(), stop[part].tolist()) for x in s] == spans
    # a word with a sign of the model's own is left to the model
    assert vectors.pieces(family("bpe"), pa.array(["a</w>"])) is None and vectors.pieces(family("sentencepiece"), pa.array(["a▁b"])) is None


def test_merges_that_wait_for_later_ones_are_left_to_the_model():
    from lexloom.operators import vectors

    late = BPE(Vocabulary.build(["[UNK]", *"abc", "ab", "abc"], {"unk": "[UNK]"}), {("ab", "c"): 1, ("a", "b"): 2}, "[UNK]", None, "b")
    assert vectors.pieces(late, pa.array(["abcab"])) is None and late.word_pieces("abcab") == ["abc", "ab"]


@pytest.mark.parametrize("name", ["bpe", "json_sentencepiece", "level", "wordpiece"])
def test_totals_are_those_of_the_spans(name):
    model, rows = models_of()[name], texts()
    got = pa.concat_arrays(arrays.total_parts(model, pa.array(rows))).to_pylist()
    for t, r in zip(rows, got):
        if t is None:
            continue
        spans = models.encode_result(model, t, False, False, True)["offsets"]
        if spans is None:
            assert r is None
            continue
        wide = [s for s in spans if s[1] > s[0]]
        apart = all(wide[k][0] >= max(b for _, b in wide[:k]) for k in range(1, len(wide)))
        assert r == {"n_tokens": len(spans), "starts": sum(a for a, _ in spans), "stops": sum(b for _, b in spans), "products": sum(a * b for a, b in spans), "apart": apart}, t


@pytest.mark.parametrize("most", [0, 6])
def test_wordpiece_pieces_are_found_for_many_words_at_once(most, monkeypatch):
    """Only words with a sign of the model's own are left to the model."""
    from lexloom.operators import vectors

    base = family("wordpiece")
    model = WordPiece(base.vocabulary, "##", "[UNK]", most, "w")
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("aaabbcdeé日x🙂"[: 8 + rng.randrange(5)]) for _ in range(rng.randrange(1, 14))) for _ in range(400)})
    ids, start, stop, sizes = vectors.pieces(model, pa.array(words))
    edges = np.concatenate(([0], np.cumsum(sizes)))
    for k, w in enumerate(words):
        part, want = slice(edges[k], edges[k + 1]), model.word_pieces(w)
        assert [model.id_to_token(i) for i in ids[part]] == want
        assert list(zip(start[part].tolist(), stop[part].tolist())) == model.word_spans(w, want, 0)
    alone = []
    slow = model.word_pieces
    monkeypatch.setattr(model, "word_pieces", lambda w: alone.append(w) or slow(w))
    rows = ["ab abc", "a##b cab [UNK] ab", "x é", "##c"]
    got = arrays.results(model, pa.array(rows), False, False, True, False).to_pylist()
    assert set(alone) == {"a##b", "[UNK]", "##c"}
    for t, r in zip(rows, got):
        want = models.encode_result(family("wordpiece") if not most else model, t, False, False, True)
        assert r["ids"] == want["ids"] and (r["offsets"] and [(o["start"], o["stop"]) for o in r["offsets"]]) == want["offsets"]


@pytest.mark.parametrize("name", ["wordpiece", "bpe", "bytebpe", "unigram", "sentencepiece"])
def test_tokens_of_words_are_those_of_texts(name):
    model, rows = family(name), [t for t in texts() if t is not None] + ["a</w>b ab", "##a"]
    assert pa.concat_arrays(arrays.token_parts(model, pa.array(rows))).to_pylist() == [model.tokenize(t) for t in rows]


def untrimmed():
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": True}
    return Pipeline(family_blocks(family("bytebpe")) | {"pre_tokenizer": level, "post_processor": level, "decoder": level, "added_tokens": []}, "level")


@pytest.mark.parametrize("model", [family("bpe"), family("bytebpe"), family("unigram"), family("sentencepiece"), *marked(), untrimmed()], ids=lambda m: f"{m.format}-{m.name}")
def test_totals_are_summed_by_different_words(model, monkeypatch):
    """No array has a place for each token of a slice."""
    rows = ["abc cab abc", "", None, "a b  a".replace("  ", " "), "日本 é".replace("本", "日"), "ab ab ab ab"]
    want = [None if t is None else models.encode_result(model, t, False, False, True)["offsets"] for t in rows]
    monkeypatch.setattr(arrays, "ids_of", None)
    got = pa.concat_arrays(arrays.total_parts(model, pa.array(rows))).to_pylist()
    for t, w, r in zip(rows, want, got):
        if t is not None:
            assert (r["n_tokens"], r["starts"], r["stops"], r["products"], r["apart"]) == (len(w), sum(a for a, _ in w), sum(b for _, b in w), sum(a * b for a, b in w), True), t


def test_rows_whose_spans_clash_are_found():
    """Within a word, between words, and not between rows; spans without bytes don't count."""
    row, start, stop = (np.array(x) for x in ([0, 0, 1, 1, 2, 3, 3], [1, 3, 1, 2, 1, 5, 2], [3, 4, 3, 4, 9, 6, 2]))
    assert set(arrays._clashes(row, start, stop).tolist()) == {1}


@pytest.mark.parametrize("cells", [0, 1 << 23])
def test_steps_by_table_are_those_looked_up(cells, monkeypatch):
    from lexloom.operators import vectors

    monkeypatch.setattr(vectors, "CELLS", cells)
    tokens = {"<unk>": -9.0, "a": -1.0, "aa": -2.0, "aaa": -3.0, "ab": -1.0, "b": -1.0, "\x00": -1.0, "日b": -0.5}
    model = Unigram(Vocabulary.build(list(tokens), {"unk": "<unk>"}), list(tokens.values()), "<unk>", "", "t")
    words = ["aaaa", "aaab", "", "a\x00b", "c", "🙂", "日b", "日", "b" * 300, "\x01"]
    ids, _, _, sizes = vectors.pieces(model, pa.array(words))
    edges = np.concatenate(([0], np.cumsum(sizes)))
    assert [[model.id_to_token(i) for i in ids[a:b]] for a, b in zip(edges[:-1], edges[1:])] == [model.word_pieces(w) for w in words]
    assert (vectors._cached(model, "trie", None).table is None) == (not cells)
