import pickle

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.functions import chars
from lexloom.operators.models import BPE, ByteBPE, SentencePiece, Tiktoken, Unigram, WordPiece, encode_result, merge
from lexloom.operators.vocabulary import Vocabulary, special_roles


def bpe(end="</w>"):
    tokens = ["<unk>", "<s>", "</s>", "</w>", *"helowrd", "he", "ll", "hell", "hello", "hello</w>", "or", "wor"]
    pairs = [("h", "e"), ("l", "l"), ("he", "ll"), ("hell", "o"), ("hello", "</w>"), ("o", "r"), ("w", "or")]
    return BPE(Vocabulary.build(tokens, special_roles(tokens, "<unk>")), {p: k for k, p in enumerate(pairs, 1)}, "<unk>", end, "toy")


def wordpiece(most=100):
    tokens = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "hel", "hello", "##lo", "##l", "w", "##or", "##ld", "wor"]
    return WordPiece(Vocabulary.build(tokens, special_roles(tokens, "[UNK]")), "##", "[UNK]", most, "toy")


def unigram(marker=""):
    tokens = ["<unk>", "h", "e", "l", "o", "he", "llo", "hello", "▁", "▁hello"]
    return Unigram(Vocabulary.build(tokens, special_roles(tokens, "<unk>")), [-9, -3, -3, -3, -3, -2, -2, -6, -1, -2.5], "<unk>", marker, "toy")


def test_bpe_pieces_and_round_trip():
    model = bpe()
    assert model.tokenize("hello  world") == ["hello</w>", "wor", "l", "d", "</w>"]
    assert model.decode(model.encode("hello world hello", True)) == "hello world hello"
    assert model.encode("", True) == [2, 3]
    assert model.tokenize("hexo") == ["<unk>"]  # one strange letter makes the whole word unknown
    assert model.decode(model.encode("xx yy")) == "<unk><unk>"


def test_lowest_rank_first_and_overlaps():
    assert merge(list("aaaa"), {("a", "a"): 1}) == ["aa", "aa"]
    assert merge(list("aaa"), {("a", "a"): 1}) == ["aa", "a"]
    assert merge(list("abc"), {("b", "c"): 1, ("a", "b"): 2}) == ["a", "bc"]


def test_byte_bpe_writes_bytes_as_characters():
    tokens = ["<unk>", *chars.BYTE_CHAR]
    model = ByteBPE(Vocabulary.build(tokens, {"unk": "<unk>"}), {}, "<unk>", None, "bytes")
    assert model.tokenize("é") == ["Ã", "©"]
    assert model.decode(model.encode("hello é")) == "helloé"  # white space isn't encoded
    assert model.offsets("a é", model.tokenize("a é"), model.encode("a é")) == [(1, 2), (3, 4), (4, 5)]


def test_wordpiece():
    model = wordpiece()
    assert model.tokenize("hello world") == ["hello", "wor", "##ld"]
    assert model.tokenize("hellol wo") == ["hello", "##l", "[UNK]"]
    assert model.encode("hello", True) == [3, 6, 4]
    assert model.decode(model.encode("hello world", True)) == "hello world"
    assert wordpiece(3).tokenize("hello hel") == ["[UNK]", "hel"]
    assert wordpiece(0).tokenize("hello") == ["hello"]


def best_by_trying(model, text):
    best, found = None, None
    n = len(text)
    for cuts in range(1 << max(n - 1, 0)):
        parts, last = [], 0
        for k in range(1, n + 1):
            if k == n or cuts >> (k - 1) & 1:
                parts.append(text[last:k])
                last = k
        ids = [model.vocabulary.ids.get(p) for p in parts]
        if None not in ids:
            score = sum(model.scores[i - 1] for i in ids)
            if best is None or score > best + 1e-12:
                best, found = score, parts
    return found, best


@given(st.text("helo", min_size=1, max_size=9))
@settings(max_examples=60, deadline=None)
def test_unigram_is_the_best_of_all_segmentations(word):
    model = unigram()
    _, best = best_by_trying(model, word)
    got = model.best(word)
    assert sum(model.scores[model.vocabulary.ids[p] - 1] for p in got) == pytest.approx(best)
    assert "".join(got) == word


def test_unigram_marker_and_unknown():
    assert unigram().decode(unigram().encode("hello hello")) == "hellohello"
    model = unigram("▁")
    assert model.tokenize("hello") == ["▁hello"]
    assert model.tokenize("xyz") == ["<unk>"]
    assert model.decode(model.encode("hello hello")) == "hello hello"


def test_sentencepiece_over_merges_has_no_end_marker():
    tokens = ["<unk>", "▁", "a", "b", "▁a"]
    inner = BPE(Vocabulary.build(tokens, {"unk": "<unk>"}), {("▁", "a"): 1}, "<unk>", None, "i")
    model = SentencePiece(inner, "▁", "s")
    assert model.tokenize("ab a") == ["▁a", "b", "▁a"]
    assert model.decode(model.encode("ab a")) == "ab a"
    assert model.offsets("ab a", model.tokenize("ab a"), model.encode("ab a")) == [(1, 2), (2, 3), (4, 5)]


def test_tiktoken_is_greedy_and_refuses_specials():
    model = Tiktoken([b"a", b"b", b"ab", b"abc", b"\xc3", b"\xa9"], list(range(6)), "t")
    assert model.encode("abab") == [3, 3]
    assert model.decode(model.encode("é")) == "é"
    assert model.id_to_token(5) == "\\xC3"
    assert model.offsets("aé", model.tokenize("aé"), model.encode("aé")) == [(1, 2), (2, 3), (3, 4)]
    with pytest.raises(ValueError):
        model.encode("a", add_special_tokens=True)
    with pytest.raises(ValueError):
        model.encode("z")


def test_result_record():
    r = encode_result(wordpiece(), "hello  world", True, False, True, True)
    assert r["ids"] == [3, 6, 12, 11, 4]
    assert r["offsets"] == [(0, 0), (1, 6), (8, 11), (11, 13), (0, 0)]
    assert r["special_tokens_mask"] == [1, 0, 0, 0, 1]
    assert r["attention_mask"] == [1] * 5 and r["token_type_ids"] == [0] * 5
    assert encode_result(wordpiece(), "hello")["offsets"] is None


def test_unknown_words_count_as_special_and_span_the_word():
    r = encode_result(wordpiece(), "zzz hel", False, False, True, True)
    assert r["tokens"] == ["[UNK]", "hel"] and r["special_tokens_mask"] == [1, 0]
    assert r["offsets"] == [(1, 4), (5, 8)]


@given(st.text(max_size=40))
@settings(max_examples=100, deadline=None)
def test_spans_lie_in_the_text_and_apart(text):
    for model in (bpe(), wordpiece(), unigram("▁")):
        r = encode_result(model, text, False, False, True)
        spans = r["offsets"]
        if spans is None:
            continue
        size = chars.byte_length(text)
        assert all(1 <= a <= b <= size + 1 for a, b in spans)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


def test_white_space_class():
    assert chars.words("a b c\u0085d\x1ce f") == ["a", "b", "c", "d\x1ce f"]


def test_models_pickle_without_their_memory():
    model = bpe()
    model.tokenize("hello")
    again = pickle.loads(pickle.dumps(model))
    assert "memo" not in again.__dict__ and again.tokenize("hello") == ["hello</w>"]


def test_vocabulary_rules():
    with pytest.raises(ValueError):
        Vocabulary.build(["a", "a"])
    v = Vocabulary.build(["a", "<pad>"], {"pad": "<pad>", "unk": "<unk>"})
    assert v.specials == {"pad": 2}
    with pytest.raises(IndexError):
        v.token_of(3)
    with pytest.raises(KeyError):
        v.id_of("zzz")
    assert special_roles(["[PAD]", "<pad>", "<mask>"], "x") == {"pad": "[PAD]", "mask": "<mask>"}
