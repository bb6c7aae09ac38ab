import functools
import itertools
import math
import random
from collections import Counter

import pytest

from lexloom.functions import chars
from lexloom.operators import training as tr
from lexloom.sources import bundles

CORPUS = ["low low low lower lowest", "new newer newest widest", "wide wider new low", "häß bäßt naïve new new"]


def frame(spark, lines, parts=1):
    return spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "doc_id bigint, text string").repartition(parts)


def counts_of(lines):
    return Counter(w for t in lines for w in chars.words(t))


def slow_merges(words, size, tokens, least, prefix=None):
    """Every pair counted anew before each merge."""
    words, out = [(list(w), f) for w, f in words], []
    while len(tokens) < size:
        pairs, single = Counter(), Counter()
        for w, f in words:
            for s in w:
                single[s] += f
            for p in zip(w, w[1:]):
                pairs[p] += f
        pairs = {p: n for p, n in pairs.items() if n >= least}
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p) if prefix is None else (-(pairs[p] / (float(single[p[0]]) * float(single[p[1]]))), -pairs[p], p))
        merged = best[0] + (best[1].removeprefix(prefix) if prefix else best[1])
        for w, _ in words:
            i = 0
            while i + 1 < len(w):
                if (w[i], w[i + 1]) == best:
                    w[i : i + 2] = [merged]
                i += 1
        out.append(best)
        if merged not in tokens:
            tokens.append(merged)
    return out


def test_bpe_merges_equal_counting_anew(spark):
    result = tr.train_bpe_result(frame(spark, CORPUS), vocab_size=45)
    letters = sorted({c for w in counts_of(CORPUS) for c in w})
    tokens = ["<UNK>", "<PAD>", "</w>", *letters]
    want = slow_merges([([*w, "</w>"], f) for w, f in counts_of(CORPUS).items()], 45, tokens, 2)
    assert result.artifacts["merge_pairs"] == want and result.artifacts["vocab_tokens"] == tokens
    assert result.tokenizer.decode(result.tokenizer.encode("lowest newer")) == "lowest newer"


def test_wordpiece_merges_equal_counting_anew(spark):
    result = tr.train_wordpiece_result(frame(spark, CORPUS), vocab_size=60)
    letters = sorted({c for w in counts_of(CORPUS) for c in w})
    tokens = [*tr.WORDPIECE_SPECIALS.values(), *letters, *("##" + c for c in letters)]
    want = slow_merges([([w[0], *("##" + c for c in w[1:])], f) for w, f in counts_of(CORPUS).items()], 60, tokens, 2, "##")
    assert result.artifacts["merge_pairs"] == want and result.artifacts["vocab_tokens"] == tokens


@pytest.mark.parametrize("prefix", [None, "##"])
def test_merges_by_jobs_equal_merges_on_the_driver(spark, prefix):
    counts = tr.word_counts(frame(spark, ["aaaa abab", "baab aaab abab"]))
    symbols = tr.wordpiece_symbols(counts, prefix) if prefix else tr.wordpiece_symbols(counts, "")
    found = []
    for most in (10**6, 0):
        tokens = ["a", "b"]
        found.append((tr.learn_merges(symbols, tokens, 7, 1, prefix, driver_words=most), tokens))
    assert found[0] == found[1] and found[0][0][0]


def test_order_and_partitions_change_nothing(spark):
    found = []
    for lines, parts in ((CORPUS, 1), (CORPUS[::-1], 3)):
        df = frame(spark, lines, parts)
        found.append((tr.train_bpe(df, vocab_size=40).vocabulary.tokens, tr.train_unigram(df, vocab_size=40, num_iters=2).vocabulary.tokens, tr.train_unigram(df, vocab_size=40, num_iters=2).scores))
    assert found[0] == found[1]


def test_bytebpe(spark):
    result = tr.train_bytebpe_result(frame(spark, CORPUS), vocab_size=270)
    assert result.tokenizer.vocabulary.tokens[3:259] == tuple(chars.BYTE_CHAR)
    assert result.tokenizer.decode(result.tokenizer.encode("häß 日")) == "häß 日"
    few = tr.train_bytebpe_result(frame(spark, ["ab"]), vocab_size=5, include_full_byte_alphabet=False)
    assert few.tokenizer.vocabulary.tokens == ("<UNK>", "<PAD>", "</w>", "a", "b")


def by_all_segmentations(words, tokens, logs):
    index, out = {t: math.exp(x) for t, x in zip(tokens, logs)}, Counter()
    for word, freq in words.items():
        found = []
        for marks in itertools.product([0, 1], repeat=len(word) - 1):
            parts, last = [], 0
            for k, m in enumerate([*marks, 1], 1):
                if m:
                    parts.append(word[last:k])
                    last = k
            if all(p in index for p in parts):
                found.append((math.prod(index[p] for p in parts), parts))
        total = sum(p for p, _ in found)
        for p, parts in found:
            for t in parts:
                out[t] += freq * p / total
    return [out[t] for t in tokens]


def test_expected_counts_equal_all_segmentations(spark):
    words = {"abab": 3, "aab": 2, "b": 5, "zz": 1}
    tokens = ["a", "b", "ab", "aba", "aab"]
    logs = tr.normalized_logs([4, 3, 2, 1, 1])
    df = spark.createDataFrame(list(words.items()), "word string, freq bigint")
    assert tr.expected_counts(df, tokens, logs) == pytest.approx(by_all_segmentations({k: v for k, v in words.items() if k != "zz"}, tokens, logs), abs=1e-9)


def test_candidates_count_whole_words_twice(spark):
    df = spark.createDataFrame([("ab", 3), ("a", 1)], "word string, freq bigint")
    found = {r.token: r.freq for r in tr.candidate_counts(df, 6).collect()}
    assert found == {"ab": 9, "a": 6, "b": 3}


def test_unigram_keeps_letters_and_size(spark):
    result = tr.train_unigram_result(frame(spark, CORPUS), vocab_size=40, num_iters=2)
    model = result.tokenizer
    assert model.vocab_size() == 40 and sum(map(math.exp, model.scores)) == pytest.approx(1)
    assert model.decode(model.encode("lowest newer")) == "lowest newer"
    with pytest.raises(ValueError):
        tr.train_unigram(frame(spark, CORPUS), vocab_size=5)


@pytest.mark.parametrize("kind", ["unigram", "bpe"])
def test_sentencepiece(spark, kind, tmp_path):
    result = tr.train_sentencepiece_result(frame(spark, CORPUS), vocab_size=45, model_type=kind, num_iters=1)
    text = "lowest newer"
    assert result.tokenizer.decode(result.tokenizer.encode(text)) == text
    bundles.save_training_bundle(result, tmp_path / "b")
    assert bundles.load_training_bundle(tmp_path / "b").encode(text) == result.tokenizer.encode(text)


@pytest.mark.parametrize("trainer", ["hf_bert_wordpiece", "hf_roberta_bytebpe", "hf_gpt2_bytebpe", "wordpiece"])
def test_presets_and_bundles(spark, tmp_path, trainer):
    size = 300 if "byte" in trainer else 60
    got = bundles.quick_train_bundle(frame(spark, CORPUS), tmp_path / "b", trainer, sanity_text="low newer", vocab_size=size)
    assert got["sanity_decoded_text"].replace("</w>", "").replace(" ", "") == "lownewer"
    assert "manifest.json" in got["bundle_files"]
    again = bundles.load_training_bundle(tmp_path / "b")
    assert again.encode("low newer", True) == got["tokenizer"].encode("low newer", True)
    with pytest.raises(FileExistsError):
        bundles.quick_train_bundle(frame(spark, CORPUS), tmp_path / "b", trainer, vocab_size=size)


def test_manifest_is_checked(spark, tmp_path):
    bundles.save_training_bundle(tr.train_bpe_result(frame(spark, CORPUS), vocab_size=40), tmp_path)
    good = bundles.read_training_manifest(tmp_path)
    for key, value in (("schema_version", 2), ("files", []), ("files", good["files"] | {"vocab_txt": "../x"}), ("files", good["files"] | {"vocab_txt": "/etc/passwd"}), ("load_format", "no")):
        bundles.write_training_manifest(tmp_path, good | {key: value})
        with pytest.raises(ValueError):
            bundles.load_training_bundle(tmp_path)
    bundles.write_training_manifest(tmp_path, {k: v for k, v in good.items() if k != "trainer"})
    with pytest.raises(ValueError):
        bundles.read_training_manifest(tmp_path)


def test_special_tokens_and_limits(spark):
    assert list(tr.special_map({"padding": "P", "Unknown": "U", "x": "X"}).items()) == [("unk", "U"), ("pad", "P"), ("x", "X")]
    for bad in ({"pad": "P"}, {"unk": "U", "unknown": "V"}, {"unk": ""}):
        with pytest.raises(ValueError):
            tr.special_map(bad)
    for options in ({"vocab_size": 0}, {"vocab_size": 4}, {"vocab_size": 40, "min_frequency": 0}):
        with pytest.raises(ValueError):
            tr.train_bpe(frame(spark, CORPUS), **options)
    with pytest.raises(ValueError):
        tr.train_bpe(frame(spark, ["", None]), vocab_size=40)
    assert tr.train_bpe_result(frame(spark, CORPUS), vocab_size=100, min_frequency=99).artifacts["merge_pairs"] == []


def test_own_pretokenizer_is_noted(spark, tmp_path):
    result = tr.train_bpe_result(frame(spark, ["a-b a-b"]), vocab_size=20, pretokenizer=lambda t: t.replace("-", " ").split())
    assert {r.word for r in result.artifacts["word_counts"].collect()} == {"a", "b"}
    assert bundles.manifest_of(result, "bpe")["warnings"]


def naive_merges(words, count, least, prefix=None):
    """Every pair counted anew for every merge."""
    words = [(list(w), f) for w, f in words]
    out = []
    for _ in range(count):
        pairs, single = Counter(), Counter()
        for w, f in words:
            for s in w:
                single[s] += f
            for p in zip(w, w[1:]):
                pairs[p] += f
        pairs = {p: n for p, n in pairs.items() if n >= least}
        if not pairs:
            break
        score = (lambda p: pairs[p] / (float(single[p[0]]) * float(single[p[1]]))) if prefix is not None else (lambda p: float(pairs[p]))
        best = min(pairs, key=lambda p: (-score(p), -pairs[p], p))
        out.append((best, score(best)))
        made = best[0] + (best[1].removeprefix(prefix) if prefix is not None else best[1])
        for w, _ in words:
            i = 0
            while i + 1 < len(w):
                if (w[i], w[i + 1]) == best:
                    w[i : i + 2] = [made]
                i += 1
    return out


@pytest.mark.parametrize("prefix", [None, "##"])
@pytest.mark.parametrize("letters", ["ab", "abcdefgh"])
def test_four_hundred_merges_are_those_of_naive_counts(spark, letters, prefix):
    rng = random.Random(len(letters))
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 18))): rng.randrange(1, 50) for _ in range(500)}
    rows = [([prefix + c if prefix and k else c for k, c in enumerate(w)], f) for w, f in words.items()]
    merges, scores = tr.learn_merges(spark.createDataFrame(rows, "symbols array<string>, freq bigint"), [], 400, 1, prefix)
    want = naive_merges(rows, len(merges), 1, prefix)
    assert len(merges) == 400 and list(zip(merges, scores)) == want


@pytest.mark.parametrize("prefix", [None, "##"])
@pytest.mark.parametrize("square", [1 << 22, 0])
def test_many_merges_by_jobs_equal_counting_anew(spark, monkeypatch, prefix, square):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("aab") for _ in range(rng.randrange(1, 9))) for _ in range(60)})
    rows = [([w[0], *((prefix or "") + c for c in w[1:])], 1 + k % 7) for k, w in enumerate(words)]
    monkeypatch.setattr(tr.PairJobs, "SQUARE", square)
    monkeypatch.setattr(tr, "CUT_EVERY", 3)
    tokens = []
    merges, _ = tr.learn_merges(spark.createDataFrame(rows, "symbols array<string>, freq bigint"), tokens, 10, 2, prefix, driver_words=0)
    assert merges == slow_merges(rows, 10, [], 2, prefix) and len(tokens) == 10


def test_few_words_with_many_letters_are_merged_by_jobs(spark, monkeypatch):
    """The driver's share is bounded by letters, too."""
    monkeypatch.setattr(tr, "PairIndex", None)
    symbols = spark.createDataFrame([(["a", "b"] * 50, 2)], "symbols array<string>, freq bigint")
    tokens = ["a", "b"]
    assert tr.learn_merges(symbols, tokens, 4, 1, None, driver_words=5)[0] == [("a", "b"), ("ab", "ab")]


@pytest.mark.parametrize("how", [{"byte": True, "end": "</w>"}, {"end": "</w>"}, {"prefix": "##"}, {"end": "a"}, {}])
def test_words_are_spelled_as_their_symbols_are(spark, how):
    """Jobs spell words from their letters and give the sums that they give over arrays of symbols."""
    counts = tr.word_counts(frame(spark, [*CORPUS, "🙂a aé日本a x"], 2))
    words = counts.collect()
    spelling = tr.Spelling(tuple(sorted({c for r in words for c in r.word})), **how)
    names, (symbol, sizes) = spelling.names(), spelling.codes(tr.pa.array([r.word for r in words]))
    got, at = [], 0
    for n in sizes.tolist():
        got.append([names[k] for k in symbol[at : at + n]])
        at += n
    plain = [[chars.BYTE_CHAR[b] for b in r.word.encode()] if how.get("byte") else list(r.word) for r in words]
    want = [[w[0], *(how.get("prefix", "") + c for c in w[1:]), *([how["end"]] if how.get("end") else [])] for w in plain]
    assert got == want and [r.n for r in counts.select("word", spelling.size().alias("n")).orderBy("word").collect()] == [len(w) for _, w in sorted(zip([r.word for r in words], want))]
    rows = spark.createDataFrame([(s, r.freq) for s, r in zip(want, words)], "symbols array<string>, freq bigint")
    found = []
    for more in ({}, {"counts": counts, "spelling": spelling}):
        tokens = ["<UNK>"]
        found.append((tr.learn_merges(rows, tokens, 7, 2, how.get("prefix"), driver_words=0, **more), tokens))
    assert found[0] == found[1] and len(found[0][0][0]) == 6


def test_words_counted_slice_by_slice_are_the_same(spark, monkeypatch):
    monkeypatch.setattr(tr, "COUNT_BYTES", 16)
    lines = [*CORPUS, None, "", "  ", "new　wide\x85new"] * 3
    for cut_words in (None, lambda t: [*chars.words(t), ""]):
        got = {r.word: r.freq for r in tr.word_counts(frame(spark, lines, 2), pretokenizer=cut_words).collect()}
        assert got == counts_of([t for t in lines if t])


def test_words_that_are_counted_already_are_not_counted_again(spark):
    other = frame(spark, ["never read"])
    counts = tr.word_counts(frame(spark, CORPUS))
    for train, size in ((tr.train_bpe_result, 40), (tr.train_bytebpe_result, 270), (functools.partial(tr.train_sentencepiece_result, model_type="bpe"), 40)):
        given, want = train(other, vocab_size=size, counts=counts), train(frame(spark, CORPUS), vocab_size=size)
        assert given.artifacts["merge_pairs"] == want.artifacts["merge_pairs"] and given.artifacts["vocab_tokens"] == want.artifacts["vocab_tokens"]


@pytest.mark.parametrize("longest", [1, 2, 3, 4])
def test_short_parts_are_counted_by_numbers(spark, longest):
    words = [("ab🙂a", 3), ("a", 2), ("é日", 5), ("abab", 1)]
    want = Counter()
    for w, f in words:
        want[w] += 2 * f
        for i in range(len(w)):
            for n in range(1, min(longest, len(w) - i) + 1):
                want[w[i : i + n]] += f
    rows = spark.createDataFrame([*words, ("", 7)], "word string, freq bigint").repartition(2)
    assert {r.token: r.freq for r in tr.candidate_counts(rows, longest).collect()} == want


@pytest.mark.parametrize("letters", ["abcdefgh", "ab"])
def test_jobs_that_bounds_save(spark, monkeypatch, letters):
    """Merges by jobs are those of a full count, and pairs that no merge touched take no job."""
    draw = random.Random(len(letters))
    for _ in range(3):
        words = sorted({"".join(draw.choices(letters, range(len(letters), 0, -1), k=draw.randint(1, 9))) for _ in range(60)})
        rows = [(list(w), draw.randint(1, 9)) for w in words]
        jobs = []
        sums = tr.PairJobs._sums
        with monkeypatch.context() as m:
            m.setattr(tr.PairJobs, "_sums", lambda self, singles: jobs.append(singles) or sums(self, singles))
            tokens = list(letters)
            merges, _ = tr.learn_merges(spark.createDataFrame(rows, "symbols array<string>, freq bigint").repartition(2), tokens, len(letters) + 12, 2, driver_words=0)
        assert merges == slow_merges([("".join(s), f) for s, f in rows], len(letters) + 12, list(letters), 2)
        assert len(merges) >= 12
        if len(letters) > 2:
            assert len(jobs) < len(merges)


def test_words_lie_in_slabs(spark):
    """A job reads many words a row; symbols beyond 16 bits are kept."""
    rows = spark.createDataFrame([(["a", "b"], 1)] * 50 + [([], 1)], "symbols array<string>, freq bigint").coalesce(1)
    index = tr.PairJobs(rows)
    assert index.words.count() == 1
    index.names += [f"x{k}" for k in range(1 << 15)]
    assert index.most_frequent() == (("a", "b"), 50)
    index.merge(("a", "b"), "ab")
    for _ in range(tr.CUT_EVERY - 1):
        index.pending.append((0, 0, 0))
    index.merge(("b", "b"), "bb")
    codes = [s.tolist() for s, *_ in tr._slabs(index.words.toArrow().to_batches())]
    assert codes == [[index.number["ab"]] * 50]
