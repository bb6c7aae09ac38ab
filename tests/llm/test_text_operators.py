"""Toxicity, language, licenses, token counts and quality rules against brute force."""

import random
import re
import textwrap
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lexloom.llm import language, licenses, quality, queries, toxicity
from lexloom.llm.token_counts import PATTERN, VOCABULARY, count_piece, load_ranks, token_counts

EXTRA = "doc_id bigint, text string, lang string, source string, id string, score string, n int, keep string, predicted string, block int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "i", "s", 1, "k", "p", 3) for r in rows], EXTRA).repartition(3)


def sql(rows, query):
    con = duckdb.connect()
    columns = list(zip(*rows)) or [(), (), (), ()]
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string())
    con.register("documents", pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "text", "lang", "source"]))
    found = con.execute(query)
    names = [d[0] for d in found.description]
    return sorted([tuple((n, r[names.index(n)]) for n in sorted(names)) for r in found.fetchall()], key=str)


def got(df):
    return sorted([tuple((n, r[n]) for n in sorted(df.columns)) for r in df.collect()], key=str)


MORE = toxicity.Lexicon.of(toxicity.LEXICON + ("worthless", "disgusting", "trash", "clown"))


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def first_kept_distance(word, term):
    """Edits of all but the first letter."""
    return edit_distance(word[1:], term[1:]) if word[:1] == term[:1] else 99


def test_automaton_equals_edit_distance():
    machine = toxicity.Automaton(MORE)
    rng = random.Random(1)
    words = ["idiot", "worthles", "worthlesss", "wrthless", "disgusting", "dsgsting", "scum", "scam", "trsh", "clwn", "xdiot"]
    for _ in range(1500):
        w = list(rng.choice(machine.terms))
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(w) + 1)
            kind = rng.randrange(3)
            if kind == 0:
                w.insert(k, rng.choice("abcdefghijklmnopqrstuvwxyz"))
            elif len(w) > 1:
                k = min(k, len(w) - 1)
                w[k : k + 1] = [] if kind == 1 else [rng.choice("abcdefghijklmnopqrstuvwxyz")]
        words.append("".join(w))
    rows, a, b, edits, terms = toxicity.find(pa.array(words), machine)
    found = {int(r): (int(e), machine.terms[t]) for r, e, t in zip(rows, edits, terms)}
    for k, w in enumerate(words):
        near = [(d, t) for t in machine.terms if (d := first_kept_distance(w, t)) <= toxicity.budget(t)]
        assert found.get(k) == (min(near) if near else None), w


def test_quotation_and_abuse(spark):
    rows = [
        (1, "You are a worthless idiot", "en", "a"),
        (2, 'He said "idiot" and the word "scum" is quoted', "en", "a"),
        (3, "A quiet text about water.", "en", "a"),
        (4, "w0rthle$$ m0ron", "en", "a"),
        (5, "> idiot\n> scum\nThat was a quote.", "en", "a"),
        (6, None, None, None),
        (7, "", "en", "a"),
        (8, "clean " * 40000, "en", "a"),
        (8, "you moron", "en", "a"),
        (None, "you moron", "en", "a"),
        (9, "you morron", "en", "a"),
    ]
    df = docs(spark, rows)
    out = toxicity.toxicity(df, lexicon=MORE)
    by = {}
    for r in out.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, by.values())) == len(rows)
    assert by[1][0].toxic and by[4][0].toxic and by[None][0].toxic and not by[3][0].toxic
    assert not by[2][0].toxic and by[2][0].quoted_hits == 2 and not by[5][0].toxic
    assert sorted(r.toxic for r in by[8]) == [False, True]
    assert by[6][0].score == 0 and by[7][0].hits == 0 and by[9][0].fuzzy_hits == 1
    kept = toxicity.clean(df, lexicon=MORE)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == sorted((r.doc_id or 0) for r in out.where("not toxic").collect())
    assert toxicity.toxicity(docs(spark, [])).count() == 0 and toxicity.clean(docs(spark, [])).count() == 0


def test_misspelled_abuse_decides(spark):
    toxic = ["you morron", "you idoit", "morno, you", "What a morron. Such a morron.", "you worthlss " * 40, "You are wrothlses. You are wrothlses. You are wrothlses."]
    sound = ["your crown", "you lose, I lose", "Das kannst du lösen. " * 30, "discussing it with you " * 30, "a morron", "wrothlses " * 30, '"morron", he said']
    rows = [(k, t, "en", "a") for k, t in enumerate(toxic + sound)]
    df = docs(spark, rows)
    assert {r.doc_id for r in toxicity.toxicity(df, lexicon=MORE).where("toxic").collect()} == set(range(len(toxic)))
    assert {r.doc_id for r in toxicity.clean(df, lexicon=MORE).collect()} == set(range(len(toxic), len(rows)))


def swap_distance(a, b):
    """Edits, where a swap of neighbours is one (and isn't edited again)."""
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x != y))
            if i and j and x == b[j - 1] and a[i - 1] == y:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_automaton_with_swaps_equals_swap_distance():
    machine = toxicity.Automaton(MORE, swaps=True)
    rng = random.Random(2)
    words = ["idoit", "morno", "diiot", "wrothlses", "wortlhess"]
    for _ in range(1500):
        w = list(rng.choice(machine.terms))
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(w) - 1)
            kind = rng.randrange(3)
            w[k : k + 2] = [w[k + 1], w[k]] if kind == 0 else [w[k]] if kind == 1 and len(w) > 4 else [w[k], rng.choice("abcdeiorst"), w[k + 1]]
        words.append("".join(w))
    rows, _, _, edits, terms = toxicity.find(pa.array(words), machine)
    found = {int(r): (int(e), machine.terms[t]) for r, e, t in zip(rows, edits, terms)}
    for k, w in enumerate(words):
        near = [(d, t) for t in machine.terms if w[0] == t[0] and (d := swap_distance(w[1:], t[1:])) <= toxicity.budget(t)]
        assert found.get(k) == (min(near) if near else None), w


def slow_judge(text, lexicon, window=6, threshold=1.0):
    """Hits by edit distances to every term, and the score, word by word."""
    tokens = [(m.start(), m.end()) for m in re.finditer(r"[\w@$]+", text) if "_" not in m.group()]
    words = [(m.start(), m.end()) for m in re.finditer(r"\w+", text)]
    inside, at = set(), 0
    for line in text.split("\n"):
        if line.startswith(">"):
            inside |= set(range(at, at + len(line)))
        opened = None
        for k, c in enumerate(line):
            if c == '"' and opened is None:
                opened = k
            elif c == '"':
                inside |= set(range(at + opened, at + k + 1))
                opened = None
        at += len(line) + 1
    hits = fuzzy = quoted = 0
    score, seen = 0.0, []
    for a, b in tokens:
        word = "".join(map(toxicity.fold, text[a:b]))
        whole = len(word) == b - a
        near = [(d, t) for t, most in lexicon.budgets.items() if whole and word[0] == t[0] and (d := swap_distance(word[1:], t[1:])) <= most]
        if not near or (min(near)[0] and word in lexicon.lookalikes):
            continue
        edits, term = min(near)
        hits, fuzzy = hits + 1, fuzzy + (edits > 0)
        weight = {0: 1.0, 1: 0.7, 2: 0.3}[edits] * (0.5 if term in lexicon.weak else 1)
        again = edits == 2 and text[a:b].lower() in seen
        seen.append(text[a:b].lower())
        if a in inside:
            quoted += 1
            score += 0 if again else weight * 0.2
            continue
        around = [text[x:y].lower() for x, y in [w for w in words if w[1] <= a][-window:] + [w for w in words if w[0] >= b][:window]]
        if set(around) & toxicity.REPORTING:
            weight *= 0.5
        if set(around) & toxicity.ADDRESSING:
            weight *= 1.5
        elif again:
            weight = 0
        score += weight
    return hits, fuzzy, quoted, round(score, 6), score >= threshold - 1e-9


def test_scores_equal_a_word_by_word_version(spark):
    lexicon = toxicity.Lexicon(MORE.budgets, frozenset({"trash", "idiot"}), MORE.lookalikes)
    rng = random.Random(7)
    parts = ["idiot", "morron", "moron", "worthlss", "wrothlses", "worthless", "scum", "tr4sh", "idiom", "you", "said", "house", "Dich", '"', "\n> ", "\n", "w" * 40, ".", "x" * 80, "clwon", "m0ron"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(300)]
    rows = [(k, t, "en", "a") for k, t in enumerate(texts)]
    out = {r.doc_id: tuple(r)[1:] for r in toxicity.toxicity(docs(spark, rows), lexicon=lexicon).collect()}
    assert [out[k] for k in range(len(texts))] == [slow_judge(t, lexicon) for t in texts]
    assert 30 < sum(x[4] for x in out.values()) < 270


def test_context_is_counted_in_words_of_any_length(spark):
    far = " ".join(["w" * 30] * 4)
    rows = [(1, f"you {far} morron", "en", "a"), (2, f"you {far} {far} morron", "en", "a"), (3, "мoron", "en", "a"), (4, "x" * 90 + "you morron", "en", "a")]
    assert {r.doc_id: r.score for r in toxicity.toxicity(docs(spark, rows)).collect()} == {1: 1.05, 2: 0.7, 3: 1.0, 4: 0.7}


def abuse(n=900, seed=3):
    """Texts of invented words; a fifth are toxic, by one to three of six words of their language; and a copied toxic text of rare words."""
    rng = random.Random(seed)
    bad = {lang: [f"{lang}vorqu{x}" for x in ("ak", "ost", "ilm", "urr", "eft", "onda")] for lang in ("en", "fr")}
    rows, labels = [], []
    for k in range(n):
        lang = ("en", "fr")[k % 2]
        words = [f"{lang}{rng.choice('bcdgklmp')}{rng.choice('aeiou')}{rng.choice('rstn')}{rng.randrange(40):o}".replace("0", "a").replace("1", "e").replace("2", "i") for _ in range(rng.randrange(10, 60))]
        toxic = rng.random() < 0.2
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(bad[lang])
        rows.append((k, " ".join(words), lang, "a"))
        labels.append((k, int(toxic), 1))
    rare = [f"rarissim{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)]
    for k in range(60):
        rows.append((n + k, " ".join(rare[:k] + ["envorquak"] + rare[k + 1 :]), "en", "copy"))
        labels.append((n + k, 1, 1))
    return rows, labels, {w for ws in bad.values() for w in ws}


def test_terms_are_learned_from_labels_and_hold_on_others(spark):
    rows, labels, bad = abuse()
    known = spark.createDataFrame([x for x in labels if x[0] % 2 or x[0] % 4 == 0] + [(None, 1, 1), (3, None, 1), (77777, 1, 1)], "doc_id bigint, toxic int, lang int")
    lexicon = toxicity.fit(docs(spark, rows + [(None, "null", "en", "a"), (1, None, None, None)]), known)
    learned = set(lexicon.budgets) - set(toxicity.BUILT_IN.budgets)
    assert learned == bad  # and none of the copied text's words
    held_out = [k for k, (i, *_) in enumerate(rows) if i % 4 == 2]
    out = {r.doc_id: r.toxic for r in toxicity.toxicity(docs(spark, [rows[k] for k in held_out]), lexicon=lexicon).collect()}
    truth = {labels[k][0]: labels[k][1] for k in held_out}
    assert np.mean([out[i] for i, t in truth.items() if t]) > 0.95 and not any(out[i] for i, t in truth.items() if not t)


def test_edits_are_those_that_clean_texts_bear(spark):
    rows, labels, bad = abuse()
    near = sorted(bad)[0]
    rows = [(i, t if x else t + f" {near[:-1]}x", lang, s) for (i, t, lang, s), (_, x, _) in zip(rows, labels)]
    lexicon = toxicity.fit(docs(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int, n int"))
    assert lexicon.budgets[near] == 0 and any(lexicon.budgets[t] for t in bad - {near})


@pytest.mark.parametrize("kind", ["no labels", "no texts", "all clean", "all toxic"])
def test_without_both_kinds_of_labels_the_lexicon_is_the_built_in_one(spark, kind):
    rows, labels, _ = abuse(60)
    labels = [] if kind == "no labels" else [(i, int(kind == "all toxic"), 1) for i, *_ in labels]
    df = docs(spark, [] if kind == "no texts" else rows)
    assert toxicity.fit(df, spark.createDataFrame(labels, "doc_id bigint, toxic int, n int")) == toxicity.BUILT_IN


PROSE = {"en": "the water of this house is green and the light was there with all of them", "de": "das wasser in diesem haus ist sehr grün und ich bin nicht allein über die brücke", "fr": "le café est très bon et les élèves de cette école ne sont pas là où il faut"}


def prose(seed, n):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        lang = rng.choice(list(PROSE))
        words = PROSE[lang].split()
        out.append((k, " ".join(rng.choice(words) for _ in range(rng.randrange(8, 60))), lang, f"s{k % 3}"))
    return out


def test_language_equals_sql_and_held_out_labels(spark):
    rows = prose(1, 90) + [(200, "", "en", "a"), (201, None, "de", "a"), (202, "123 456", "fr", "b"), (203, "zzqx kkjw vvvq xxzz wwkq", None, "b"), (5, "the light", "en", "z"), (204, "a", None, None)]
    df = docs(spark, rows)
    out = language.identify(df, language.fit(df, top=60, per_language=20), reject_percent=80)
    # a repeated id has two rows; the SQL knows ids only
    once = [r for r in rows if r[0] != 5]
    single = docs(spark, once)
    assert got(language.identify(single, language.fit(single, top=60, per_language=20))) == sql(once, language.oracle_sql(60, 20))
    truth = {i: lang for i, _, lang, _ in rows if i < 90}
    right = [r.predicted == truth[r.doc_id] for r in out.collect() if r.doc_id < 90]
    assert np.mean(right) > 0.97
    none = {r.doc_id: r for r in out.collect() if r.doc_id in (200, 201, 202)}
    assert all(r.predicted is None and not r.keep for r in none.values())


def test_relabel_keeps_sound_texts(spark):
    rows = prose(2, 60)
    df = docs(spark, rows + [(300, None, "en", "a")])
    out = language.relabel(df, language.fit(df))
    assert out.columns == df.columns
    assert {r.doc_id for r in out.collect()} == set(range(60))
    empty = docs(spark, [])
    assert language.relabel(empty, language.fit(empty)).count() == 0
    unlabelled = docs(spark, [(1, "the water", None, "a")])
    assert language.identify(unlabelled, language.fit(unlabelled)).first().predicted is None


def test_license_scan_equals_sql(spark):
    rng = random.Random(3)
    words = sorted(set().union(*(licenses.words(t) for t in licenses.TEMPLATES.values()))) + ["water", "house"]
    lines = [t for t in licenses.TEMPLATES.values()]
    rows = []
    for k in range(120):
        text = []
        for _ in range(rng.randrange(1, 5)):
            line = rng.choice(lines).split() if rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randrange(0, 30))]
            for _ in range(rng.randrange(3)):
                if line:
                    line[rng.randrange(len(line))] = rng.choice(words)
            text.append(" ".join(line))
        rows.append((k, "\n".join(text), "en", "a"))
    rows += [(500, None, None, None), (501, "", "en", "a"), (502, "x\n\n" + lines[3].upper(), "en", "a"), (503, "y " * 60000 + lines[5], "en", "b")]
    found = got(licenses.license_scan(docs(spark, rows)))
    assert found == sql(rows, licenses.oracle_sql()) and len(found) > 50
    repeated = [(1, lines[0], "en", "a"), (1, lines[0], "en", "a"), (None, lines[0], "en", "a")]
    assert licenses.license_scan(docs(spark, repeated)).where("template = 'GPL-3.0'").count() == 3
    assert licenses.license_scan(docs(spark, [])).count() == 0
    assert licenses.license_scan(docs(spark, rows), templates={"none": "!!"}).count() == 0


def test_wrapped_license_notices(spark, tmp_path):
    names = ["GPL-2.0", "MIT-notice", "BSD-3-Clause", "CC0-1.0", "MPL-2.0"]
    rows = []
    for k, name in enumerate(names):
        for width in (40, 60):
            lines = textwrap.wrap(licenses.TEMPLATES[name], width)
            rows.append((10 * k + width, "\n".join(["Prose of a file.", "", *("# " + x for x in lines), "#", "More prose."]), "en", "a"))
            rows.append((1000 + 10 * k + width, "\n\n".join(lines), "en", "a"))
    rows += [(2000, licenses.TEMPLATES["MIT"] + "\nsome prose", "en", "a"), (2001, "free software\n" + "water and house " * 30 + "\n" + licenses.TEMPLATES["GPL-2.0"][20:60], "en", "a")]
    df = docs(spark, rows)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op3_license_scan(spark, str(tmp_path)).collect()
    found = {(r.doc_id, r.template): r.block for r in out}
    assert len(found) == len(out)
    for k, name in enumerate(names):
        assert all(found[10 * k + width, name] == 3 for width in (40, 60))
    assert {i for i, _ in found if i >= 1000} == {2000} and found[2000, "MIT"] == 1
    assert not [r for r in licenses.license_scan(df).collect() if r.doc_id < 1000 and r.template in names[:1]]


TEXTS = ["", "a", "hello world", "don't  stop\n\nnow  ", "naïve café déjà", "日本語 text", "x" * 300, "a'b 'll 'x 12'3", "  \t\n", "🙂🙂 ok", "tab\tand  two", "we'll've", "'s 's't", " em", "end "]


def test_token_counts_equal_another_implementation(spark):
    import tiktoken

    other = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load_ranks(VOCABULARY), special_tokens={})
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice("ab e'st\n 1é日") for _ in range(rng.randrange(200))) for _ in range(200)] + ["word " * 30000]
    rows = [(k, t, "en", "a") for k, t in enumerate(texts)] + [(900, None, None, None), (None, "null id", "en", "a"), (1, "a", "en", "a")]
    out = token_counts(docs(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in out) == sorted((i or -1, len((t or "").encode()), len(other.encode_ordinary(t or ""))) for i, t, _, _ in rows)
    own = token_counts(docs(spark, rows), pattern=r"\S+|\s+").collect()
    split = tiktoken.Encoding("own2", pat_str=r"\S+|\s+", mergeable_ranks=load_ranks(VOCABULARY), special_tokens={})
    assert sorted(r.n_tokens for r in own) == sorted(len(split.encode_ordinary(t or "")) for _, t, _, _ in rows)
    assert token_counts(docs(spark, [])).count() == 0


def test_merges_pop_the_lowest_rank():
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"ab": 3, b"bc": 4, b"abc": 5, b"aa": 6}
    for piece, want in ((b"abc", 1), (b"bc", 1), (b"aaa", 2), (b"abab", 2), (b"", 0), (b"cba", 3)):
        assert count_piece(piece, ranks) == want


def shop(seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(300):
        n = rng.randrange(20, 200)
        rows.append((k, " ".join(rng.choice(["water", "house", "green", "light", "and", "stones"]) for _ in range(n)), ("en", "de", None)[k % 3], f"s{k % 4}" if k % 11 else None))
    return rows


def test_quality_equals_sql(spark):
    junk = [(900, "!!! ??? ### $$$ %%% &&& ((( )))" * 9, "en", "s0"), (901, "AAAA BBBB " * 60, "en", "s1"), (902, "same " * 300, "de", "s2"), (903, "12345 67890 " * 80, "en", "s3"), (904, "", "en", "s0"), (905, None, "de", "s1"), (906, "one", "xx", "new"), (907, "x" * 90000, "en", "s0")]
    rows = shop() + junk
    found = got(quality.quality_filter(docs(spark, rows)))
    assert found == sql(rows, quality.oracle_sql())
    kept = {dict(r)["doc_id"] for r in found}
    assert set(range(300)) <= kept and not kept & {900, 901, 902, 903, 904, 905, 907}
    assert quality.quality_filter(docs(spark, [])).count() == 0
    twice = rows + [rows[0]]
    assert Counter(dict(r)["doc_id"] for r in got(quality.quality_filter(docs(spark, twice))))[0] == 2


def test_short_and_symbol_only_junk_is_rejected(spark):
    junk = [(900, "one two three " + "%" * 20000, "en", "s0"), (901, "re##um### En%%%%% vi%%%.###", "de", "s1"), (902, "WATER.!! HOUSE.!! THE.!! GREEN.!! " * 3, "en", "s2"), (903, "a " + "%" * 300, "en", "s3"), (904, "green " * 30, None, "s0"), (905, "12345 " * 30, "de", "s1")]
    sound = [(800, "water", "en", "s0"), (801, "Green house!", "de", "s1"), (802, "stones and light, 10.0.0.1", "en", "s2"), (803, "OK", None, "s3"), (804, "a", "en", "s0")]
    rows = shop() + junk + sound
    found = got(quality.quality_filter(docs(spark, rows)))
    assert found == sql(rows, quality.oracle_sql())
    kept = {dict(r)["doc_id"] for r in found}
    assert {800, 801, 803} <= kept and not kept & {r[0] for r in junk}


def test_sketches_merge_in_any_grouping(spark):
    metrics = quality.measured(docs(spark, shop()))
    whole = quality.quartiles(quality.sketches(metrics), ["lang"])
    parts = quality.sketches(metrics.where("doc_id % 2 = 0")).union(quality.sketches(metrics.where("doc_id % 2 = 1")))
    assert sorted(map(str, quality.quartiles(parts, ["lang"]).collect())) == sorted(map(str, whole.collect()))
    values = sorted(r.word_length for r in metrics.where("lang = 'en'").collect())
    row = whole.where("lang = 'en' and metric = 'word_length'").first()
    exact = values[-(-len(values) // 4) - 1]
    assert row.q1 <= exact <= row.q1 * 33 / 32 + 1


@pytest.mark.parametrize("text", ["Abc, dEf  12", "ünd ÄÖ", "", "a-b_c"])
def test_measures(text):
    m = quality.measure(pa.array([text]))
    n = max(len(text), 1)
    assert m["symbols"][0] == 1000 * len(re.findall(r"[!-/:-@\[-`{-~]", text)) // n
    assert m["capitals"][0] == 1000 * len(re.findall("[A-Z]", text)) // n


def test_language_of_null_ids_and_a_very_long_text(spark):
    rows = [(k if k % 3 else None, text, lang, "a") for lang, text in PROSE.items() for k in range(1, 9)]
    rows.append((1000, PROSE["de"] * 20000, "de", "a"))
    found = language.identify(docs(spark, rows), language.fit(docs(spark, rows))).collect()
    assert len(found) == len(rows) and all(r.keep for r in found)
    assert Counter(r.predicted for r in found) == Counter(r[2] for r in rows)
