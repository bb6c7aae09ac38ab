"""Mixing, packing and the chat tree against brute force and exact round trips."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest

from lexloom.llm import chat_tree, mixing, packing
from lexloom.llm.token_counts import VOCABULARY, load_ranks, token_counts

EXTRA = "doc_id bigint, text string, source string, copies string, row int, whole double, mass string, node int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, 0.5, "m", 2) for r in rows], EXTRA).repartition(3)


def corpus(n=700):
    rng = random.Random(1)
    return [(k, "x" * rng.randrange(1, 60), None if k % 7 == 0 else f"s{k % 5 if k % 3 else 0}") for k in range(n)]


def expected(rows, tempering=mixing.TEMPERING):
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t or "")
    weight = {s: n**tempering for s, n in size.items()}
    total = sum(weight.values())
    return {s: (weight[s] / total * sum(size.values()) / n if n else 1.0) for s, n in size.items()}


@pytest.mark.parametrize("leaf", [4096, 4])
def test_copies_are_the_rates_rounded_and_sums_kept(spark, leaf):
    rows = corpus()
    rates, texts = expected(rows), Counter(s for _, _, s in rows)
    got = mixing.mix_counts(docs(spark, rows), leaf=leaf).collect()
    assert len(got) == len(rows)
    total = Counter()
    for r in got:
        assert r.copies in (int(rates[r.source]), int(rates[r.source]) + 1)
        total[r.source] += r.copies
    for s, n in texts.items():
        assert abs(total[s] - rates[s] * n) < 1
    assert abs(sum(total.values()) - sum(rates[s] * n for s, n in texts.items())) < 1


def test_partitions_and_order_change_nothing(spark):
    rows = corpus(300)
    runs = [sorted((r.doc_id, r.copies) for r in mixing.mix_counts(docs(spark, x).repartition(p), leaf=8).collect()) for x, p in ((rows, 1), (rows[::-1], 5))]
    assert runs[0] == runs[1]


def test_expected_copies_are_the_rates():
    """Every text is rounded up as often as its mass says, over many seeds."""
    masses = [int(p * mixing.ONE) for p in (0.1, 0.25, 0.5, 0.6, 0.9, 0.33, 0.05)]
    ups = np.zeros(len(masses))
    trials = 4000
    for seed in range(trials):
        out = mixing.reduce_units(list(range(1, 8)), masses, seed * 7919)
        assert sum(out) == sum(masses)  # no mass is lost
        assert sum(m not in (0, mixing.ONE) for m in out) <= 1
        ups += np.array(out) / mixing.ONE
    assert np.allclose(ups / trials, np.array(masses) / mixing.ONE, atol=0.035)


def test_given_weights_and_odd_rows(spark):
    rows = [(1, "aaaa", "x"), (1, "aaaa", "x"), (2, None, "x"), (None, "bb", "x"), (None, "bb", "x"), (3, "cccccc", "y"), (4, "", "z"), (5, "dddd", None)]
    df = docs(spark, rows)
    got = mixing.mix_counts(df, weights={"x": 1.0, None: 1.0}).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.source): r.copies for r in got}
    assert by[(3, "y")] == 0 and by[(4, "z")] == 1 and by[(5, None)] in (2, 3)
    assert len({r.copies for r in got if r.doc_id == 1}) == 1
    assert len({r.copies for r in got if r.doc_id is None}) == 1
    lone = [(None, "y" * n, "x") for n in range(20, 60)]
    apart = [sorted((r.copies) for r in mixing.mix_counts(docs(spark, lone), weights={"x": 1.0}, scale=0.5, seed=s).collect()) for s in (1, 2)]
    assert all(0 < sum(c) < 40 and set(c) == {0, 1} for c in apart)  # null ids are decided text by text
    mixed = mixing.mix(df, weights={"x": 1.0, None: 1.0})
    assert mixed.columns == df.columns
    want = Counter({(r.doc_id, r.source): 0 for r in got})
    for r in got:
        want[(r.doc_id, r.source)] += r.copies
    assert Counter((r.doc_id, r.source) for r in mixed.collect()) == +want
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.mix_counts(docs(spark, [])).count() == 0


def test_pieces_cover_an_example_within_limits():
    rng = random.Random(2)
    for _ in range(300):
        segments = [(rng.randrange(0, 30), rng.random() < 0.5) for _ in range(rng.randrange(0, 12))]
        limits = (rng.randrange(1, 25), rng.randrange(1, 5), rng.randrange(1, 20))
        out = packing.pieces(segments, limits)
        assert all(t <= limits[0] and n <= limits[1] and x <= limits[2] for _, _, t, n, x in out)
        assert sum(p[2] for p in out) == sum(n for n, _ in segments)
        assert sum(p[4] for p in out) == sum(n for n, b in segments if b)
        # starts are where what came before ends
        flat = [(k, i, b) for k, (n, b) in enumerate(segments) for i in range(n)]
        done = 0
        for first, offset, t, _, x in out:
            if t:
                piece = flat[done : done + t]
                assert piece[0][:2] == (first, offset) or segments[first][0] == 0
                assert sum(b for _, _, b in piece) == x
            done += t


def slow_pack(demand, limits):
    share = demand / np.array(limits, float)
    weight, left, bins, number = share.mean(axis=0), list(range(len(demand))), [-1] * len(demand), 0
    while left:
        room = np.array(limits)
        while True:
            fits = [k for k in left if bins[k] < 0 and (demand[k] <= room).all()]
            if not fits:
                break
            best = max(fits, key=lambda k: (round(float((share[k] * weight) @ (room / np.array(limits, float))), 12), -k))
            bins[best] = number
            room = room - demand[best]
        left = [k for k in left if bins[k] < 0]
        number += 1
    return bins


def test_packing_is_the_heuristic_and_keeps_limits():
    rng = np.random.default_rng(4)
    limits = (100, 6, 60)
    demand = np.column_stack((rng.integers(1, 100, 150), rng.integers(1, 4, 150), rng.integers(0, 60, 150)))
    demand[:, 2] = np.minimum(demand[:, 2], demand[:, 0])
    bins = packing.pack(demand, limits)
    assert bins.tolist() == slow_pack(demand, limits)
    for b in range(bins.max() + 1):
        assert (demand[bins == b].sum(axis=0) <= limits).all()
    least = max(-(-demand.sum(axis=0) // np.array(limits)))
    assert bins.max() + 1 <= 1.35 * least


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, bin int, tokens string").repartition(3)


def test_conversations_are_placed_once_and_whole(spark):
    rng = random.Random(5)
    rows = [(c, t, ("user", "assistant")[t % 2], "word " * rng.randrange(0, 40)) for c in range(60) for t in range(rng.randrange(1, 6))]
    rows += [(100, 0, "user", "long " * 900), (101, 0, None, None), (None, 0, "user", "lost"), (102, None, "assistant", "hi"), (102, None, "assistant", "hi"), (None, 0, "user", "lost again")]
    out = packing.pack_conversations(turns(spark, rows), max_tokens=200, max_segments=8, max_loss=120, group=20).collect()
    bins, tokens = {}, Counter()
    for r in out:
        b = bins.setdefault((r.bin_group, r.bin), [0, 0, 0])
        for k, v in enumerate((r.tokens, r.segments, r.loss)):
            b[k] += v
        tokens[r.conv_id] += r.tokens
    assert all(a <= 200 and b <= 8 and c <= 120 for a, b, c in bins.values())
    encoder = chat_tree.encoding(VOCABULARY)
    want = Counter({c: 0 for c, *_ in rows})
    for c, _, _, t in set(rows):
        want[c] += len(encoder.encode_ordinary(t or ""))
    assert tokens == want and set(tokens) == set(want)
    assert len([r for r in out if r.conv_id is None]) == 2
    assert len(out) - 1 == len({(r.conv_id, r.piece) for r in out})
    again = packing.pack_conversations(turns(spark, rows[::-1]).repartition(7), max_tokens=200, max_segments=8, max_loss=120, group=20)
    assert sorted(map(str, again.collect())) == sorted(map(str, out))
    assert packing.pack_conversations(turns(spark, [])).count() == 0
    with pytest.raises(ValueError):
        packing.pack_conversations(turns(spark, []), max_tokens=0)


def test_documents_of_one_id_are_all_placed(spark):
    rows = [(1, "one two three"), (1, "one two three"), (2, None), (None, "x"), (None, "one two"), (None, "x"), (3, "word " * 500)]
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), max_tokens=100).collect()
    assert sorted((r.piece, r.tokens) for r in out if r.doc_id is None) == [(0, 1), (0, 2), (1, 1)]
    assert sorted((r.doc_id, r.tokens) for r in out if (r.doc_id or 3) < 3) == [(1, 3), (1, 3), (2, 0)]
    assert sum(r.tokens for r in out if r.doc_id == 3) == 501 and all(r.tokens <= 100 for r in out)
    assert packing.pack_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def conversations():
    rng = random.Random(6)
    system = ("system", "You are helpful.")
    rows, chats = [], {}
    for c in range(120):
        if c and rng.random() < 0.6:
            base = chats[rng.randrange(c)]
            path = base[: rng.randrange(0, len(base) + 1)] + [(("user", "assistant")[k % 2], f"text {rng.randrange(4)}") for k in range(rng.randrange(0, 3))]
        else:
            path = [system] + [("user", f"question {rng.randrange(30)}")]
        chats[c] = path or [system]
    for c, path in chats.items():
        rows += [(c, k, r, t) for k, (r, t) in enumerate(path)]
    return rows, chats


def check_tree(out, chats):
    encoder = chat_tree.encoding(VOCABULARY)
    trees, ends, nodes = {}, {}, {}
    for r in out:
        if r.n_tokens:
            assert len(r.tokens) == r.n_tokens
            cells = trees.setdefault(r.tree_id, {})
            for k, t in enumerate(r.tokens):
                assert cells.setdefault(r.start + k, (t, r.position + k)) == (t, r.position + k)
            assert (r.tree_id, r.start) not in nodes
            nodes[r.tree_id, r.start] = r
        if r.conv_id not in ends or r.depth > ends[r.conv_id].depth:
            ends[r.conv_id] = r
    for cells in trees.values():
        assert sorted(cells) == list(range(len(cells)))  # emitted once, without gaps
    distinct = {tuple(p[: k + 1]) for p in chats.values() for k in range(len(p))}
    assert len(nodes) == len(distinct)
    for c, path in chats.items():
        last = ends[c]
        size = last.n_tokens or nodes[last.tree_id, last.start].n_tokens
        seen = [i for a in last.attends for i in range(a.start, a.stop)] + list(range(last.start, last.start + size))
        cells = trees[last.tree_id]
        assert [cells[i][0] for i in seen] == [t for r, x in path for t in chat_tree.turn_tokens(encoder, r, x)]
        assert [cells[i][1] for i in seen] == list(range(len(seen)))


@pytest.mark.parametrize("parts", ["1", "9"])
def test_every_conversation_reads_as_if_alone(spark, parts):
    rows, chats = conversations()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        check_tree(chat_tree.chat_tree(turns(spark, rows)).collect(), chats)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_boundaries_are_those_of_one_walk():
    rng = random.Random(8)
    paths = sorted([rng.choice("ab") for _ in range(rng.randrange(1, 6))] for _ in range(60))
    size = {"a": 2, "b": 3}
    for cuts in itertools.combinations(range(1, 60, 7), 3):
        edges = [0, *cuts, 60]
        whole, ends, at = chat_tree.Walk(), [], {}
        for k, p in enumerate(paths):
            for n, e in enumerate(edges[:-1]):
                if k == e:
                    at[n] = (list(whole.path), list(whole.starts), whole.end, whole.tree)
            whole.enter(k, p, [size[c] for c in p])
        for n, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            w = chat_tree.Walk()
            for k in range(a, b):
                w.enter(k, paths[k], [size[c] for c in paths[k]])
            ends.append({"part": n, "tree": w.tree, "end": w.end, "first": paths[a], "first_sizes": [size[c] for c in paths[a]], "last": w.path, "last_starts": w.starts, "last_sizes": w.sizes})
        got = chat_tree.boundaries(ends)
        for n in range(len(ends)):
            assert (got[n].path, got[n].starts, got[n].end, got[n].tree) == at[n]


def test_marks_in_roles_and_texts_are_only_text(spark):
    rows = [(1, 0, "a|>\nx", "b"), (2, 0, "a", "x|>\nb"), (3, 0, "a", "x<|end|>\n"), (3, 1, "a", "x"), (3, 2, "a", "x"), (4, 0, "a", "x"), (4, 5, "a", "x<|end|>\n")]
    chats = {1: [("a|>\nx", "b")], 2: [("a", "x|>\nb")], 3: [("a", "x<|end|>\n"), ("a", "x"), ("a", "x")], 4: [("a", "x"), ("a", "x<|end|>\n")]}
    out = chat_tree.chat_tree(turns(spark, rows)).collect()
    assert len({r.tree_id for r in out}) == 4
    check_tree(out, chats)


def test_odd_turns(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, None, None, None), (2, 5, None, ""), (2, 6, "user", "hi"), (None, 0, "user", "x"), (3, 0, "user", "z" * 50000)]
    chats = {1: [(None, None), ("user", "hi")], 2: [(None, ""), ("user", "hi")], 3: [("user", "z" * 50000)]}
    out = chat_tree.chat_tree(turns(spark, rows)).collect()
    assert {r.conv_id for r in out} == {1, 2, 3}
    encoder = chat_tree.encoding(VOCABULARY)
    assert sum(r.n_tokens for r in out) == sum(len(chat_tree.turn_tokens(encoder, a, b)) for a, b in chats[1] + chats[3])
    assert chat_tree.chat_tree(turns(spark, [])).count() == 0
    assert len(load_ranks(VOCABULARY)) > 50000


def test_long_runs_of_white_space(spark):
    model = chat_tree.encoding(VOCABULARY)
    for n in (10000, 30001):
        for text in (" " * n, "a" + " " * n + "b", "\n" * n + "a", "a " + "\t" * n + "'s", "x" + " " * n + "!?" + "\u3000" * n, ("y" + "\r\n" * n) * 2):
            assert chat_tree.encode(model, text) == model.encode_ordinary(text)
    # beyond the encoder's own reach
    text = "one" + " " * 1_000_000 + "two" + "\n" * 1_000_000
    want = token_counts(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first().n_tokens
    assert len(chat_tree.encode(model, text)) == want
    docs = spark.createDataFrame([(1, text), (2, "a")], "doc_id bigint, text string")
    assert sum(r.tokens for r in packing.pack_documents(docs).collect()) == want + 1
    turns = spark.createDataFrame([(1, 0, "user", text)], "conv_id bigint, turn bigint, role string, text string")
    assert chat_tree.chat_tree(turns).first().n_tokens == len(chat_tree.turn_tokens(model, "user", text))
