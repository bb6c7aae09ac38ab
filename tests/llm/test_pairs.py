"""N-gram Jaccard join, near embeddings and components against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from lexloom.llm import cap_filters, ngram_join
from lexloom.llm.components import components

WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")
NAMES = "doc_id bigint, text string, doc_a bigint, head string, point string, points string, id string, region string"


def grams(text, n=3):
    w = WORD.findall((text or "").lower())
    return frozenset([" ".join(w)] if 0 < len(w) < n else [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)])


def brute(rows, percent=60):
    sets = [(i, grams(t)) for i, t in rows if i is not None and grams(t)]
    heads = {}
    for i, s in sets:
        heads[s] = min(i, heads.get(s, i))
    out = {(heads[s], i, 1.0) for i, s in sets if i != heads[s]}
    keys = list(heads)
    for k, a in enumerate(keys):
        for b in keys[k + 1 :]:
            both = len(a & b)
            if both * 100 >= percent * len(a | b) and heads[a] != heads[b]:
                x, y = sorted((heads[a], heads[b]))
                out.add((x, y, round(both / len(a | b), 9)))
    return out


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(n):
        if rows and rng.random() < 0.5:
            base = WORD.findall(rng.choice(rows)[1] or "")
            for _ in range(rng.randrange(4)):
                if base:
                    base[rng.randrange(len(base))] = rng.choice(words)
            rows.append((k, " ".join(base)))
        else:
            rows.append((k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 5, 20, 60, 200])))))
    return rows


def found(df):
    rows = [(r.doc_a, r.doc_b, round(r.jaccard, 9)) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def classes(rows, percent=60):
    """One row for each id, from all pairs of sets."""
    sets = {(i, grams(t)) for i, t in rows if i is not None}
    ids = {i for i, _ in sets}
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b, _ in brute(rows, percent):
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    heads = {}
    for i, s in sets:
        if s:
            heads[s] = min(i, heads.get(s, i))
    members = Counter(s for _, s in sets)
    near = {s: sum(1 for o in heads if heads[o] != heads[s] and len(s & o) * 100 >= percent * len(s | o)) for s in heads}
    out = {i: [root(i), 0, 0] for i in ids}
    for i, s in sets:
        if s:
            out[i][1] += near[s]
            out[i][2] += members[s] - 1
    return {(i, *x) for i, x in out.items()}


def both(df):
    """The pairs, after the classes were held against brute force."""
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    out = ngram_join.ngram_join(df).collect()
    assert [*out[0].asDict()] == ["doc_id", "class_id", "links", "copies"] if out else not any(i is not None for i, _ in rows)
    assert len(out) == len({r.doc_id for r in out}) and {tuple(r) for r in out} == classes(rows)
    return ngram_join.ngram_pairs(df)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "x", "x", "x", "x") for i, t in rows], NAMES).repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_all_pairs_and_no_others(spark, seed):
    rows = corpus(seed)
    want = brute(rows)
    assert len(want) > 15
    assert found(both(frame(spark, rows))) == want


def test_odd_rows(spark):
    long = " ".join(f"x{k}" for k in range(30000))
    rows = [(1, None), (2, ""), (3, "!!"), (4, "a b"), (5, "A  b."), (4, "a b"), (None, "a b"), (6, long), (7, long + " y"), (8, "c d e f"), (8, "c d e f"), (8, "q r s t")]
    assert found(both(frame(spark, rows))) == brute(rows)
    assert both(frame(spark, [])).count() == 0


def test_large_regions_are_parted_and_joined_alike(spark, monkeypatch):
    rows = corpus(3)
    monkeypatch.setattr(ngram_join, "REGION_GRAMS", 50)
    assert found(both(frame(spark, rows))) == brute(rows)
    monkeypatch.setattr(ngram_join, "PLACED_BYTES", -1)
    assert found(both(frame(spark, rows))) == brute(rows)


def test_sets_of_one_name_are_told_apart(spark, monkeypatch):
    rows = corpus(6)
    monkeypatch.setattr(ngram_join, "point_of", lambda signed, digits: (signed & (2**64 - 1)) >> 61)
    df = frame(spark, rows)
    monkeypatch.setattr(ngram_join.F, "shiftrightunsigned", lambda c, n: ngram_join.F.expr(f"shiftrightunsigned({c}, 61)"))
    assert found(both(df)) == brute(rows)


def test_crowded_grams_come_last_and_lose_nothing(spark, monkeypatch):
    shared = " ".join(f"s{k}" for k in range(12))
    rows = corpus(4, 60) + [(1000 + k, f"{shared} u{k} v{k} {shared if k % 2 else ''} t{k // 3}") for k in range(40)]
    monkeypatch.setattr(ngram_join, "CROWD", 3)
    monkeypatch.setattr(ngram_join, "RUN_COUNT", 2)
    monkeypatch.setattr(ngram_join, "CROWDED", 4)
    assert found(both(frame(spark, rows))) == brute(rows)


def test_cells_split_by_pivots_find_the_same(monkeypatch):
    rng = np.random.default_rng(0)
    sets = []
    for k in range(12):
        base = rng.integers(0, 1 << 40, 60, dtype=np.uint64)
        for _ in range(40):
            s = base.copy()
            s[rng.integers(0, 60, 6)] = rng.integers(0, 1 << 40, 6, dtype=np.uint64)
            sets.append(np.unique(s))
    whole = ngram_join.Cells(sets, 60)
    monkeypatch.setattr(ngram_join, "LEAF", 10**6)
    plain = set(ngram_join.Cells(sets, 60).pairs())
    monkeypatch.setattr(ngram_join, "LEAF", 16)
    norm = lambda p: {(min(a, b), max(a, b), j) for a, b, j in p}
    assert norm(whole.pairs()) == norm(plain) and len(plain) > 1000


def test_pivots_part_a_region_at_the_shipped_constants(spark, monkeypatch):
    """A chain of texts, each near to the next: one region, in which the pivots and windows are used."""
    words = [f"c{k}" for k in range(1500)]
    rows = [(k, " ".join(words[7 * k : 7 * k + 40])) for k in range(200)]
    parted = []
    whole = ngram_join.Cells.pairs
    monkeypatch.setattr(ngram_join.Cells, "pairs", lambda self: (whole(self), parted.append(self.parted))[0])
    sets = [np.sort(np.array([hash(g) & (2**64 - 1) for g in grams(t)], dtype=np.uint64)) for _, t in rows]
    got = {(a, b) for a, b, _ in ngram_join.Cells(sets, 60).pairs()}
    assert {(min(p), max(p)) for p in got} == {(a, b) for a, b, _ in brute(rows)} and parted[0] >= 1
    loose = ngram_join.Cells(sets, 60, listed=False)
    loose.pairs()
    assert loose.parted and set(loose.parent) == {0} and loose.links.sum() == 2 * len(got)
    assert found(both(frame(spark, rows))) == brute(rows)


def test_one_of_each_group_stays(spark):
    rows = corpus(5)
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b, _ in brute(rows):
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    df = frame(spark, rows)
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in rows if root(i) == i)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(200 + k, 201 + k) for k in range(40)] + [(7, 7), (None, 3)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {i: root(i) for i in parent}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def vectors(n=300, groups=40, width=64):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((groups, width))
    out = base[rng.integers(0, groups, n)] + 0.22 * rng.standard_normal((n, width))
    return out.astype(np.float32)


def near(x, t=0.9):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = u @ u.T
    return {(a, b): round(s[a, b], 6) for a in range(len(x)) for b in range(a + 1, len(x)) if s[a, b] >= t - 1e-9}


def test_vectors_have_the_classes_and_links_of_their_pairs(spark):
    x = vectors(200, 30)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(500 + k, x[k // 2].tolist()) for k in range(20)] + [(3, x[3].tolist()), (4, x[9].tolist()), (900, None), (901, [0.0] * 64), (None, x[0].tolist())]
    df = spark.createDataFrame([(*r, "f", 1, "c") for r in rows], "vec_id bigint, embedding array<float>, head string, key int, links string").repartition(3)
    pairs = {(r.vec_a, r.vec_b) for r in cap_filters.near_pairs(df).collect()}
    sets = {(i, tuple(v)) for i, v in rows if i is not None and v and any(v)}
    heads, members = {}, Counter(v for _, v in sets)
    for i, v in sets:
        heads[v] = min(i, heads.get(v, i))
    parent = {i: i for i, _ in rows if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    keys = list(heads)
    unit = np.array(keys, dtype=np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    close = unit @ unit.T >= 0.9 - 1e-9
    at = {v: k for k, v in enumerate(keys)}
    degree = [sum(bool(close[k, j]) and heads[keys[j]] != heads[keys[k]] for j in range(len(keys))) for k in range(len(keys))]
    for tile in (1024, 8):
        got = {r.vec_id: r for r in cap_filters.near_vectors(df, tile=tile).collect()}
        assert set(got) == set(parent)
        assert {i: r.class_id for i, r in got.items()} == {i: root(i) for i in parent}
        assert {i: r.copies for i, r in got.items()} == {i: sum(members[v] - 1 for j, v in sets if j == i) for i in parent}
        want = {i: sum(degree[at[v]] for j, v in sets if j == i) for i in parent}
        assert all(r.links <= want[i] for i, r in got.items()) and sum(r.links for r in got.values()) >= 0.9 * sum(want.values())
    assert [r.asDict() for r in cap_filters.near_vectors(spark.createDataFrame([(1, [1.0, 0.0]), (2, [3.0, 0.0]), (2, [0.0, 1.0]), (7, None)], "vec_id bigint, embedding array<float>")).orderBy("vec_id").collect()] == [
        {"vec_id": 1, "class_id": 1, "links": 1, "copies": 0},
        {"vec_id": 2, "class_id": 1, "links": 1, "copies": 0},
        {"vec_id": 7, "class_id": 7, "links": 0, "copies": 0},
    ]
    assert cap_filters.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_near_embeddings_recall_and_precision(spark):
    x = vectors()
    rows = [(k, v.tolist(), "f", 1, "c") for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, filter string, tile int, vec_a string").repartition(3)
    want = near(x)
    for tile in (1024, 8):
        got = {(r.vec_a, r.vec_b): r.cosine for r in cap_filters.near_pairs(df, tile=tile).collect()}
        assert set(got) <= set(want) and len(got) >= 0.9 * len(want) > 300
        assert all(abs(got[k] - want[k]) < 2e-6 for k in got)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.standard_normal((1500, 64))
    y -= (y * x).sum(1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    y = 0.9 * x + np.sqrt(1 - 0.81) * y
    code = cap_filters.Code(64)
    a, b = (set(zip(*(z.tolist() for z in code.decode(v)))) for v in (x, y))
    assert len({i for i, _ in a & b}) >= 0.93 * 1500


@pytest.mark.parametrize("width", [1, 2, 8, 32, 64, 96, 128, 384, 768])
def test_recall_at_the_threshold_at_any_width(width):
    rng = np.random.default_rng(9)
    n = 1000 if width >= 32 else 50
    x = rng.standard_normal((n, width))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = x.copy()
    if width > 1:
        y = rng.standard_normal((n, width))
        y -= (y * x).sum(1)[:, None] * x
        y /= np.linalg.norm(y, axis=1)[:, None]
        y = 0.9 * x + np.sqrt(1 - 0.81) * y
    code = cap_filters.Code(width)
    a, b = (set(zip(*(z.tolist() for z in code.decode(v)))) for v in (x, y))
    assert len({i for i, _ in a & b}) >= 0.93 * n
    assert len(a) <= 40 * n and (width < 64 or len(a) >= 14 * n)


def test_list_decoding_finds_exactly_the_filters_above():
    code = cap_filters.Code(6, alpha=0.3, blocks=3, codes=4, turns=2)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((20, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = set()
    for k, turn in enumerate(code.turns):
        gain = (x @ turn).reshape(20, 3, 4)
        for i in range(20):
            for a in range(4):
                for b in range(4):
                    for c in range(4):
                        if gain[i, 0, a] + gain[i, 1, b] + gain[i, 2, c] >= 0.3:
                            want.add((i, ((k * 4 + a) * 4 + b) * 4 + c))
    got = code.decode(x)
    assert set(zip(got[0].tolist(), got[1].tolist())) == want


def test_odd_vectors(spark):
    e = [1.0] + [0.0] * 7
    rows = [(1, e), (2, [5 * v for v in e]), (1, e), (3, None), (None, e), (4, []), (5, [0.0] * 8), (6, [float("nan")] * 8), (7, [1.0]), (8, [None] + e[1:])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert [(r.vec_a, r.vec_b, r.cosine) for r in cap_filters.near_pairs(df).collect()] == [(1, 2, 1.0)]
    assert cap_filters.near_pairs(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_each_width_is_joined_among_itself(spark):
    x, y = vectors(120, 12), vectors(150, 12, 96)
    rows = [(-1, [1.0] * 3)] + [(k, v.tolist()) for k, v in enumerate(x)] + [(1000 + k, v.tolist()) for k, v in enumerate(y)] + [(5000, [1.0, 2.0]), (5001, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    got = {(r.vec_a, r.vec_b) for r in cap_filters.near_pairs(df).collect()}
    for at, want in ((0, near(x)), (1000, near(y))):
        want = {(at + a, at + b) for a, b in want}
        found = {p for p in got if at <= p[0] < at + 1000}
        assert found <= want and len(found) >= 0.9 * len(want) > 100
    assert {p for p in got if p[0] < 0 or p[0] >= 2000} == {(5000, 5001)}
