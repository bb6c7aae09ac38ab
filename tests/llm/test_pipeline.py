"""The corpus pipeline's stages against brute force."""

import random
from collections import Counter

import corpus_pipeline
from lexloom.llm import language, mixing
from tests.llm.test_pairs import brute
from tests.llm.test_text_operators import PROSE

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows():
    rng = random.Random(11)
    out = []
    for k in range(150):
        lang = rng.choice(list(PROSE))
        words = PROSE[lang].split()
        out.append((k, " ".join(rng.choice(words) for _ in range(rng.randrange(15, 80))), lang, f"s{k % 4 if k % 2 else 0}"))
    out += [(200 + k, out[k][1], out[k][2], "copy") for k in range(20)]
    out += [(300 + k, out[k][1] + " indeed", out[k][2], "near") for k in range(20, 40)]
    out += [(400, "you worthless idiot you moron", "en", "bad"), (401, None, "en", "bad"), (402, "12 34 56", "en", "bad"), (403, "", None, None)]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in out]


def test_stages(spark, tmp_path):
    data = rows()
    folder = str(tmp_path)
    spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] == 400)) for r in data if r[0] % 3 == 1], "doc_id bigint, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{k}.parquet")
        docs = spark.read.parquet(f"{folder}/{k}.parquet")
        if name != "packing":
            assert docs.columns == COLUMNS
        kept[name] = docs
    ids = {n: {r.doc_id for r in df.select("doc_id").collect()} for n, df in kept.items()}
    everything = {r[0] for r in data}
    assert ids["toxicity"] == everything - {400}
    assert ids["language"] == everything - {400, 401, 402, 403}
    # the stage's labels are those of a fit on its own input
    before = {r.doc_id: r for r in language.identify(kept["toxicity"], language.fit(kept["toxicity"])).collect()}
    assert all(before[r.doc_id].keep and before[r.doc_id].predicted == r.lang for r in kept["language"].collect())
    texts = [(r.doc_id, r.text) for r in kept["language"].collect()]
    parent = {i: i for i, _ in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b, _ in brute(texts):
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert ids["near_copies"] == {i for i in parent if root(i) == i}
    assert not ids["near_copies"] & set(range(200, 220)) and ids["near_copies"]
    copies = {r.doc_id: r.copies for r in mixing.mix_counts(kept["near_copies"]).collect()}
    assert Counter(r.doc_id for r in kept["mixing"].collect()) == +Counter(copies)
    packed = kept["packing"].collect()
    assert Counter(r.doc_id for r in packed if r.first_token == 0) == +Counter(copies)
    whole = corpus_pipeline.run(spark, folder)
    assert Counter(map(str, whole.collect())) == Counter(map(str, packed))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_null_ids_long_texts_and_clashing_columns(spark, tmp_path):
    rng = random.Random(5)
    words = PROSE["en"].split()
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    data = [(k, prose(40), "en", "s0") for k in range(120)]
    data += [(None, prose(40 + k), "en", None) for k in range(5)]
    data += [(500, prose(60000), "en", "s1"), (501, prose(30) + " " * 1_000_000 + prose(30), "en", "s1")]
    extra = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, key string, mass string, predicted int, score int, keep string, copies int, region int, bin int, tokens string, n_tokens string"
    frame = spark.createDataFrame([(*r, len(r[1]), "i", "k", "m", 1, 2, "x", 3, 4, 5, "t", "n") for r in data], extra)
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, 1), (1, None), (2, 0), (7, 0)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{k}.parquet")
        if name in ("toxicity", "language", "near_copies"):
            assert sorted((r.doc_id or -1, r.text) for r in docs.collect()) == sorted((i or -1, t) for i, t, _, _ in data)
        if name == "mixing":
            copies = Counter((r.doc_id, r.text) for r in docs.collect())
    packed = docs.collect()
    assert {i for i, _ in copies} == {r.doc_id for r in packed}
    assert sum(copies.values()) == sum(r.first_token == 0 for r in packed)
