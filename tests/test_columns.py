import pytest
from pyspark.sql import functions as F

from lexloom.functions import chars
from lexloom.functions import normalizers as nz
from lexloom.functions import spans as sp
from lexloom.operators import batches, encode
from lexloom.operators import pipeline_json as pj
from lexloom.streaming.encode import encode_stream, read_texts, token_rates
from tests.test_models import bpe, unigram, wordpiece

SPANS = "array<struct<start:int,stop:int>>"


def one(df, column):
    return df.select(column.alias("x")).first().x


def spans(spark, text, *pairs):
    return spark.createDataFrame([(text, [{"start": a, "stop": b} for a, b in pairs])], f"text string, spans {SPANS}")


def test_span_functions(spark):
    df = spans(spark, "a🙂b", (0, 0), (1, 2), (2, 6), (6, 7), (3, 4), (3, 3), (6, 9))
    each = lambda f: one(df, F.transform("spans", f))
    t = F.col("text")
    assert each(sp.has_span) == [False] + [True] * 6
    assert each(sp.has_nonempty_span) == [False, True, True, True, True, False, True]
    assert each(sp.span_ncodeunits) == [0, 1, 4, 1, 1, 0, 3]
    assert each(lambda s: sp.try_span_substring(t, s)) == ["", "a", "🙂", "b", None, "", None]
    assert one(df, sp.span_substrings(t, F.col("spans"))) == ["", "a", "🙂", "b", None, "", None]
    assert [bytes(x) for x in each(lambda s: sp.span_codeunits(t, s))] == [b"", b"a", "🙂".encode(), b"b", "🙂".encode()[1:2], b"", b""]
    assert [one(df, sp.is_valid_string_boundary(t, F.lit(k))) for k in range(9)] == [False, True, True, False, False, False, True, True, False]
    assert sp.offsets_sentinel() == (0, 0) and sp.offsets_index_base() == 1


def test_span_contract(spark):
    check = lambda *p: [one(spans(spark, "aé", *p), f) for f in (sp.validate_offsets_contract(F.col("text"), F.col("spans")), sp.validate_offsets_contract(F.col("text"), F.col("spans"), True), sp.offsets_are_nonoverlapping(F.col("spans")))]
    assert check((1, 2), (2, 4)) == [True, True, True]
    assert check((1, 3), (2, 4)) == [True, False, False]
    assert check((1, 5)) == [False, False, True]
    assert check((0, 0), (1, 2), (0, 0), (2, 4)) == [True, True, True]
    assert check() == [True, True, True]
    with pytest.raises(Exception, match="outside"):
        spans(spark, "a", (1, 9)).select(sp.assert_offsets_contract(F.col("text"), F.col("spans"))).collect()


TEXTS = ["", "a", "Hello, World!  12x3", "naïve Café\tA\u0085b", "日本語 text 🙂", "a\x00b‍c�", "x$y+z^`|~", "  lead", "don't we'll  stop \n\n end  "]


def both(spark, column, function):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    got = [r.x for r in df.select(column(F.col("text")).alias("x")).collect()]
    assert got == [function(t) for t in TEXTS]


@pytest.mark.parametrize(
    "column, block, apply",
    [
        (nz.bert_chinese_spacing, {"type": "BertNormalizer", "clean_text": False, "handle_chinese_chars": True, "strip_accents": False, "lowercase": False}, pj.normalize),
        (nz.bert_clean_text, {"type": "BertNormalizer", "clean_text": True, "handle_chinese_chars": False, "strip_accents": False, "lowercase": False}, pj.normalize),
        (nz.lowercase, {"type": "Lowercase"}, pj.normalize),
        (lambda t: nz.prepend(t, "_"), {"type": "Prepend", "prepend": "_"}, pj.normalize),
        (lambda t: nz.replace(t, "[lo]+", "$1"), {"type": "Replace", "pattern": "[lo]+", "content": "$1"}, pj.normalize),
        (nz.bert_pretokenize, {"type": "BertPreTokenizer"}, pj.pretokenize),
        (nz.digits, {"type": "Digits", "individual_digits": False}, pj.pretokenize),
        (lambda t: nz.digits(t, True), {"type": "Digits", "individual_digits": True}, pj.pretokenize),
        (nz.punctuation, {"type": "Punctuation", "behavior": "isolated"}, pj.pretokenize),
        (lambda t: nz.punctuation(t, "removed"), {"type": "Punctuation", "behavior": "removed"}, pj.pretokenize),
        (lambda t: nz.split(t, "l+"), {"type": "Split", "pattern": "l+", "behavior": "isolated"}, pj.pretokenize),
        (lambda t: nz.metaspace(t, "▁", True), {"type": "Metaspace", "replacement": "▁", "add_prefix_space": True}, pj.pretokenize),
    ],
)
def test_columns_agree_with_the_pipeline(spark, column, block, apply):
    both(spark, column, lambda t: apply(block, t))


def test_splits_agree(spark):
    both(spark, nz.word_split, chars.words)
    both(spark, nz.gpt2_split, pj.BYTE_LEVEL_SPLIT.findall)


def test_encode_columns(spark, texts):
    model = wordpiece()
    rows = texts.select("text", encode.encode(model, F.col("text"), True).alias("ids"), encode.tokenize(model, F.col("text")).alias("p"), encode.count_tokens(model, F.col("text")).alias("n")).collect()
    for r in rows:
        if r.text is None:
            assert r.ids is None and r.p is None and r.n is None
        else:
            assert r.ids == model.encode(r.text, True) and r.p == model.tokenize(r.text) and r.n == len(r.p)


def test_encoding_struct_and_null_text(spark, texts):
    model = wordpiece()
    out = texts.withColumn("e", encode.encode_result(model, F.col("text"), return_offsets=True, return_masks=True))
    for r in out.collect():
        if r.text is None:
            assert r.e is None
            continue
        want = encode.models.encode_result(model, r.text, True, False, True, True)
        assert r.e.ids == want["ids"] and r.e.special_tokens_mask == want["special_tokens_mask"]
        assert [tuple(s) for s in r.e.offsets] == want["offsets"]
    assert out.select(encode.encoding_metadata(model).alias("m")).first().m.format == "wordpiece"


def test_long_tokens_and_words_once(spark, texts):
    model = wordpiece()
    long = encode.tokens_long(model, texts).where("doc_id = 3").orderBy("pos").collect()
    assert [(r.pos, r.token, r.start, r.stop) for r in long][:2] == [(1, "hello", 1, 6), (2, "[UNK]", 7, 13)]
    got = {r.lang: (r.n_tokens, r.n_unknown) for r in encode.count_by_words(model, texts, ["lang"]).collect()}
    want = {}
    for r in texts.where("text is not null").collect():
        p = model.tokenize(r.text)
        a, b = want.get(r.lang, (0, 0))
        want[r.lang] = (a + len(p), b + p.count("[UNK]"))
    assert got == want


def test_decode_columns(spark):
    for model, column in ((bpe(), lambda p: nz.marker_decoded(p, "</w>")), (wordpiece(), nz.wordpiece_decoded), (unigram("▁"), lambda p: nz.marker_decoded(p, "▁"))):
        df = spark.createDataFrame([("hello hello",), ("",)], "text string").select("text", encode.tokenize(model, F.col("text")).alias("p"), encode.encode(model, F.col("text")).alias("i"))
        for r in df.select("text", column(F.col("p")).alias("a"), encode.decode(model, F.col("i")).alias("b")).collect():
            assert r.a == r.b == r.text


def test_registered_function_and_own_normalizer(spark, texts):
    name = encode.register(spark, wordpiece())
    assert spark.sql(f"SELECT {name}('hello') AS p").first().p == ["hello"]
    assert one(texts.where("doc_id = 0"), encode.normalize_text(F.col("text"), str.upper)) == "LOW LOWER LOWEST"
    with pytest.raises(Exception, match="not a string"):
        texts.select(encode.normalize_text(F.col("text"), len)).collect()


def sequences(spark):
    return spark.createDataFrame([(1, 0, [5, 6, 7]), (1, 1, [8]), (2, 0, [9, 9])], "batch_id bigint, seq bigint, ids array<int>")


def test_collate(spark):
    rows = batches.collate_padded_batch(sequences(spark), 0, pad_to_multiple_of=2).orderBy("batch_id", "seq").collect()
    assert [r.ids for r in rows] == [[5, 6, 7, 0], [8, 0, 0, 0], [9, 9]]
    assert [r.attention_mask for r in rows] == [[1, 1, 1, 0], [1, 0, 0, 0], [1, 1]]
    assert [r.special_tokens_mask for r in rows] == [[0, 0, 0, 1], [0, 1, 1, 1], [0, 0]]
    assert [r.sequence_length for r in rows] == [3, 1, 2]
    with pytest.raises(ValueError):
        batches.collate_padded_batch(sequences(spark), 0, pad_side="left")
    with pytest.raises(ValueError):
        batches.collate_padded_batch(sequences(spark), 0, pad_to_multiple_of=0)
    with pytest.raises(Exception, match="differ in length"):
        batches.collate_padded_batch(sequences(spark).withColumn("t", F.array(F.lit(0))), 0, type_col="t").collect()


def test_labels(spark):
    df = spark.createDataFrame([([5, 6, 7, 0], [1, 1, 1, 0]), ([5, 9, 6, 7], [1, 0, 1, 1]), ([], [])], "ids array<int>, m array<int>")
    label = lambda **o: [r.x for r in df.select(batches.causal_lm_labels(F.col("ids"), F.col("m"), **o).alias("x")).collect()]
    assert label() == [[6, 7, -100, -100], [6, -100, 7, -100], []]
    assert label(ignore_index=-1, zero_based=True) == [[5, 6, -1, -1], [5, -1, 6, -1], []]
    long = spark.createDataFrame([(1, 1, 5, 1), (1, 2, 9, 0), (1, 3, 6, 1)], "s bigint, pos bigint, token_id bigint, m int")
    assert [r.label for r in batches.causal_labels_long(long, ("s",), mask_col="m").orderBy("pos").collect()] == [6, -100, -100]


def test_packing_into_blocks(spark):
    df = spark.createDataFrame([(k, [k + 1] * (k % 3 + 1)) for k in range(7)], "seq bigint, ids array<int>")
    flat = []
    for k in range(7):
        flat += [k + 1] * (k % 3 + 1) + ([0] if k < 6 else [])
    got = [x for r in batches.packed_ids(df, 4, "seq", "ids", 99, separator_id=0).orderBy("block").collect() for x in r.ids]
    assert got == flat + [99] * (-len(flat) % 4)
    starts = [r.start for r in batches.pack_blocks(df.withColumn("n", F.size("ids")), 4, "seq", "n", separator=1).orderBy("seq").collect()]
    assert starts == [sum(j % 3 + 2 for j in range(k)) for k in range(7)]


def test_causal_batch(spark):
    df = spark.createDataFrame([(1, "hello world"), (1, "hello")], "batch_id bigint, text string")
    rows = batches.quick_causal_lm_batch(wordpiece(), df).orderBy("text").collect()
    assert [r.ids for r in rows] == [[3, 6, 4, 1, 1], [3, 6, 12, 11, 4]]
    assert rows[0].labels == [6, 4, -100, -100, -100]
    assert batches.resolve_pad_id(bpe()) == 3
    with pytest.raises(ValueError):
        batches.resolve_pad_id(unigram())


def test_alignment(spark):
    df = spark.createDataFrame([(1, "hello  wörld\n x")], "doc_id bigint, text string")
    words = batches.word_offsets(df)
    assert [(r.word, r.start, r.stop) for r in words.orderBy("word_index").collect()] == [("hello", 1, 6), ("wörld", 8, 14), ("x", 16, 17)]
    tokens = spark.createDataFrame([(1, 1, 1, 4), (1, 2, 4, 6), (1, 3, 5, 10), (1, 4, 6, 8), (1, 5, 0, 0)], "doc_id bigint, pos bigint, start bigint, stop bigint")
    assert {r.pos: r.word_index for r in batches.subword_to_word(tokens, words).collect()} == {1: 1, 2: 1, 3: 2}
    spans = spark.createDataFrame([(1, 7, 4, 6)], "doc_id bigint, span_id bigint, span_start bigint, span_stop bigint")
    assert sorted(r.pos for r in batches.span_to_tokens(tokens, spans).collect()) == [2, 3]


def test_quick_tokenize():
    r = encode.quick_tokenize(wordpiece(), "hello world")
    assert r["token_pieces"] == ["[CLS]", "hello", "wor", "##ld", "[SEP]"] and r["decoded_text"] == "hello world"
    assert r["offsets"][1] == (1, 6) and len(r) == 9


def test_streams_give_what_tables_give(spark, texts, tmp_path):
    texts.withColumn("ts", F.timestamp_seconds(F.col("doc_id") * 60)).write.parquet(str(tmp_path / "in"))
    schema = "doc_id bigint, text string, lang string, ts timestamp"
    stream = read_texts(spark, str(tmp_path / "in"), schema)
    q = encode_stream(stream, wordpiece()).writeStream.format("memory").queryName("encoded").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("encoded").count() == texts.count()
    assert spark.table("encoded").where("text is not null").selectExpr("sum(size(encoding.ids)) AS n").first().n == sum(len(wordpiece().encode(r.text, True)) for r in texts.collect() if r.text is not None)
    rates = token_rates(stream, wordpiece(), "ts").writeStream.format("memory").queryName("rates").outputMode("complete").start()
    rates.processAllAvailable()
    rates.stop()
    assert spark.table("rates").selectExpr("sum(texts) AS n").first().n == texts.count()


def test_boundaries_of_word_offsets_are_those_of_the_text(spark):
    from lexloom.operators import batches

    rows = [(1, "é x 日本 a"), (2, None), (3, ""), (4, "ab é"), (5, "🙂"), (6, "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    found = batches.word_offsets(df, boundaries=True).join(df, "doc_id")
    both = found.select("boundary", sp.is_valid_string_boundary(F.col("text"), (F.col("start") + 1).cast("int")).alias("want")).collect()
    assert len(both) == 8 and all(r.boundary == r.want for r in both)


def test_texts_without_words_are_left_out_as_in_the_sql(spark, tmp_path):
    import duckdb

    from lexloom.plans import catalogue

    rows = [(k, t) for k, t in enumerate(["the house", "", "\x07 ", None, "  \n", "a, b"])]
    spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'en' lang").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, catalogue.QUERIES["hf_bert_pipeline"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(catalogue.ORACLE_SQL["hf_bert_pipeline"]).fetchall()) and [k for k, _ in got] == [0, 5]
