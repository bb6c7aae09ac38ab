"""Encoding, decoding and normalizing of text columns.

All of it is row-local: Arrow batches run through a model that executors get once,
so no shuffle is needed and the same calls work on a stream.  A null text gives a
null result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays, models
from .models import Tokenizer
from .pipeline_json import Pipeline
from .pipeline_json import normalize as normalize_block

SPAN = "struct<start:int,stop:int>"
ENCODING = f"struct<ids:array<int>,tokens:array<string>,offsets:array<{SPAN}>,attention_mask:array<int>,token_type_ids:array<int>,special_tokens_mask:array<int>>"
METADATA = "struct<format:string,model_name:string,add_special_tokens:boolean,assume_normalized:boolean,offsets_coordinates:string,offsets_reference:string>"


def _mapper(function: Callable, kind: str) -> Callable[[Column], Column]:
    """A one-column Arrow function, given a function of one value that isn't null."""

    @F.pandas_udf(kind)
    def run(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in values:
            yield pd.Series([None if v is None else function(v) for v in batch], dtype=object)

    return run


def tokenize(model: Tokenizer, text: Column) -> Column:
    return _mapper(model.tokenize, "array<string>")(text)


def encode(model: Tokenizer, text: Column, add_special_tokens: bool = False) -> Column:
    @F.arrow_udf("array<int>")
    def run(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in values:
            yield from arrays.encoded_parts(model, batch, add_special_tokens)

    return F.when(text.isNotNull(), run(text))


def decode(model: Tokenizer, ids: Column) -> Column:
    return _mapper(lambda i: model.decode([int(x) for x in i]), "string")(ids)


def count_tokens(model: Tokenizer, text: Column, add_special_tokens: bool = False) -> Column:
    """The number of ids, without making them into arrays for the JVM."""

    @F.arrow_udf("bigint")
    def run(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in values:
            yield arrays.counted(model, batch, add_special_tokens)

    # else a filter on the number would have it made a second time
    return F.when(text.isNotNull(), run.asNondeterministic()(text))


def normalize_text(text: Column, normalizer: Callable[[str], str] | None = None) -> Column:
    """A text by a function of the caller's, which must return a string."""
    if normalizer is None:
        return text

    def checked(value: str) -> str:
        out = normalizer(value)
        if not isinstance(out, str):
            raise TypeError(f"the normalizer returned {type(out).__name__}, not a string")
        return out

    return _mapper(checked, "string")(text)


def normalized(text: Column, block: dict) -> Column:
    """A text by a normalizer's block of tokenizer.json."""
    return _mapper(lambda t: normalize_block(block, t), "string")(text)


def tokenization_view(model: Tokenizer, text: Column) -> Column:
    """The text that offsets refer to."""
    return _mapper(model.normalize, "string")(text) if model.needs_normalization else text


def requires_tokenizer_normalization(model: Tokenizer) -> bool:
    return model.needs_normalization


def encode_result(model: Tokenizer, text: Column, add_special_tokens: bool = True, assume_normalized: bool = False, return_offsets: bool = False, return_masks: bool = False) -> Column:
    """The encoding as one struct; parts that aren't asked for are null."""

    @F.arrow_udf(ENCODING)
    def run(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in values:
            yield from arrays.result_parts(model, batch, add_special_tokens, assume_normalized, return_offsets, return_masks)

    return F.when(text.isNotNull(), run(text))


def span_totals(model: Tokenizer, text: Column) -> Column:
    """n_tokens, the sums of the starts, stops and their products, and whether the spans are apart, of the spans of ``encode_result``
    without special tokens; they aren't made into arrays for the JVM.  Null where spans can't be told."""

    @F.arrow_udf("struct<n_tokens:bigint,starts:bigint,stops:bigint,products:bigint,apart:boolean>")
    def run(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in values:
            yield from arrays.total_parts(model, batch)

    # else a filter on the result would have it made a second time
    return F.when(text.isNotNull(), run.asNondeterministic()(text))


def encoding_metadata(model: Tokenizer, add_special_tokens: bool = True, assume_normalized: bool = False) -> Column:
    info = models.encode_result(model, "", False)["metadata"] | {"add_special_tokens": add_special_tokens, "assume_normalized": assume_normalized}
    if assume_normalized:
        info["offsets_reference"] = "input_text"
    return F.struct(*[F.lit(v).alias(k) for k, v in info.items()])


def encode_batch_result(model: Tokenizer, df: DataFrame, text_col: str = "text", out_col: str = "encoding", **options) -> DataFrame:
    return df.withColumn(out_col, encode_result(model, df[text_col], **options))


def tokens_long(model: Tokenizer, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", add_special_tokens: bool = False) -> DataFrame:
    """A row for each token: id_col, pos (from 1), token_id, token, start, stop, is_special."""
    encoded = df.select(df[id_col].alias("_id"), encode_result(model, df[text_col], add_special_tokens, return_offsets=True, return_masks=True).alias("e"))
    arrays = F.arrays_zip(F.col("e.ids").alias("i"), F.col("e.tokens").alias("t"), F.col("e.offsets").alias("o"), F.col("e.special_tokens_mask").alias("m"))
    rows = encoded.select("_id", F.posexplode(arrays).alias("p", "r"))
    return rows.select(F.col("_id").alias(id_col), (F.col("p") + 1).cast("bigint").alias("pos"), F.col("r.i").cast("bigint").alias("token_id"), F.col("r.t").alias("token"), F.col("r.o.start").cast("bigint").alias("start"), F.col("r.o.stop").cast("bigint").alias("stop"), F.col("r.m").cast("bigint").alias("is_special"))


def word_tokens(model: Tokenizer, words: DataFrame, word_col: str = "word") -> DataFrame:
    """``words`` with pieces and ids of each word: for word-wise families, each distinct word is encoded once."""
    if isinstance(model, (models.Tiktoken, Pipeline)):
        return words.withColumn("pieces", tokenize(model, F.col(word_col)))

    @F.arrow_udf("array<string>")
    def run(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in values:
            yield from arrays.token_parts(model, batch)

    return words.withColumn("pieces", F.when(F.col(word_col).isNotNull(), run(F.col(word_col))))


def count_by_words(model: Tokenizer, df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, n_tokens, n_unknown: words are counted first and each distinct word is encoded once.

    For families that split at white space.  The only shuffle is of word counts, combined before it.
    """
    from ..functions.normalizers import word_split

    words = df.select(*keys, F.explode(word_split(F.col(text_col))).alias("_word")).groupBy(*keys, "_word").agg(F.count(F.lit(1)).alias("_n"))

    @F.pandas_udf("struct<tokens:bigint,unknown:bigint>")
    def sizes(values: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        unknown = model.unknown
        for batch in values:
            found = [model.memo[w] for w in batch]
            yield pd.DataFrame({"tokens": [len(p) for p in found], "unknown": [sum(x == unknown for x in p) for p in found]})

    sized = words.withColumn("_s", sizes("_word"))
    return sized.groupBy(*keys).agg(F.sum(F.col("_n") * F.col("_s.tokens")).alias("n_tokens"), F.sum(F.col("_n") * F.col("_s.unknown")).alias("n_unknown"))


def as_callable(model: Tokenizer) -> Callable[[Column], Column]:
    """The tokenizer as a function of a column, for use by other libraries."""
    return lambda text: tokenize(model, text)


def level_key(model: Tokenizer) -> str:
    """The name by which such a function is registered."""
    return f"{model.format}_{''.join(c if c.isalnum() else '_' for c in model.name)}"


def register(spark: SparkSession, model: Tokenizer) -> str:
    """Makes the tokenizer an SQL function; returns its name."""
    name = level_key(model)
    spark.udf.register(name, _mapper(model.tokenize, "array<string>"))
    return name


def quick_tokenize(model, text: str, add_special_tokens: bool = True) -> dict:
    """Everything about one text, by a tokenizer, key or path."""
    model = resolve(model)
    view = model.normalize(text)
    r = models.encode_result(model, view, add_special_tokens, True, True, True)
    return {"token_pieces": r["tokens"], "token_ids": r["ids"], "decoded_text": model.decode(r["ids"]), "tokenization_text": view, "offsets": r["offsets"], "attention_mask": r["attention_mask"], "token_type_ids": r["token_type_ids"], "special_tokens_mask": r["special_tokens_mask"], "metadata": r["metadata"]}


def quick_encode_batch(model, df: DataFrame, text_col: str = "text", add_special_tokens: bool = True) -> DataFrame:
    """``df`` with tokenization_text, encoding and sequence_length."""
    model = resolve(model)
    viewed = df.withColumn("tokenization_text", tokenization_view(model, df[text_col]))
    encoded = viewed.withColumn("encoding", encode_result(model, F.col("tokenization_text"), add_special_tokens, True, True, True))
    return encoded.withColumn("sequence_length", F.size("encoding.ids"))


def resolve(model) -> Tokenizer:
    if isinstance(model, Tokenizer):
        return model
    from ..sources.files import get_tokenizer_cached

    return get_tokenizer_cached(model)
