"""Encoding of streams: row by row, so nothing is kept between batches.

An extra over batch use: the same functions on a streaming DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.encode import count_tokens, encode_result
from ..operators.models import Tokenizer


def read_texts(spark: SparkSession, path: str, schema: StructType | str, format: str = "parquet", files_per_batch: int = 64) -> DataFrame:
    """A folder's files, new ones as they come."""
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def encode_stream(stream: DataFrame, model: Tokenizer, text_col: str = "text", **options) -> DataFrame:
    """The stream with an encoding for each row; any output mode and sink will do."""
    return stream.withColumn("encoding", encode_result(model, F.col(text_col), **options))


def token_rates(stream: DataFrame, model: Tokenizer, time_col: str, text_col: str = "text", window: str = "5 minutes", late: str = "10 minutes", keys: tuple[str, ...] = ()) -> DataFrame:
    """Tokens by time window and keys, for rows that are at most ``late`` behind."""
    counted = stream.withColumn("n_tokens", count_tokens(model, F.col(text_col)))
    return counted.withWatermark(time_col, late).groupBy(F.window(time_col, window), *keys).agg(F.count(F.lit(1)).alias("texts"), F.sum("n_tokens").alias("n_tokens"))
