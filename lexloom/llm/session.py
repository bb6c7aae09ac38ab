"""Session helpers of the corpus operators: the shared folder and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in bytes of rows, that is sent to every executor.
BROADCAST_BYTES = 24 << 20


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` kept in the folder that all executors share, without their lineage.

    The folder is the cluster's ``spark.checkpoint.dir``; only where that is
    unset on one machine (as in tests) a new folder is set.
    """
    spark = df.sparkSession
    set_checkpoint_dir(spark)
    return df.checkpoint()


def set_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lexloom-"))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, so that each reader scans the columns that it needs and nothing is computed twice."""
    spark = df.sparkSession
    set_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.parquet(path)


def vocabulary(spark: SparkSession, default: str) -> str:
    """The file of token ranks: ``spark.lexloom.vocabulary`` if the session sets it."""
    return spark.conf.get("spark.lexloom.vocabulary", default)


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcast if ``rows`` rows of ``row_bytes`` stay under BROADCAST_BYTES, else as it is."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def beside(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` as the smaller side of a join with texts: sent to every executor if it is small, else hashed in each partition, so that the texts needn't be sorted."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df.hint("shuffle_hash")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
