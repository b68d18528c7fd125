"""Helpers that the operators share: scratch tables, Arrow maps, hashing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftglass.sources.salt import dealt_out

#: Rows of an Arrow batch sent to Python; documents may be long, so batches are short.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory, read through Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of long texts; one that comes in fewer splits than there are cores, as a single row group does, is dealt out."""
    return dealt_out(table(spark, sf_dir, name))


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share.

    It is the one the cluster names in ``spark.checkpoint.dir``.  Only a session on one machine may leave
    that setting out, and then uses a folder below its warehouse.
    """
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not named:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one table below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back: its lineage ends there.

    Every task's rows are committed once, so later readers agree on them even if executors are lost.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def short_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Keep Arrow batches short enough for long documents."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def arrow_map(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType
) -> DataFrame:
    """``mapInArrow`` with short batches."""
    short_batches(df.sparkSession)
    return df.mapInArrow(function, schema)


def id_and_text(df: DataFrame, id_col: str, text_col: str, binary: bool = False) -> DataFrame:
    """Two columns ``(id, text)``; whatever else the input has can't clash with what is made here."""
    text: Column = F.col(f"`{text_col}`").cast("string")
    return df.select(F.col(f"`{id_col}`").alias("id"), (text.cast("binary") if binary else text).alias("text"))


def id_field(df: DataFrame, id_col: str) -> T.DataType:
    """The type of the id column."""
    return df.schema[id_col].dataType


def renamed(df: DataFrame, old: str, new: str) -> DataFrame:
    """``df`` with one column renamed, in place."""
    return df.select(*[F.col(f"`{c}`").alias(new if c == old else c) for c in df.columns])
