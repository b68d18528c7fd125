"""A stream of dropped files: found, inspected and cleaned as they arrive.

Every operator on artifacts works on one row at a time, so the same functions serve tables and streams and
no state is kept; only counts over time need a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftglass.operators.artifacts import artifacts_from_text
from siftglass.operators.text_findings import text_findings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents_stream(spark: SparkSession, folder: str, schema: str = SCHEMA, files_at_once: int = 100) -> DataFrame:
    """Documents from Parquet files that are dropped into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def findings_stream(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The findings of each document, once it arrives."""
    return text_findings(artifacts_from_text(documents, key, text))


def findings_over_time(documents: DataFrame, time: str, late: str = "10 minutes", window: str = "5 minutes", key: str = "doc_id", text: str = "text") -> DataFrame:
    """How many findings of each category came in each window of time; rows later than ``late`` are dropped."""
    timed = documents.withWatermark(time, late).select(F.col(key).alias("artifact_id"), F.col(time).alias("time"), F.lit("text").alias("kind"), F.col(text).alias("text"))
    return text_findings(timed, ("time",)).groupBy(F.window("time", window).alias("window"), "category").agg(F.sum("count").alias("n"))
