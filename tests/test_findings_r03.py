"""What the third round's findings are about: edits at every length of text, and batches that Python functions get."""

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry


def test_change_counts_of_long_texts(spark, tmp_path):
    body = " ".join(f"word{k * 7919 % 100003}" for k in range(21000))
    assert len(body) > 200_000
    rows = [(k, "en", "s", body[k:]) for k in range(16)] + [(16 + k, "en", "s", "short text of some words, long enough for every place") for k in range(16)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = entry.queries()["change_counts"](spark, str(tmp_path)).collect()
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(duck.execute(entry.oracle_sql()["change_counts"]).fetchall())


def test_runs_of_equal_length_are_taken_in_one_pass():
    from siftglass.functions.sequences import compare

    assert compare("abc\r\n" * 20000, "abc\n" * 20000) == (80000, 20000)


@F.arrow_udf(T.IntegerType())
def rows_at_once(texts: pa.Array) -> pa.Array:
    return pa.array([len(texts)] * len(texts), pa.int32())


@pytest.mark.parametrize("kind", ["artifacts", "pairs"])
def test_python_functions_get_small_batches(spark, kind):
    from siftglass.functions.barrier import BATCH_BYTES
    from siftglass.operators.artifacts import artifacts_from_text
    from siftglass.operators.checks import with_text_checks

    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(limit)
    size = 100_000
    texts = spark.range(0, 300, 1, 1).select("id", F.repeat(F.lit("a"), size).alias("t"))
    made = artifacts_from_text(texts, "id", "t").select("text") if kind == "artifacts" else with_text_checks(texts.withColumn("u", F.col("t")), "t", "u").select(F.col("t").alias("text"))
    most = made.select(rows_at_once("text").alias("n")).agg(F.max("n")).first()[0]
    assert most <= BATCH_BYTES // size + 2
    spark.conf.set(limit, "1m")
    artifacts_from_text(texts, "id", "t")
    assert spark.conf.get(limit) == "1m"  # a limit set by hand stays
    spark.conf.unset(limit)


def test_controls_are_told_by_a_coarse_class_first(spark):
    from siftglass.functions.charsets import MAYBE_CONTROL, format_and_control_class
    from siftglass.functions.visible import without_controls

    points = spark.range(0, 0x110000, 1, 4).where("id NOT BETWEEN 55296 AND 57343")
    c = points.select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'utf-32')").alias("c"))
    text = F.concat(F.lit("a"), F.col("c"), F.lit("b "), F.col("c"), F.col("c"))
    assert c.where(without_controls(text) != F.regexp_replace(text, format_and_control_class(), "")).count() == 0
    assert c.where(~F.col("c").rlike(MAYBE_CONTROL) & F.col("c").rlike(format_and_control_class())).count() == 0
