"""Token counts with a digest cache.

A text's normalised content (null becomes empty; UTF-8 otherwise as it is) and the tokenizer's file are
digested.  Stored counts are joined on both digests; only the distinct texts that the cache lacks are
encoded, once each, and their counts are appended to it.  With a full cache no text leaves its partition.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftglass.llm.common import arrow_map, shared_dir, written

CACHE = T.StructType(
    [
        T.StructField("tokenizer", T.StringType()),
        T.StructField("content", T.BinaryType()),
        T.StructField("n_tokens", T.LongType()),
    ]
)
#: Texts are encoded in groups of about this many bytes, so that memory doesn't follow the longest batch.
GROUP_BYTES = 2 << 20


def tokenizer_digest(path: str) -> str:
    """The version of a tokenizer: the digest of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def counter(path: str) -> Any:
    """A function from a list of texts to their token counts, as the file's own library counts."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    raise ValueError(f"no library for {path}")


def empty_cache(spark: Any) -> DataFrame:
    """A cache without counts."""
    return spark.createDataFrame([], CACHE)


def read_cache(spark: Any, path: str) -> DataFrame:
    """The cache stored at a path; empty if nothing is there yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return empty_cache(spark)
    return spark.read.schema(CACHE).parquet(path)


def cache_of(spark: Any, corpus: str) -> str:
    """Where the counts of one corpus are kept: in the shared folder, under the digest of the corpus' own path."""
    return f"{shared_dir(spark)}/token_cache/{hashlib.sha256(corpus.encode()).hexdigest()[:32]}"


def _groups(texts: list[str]) -> Iterator[list[str]]:
    group: list[str] = []
    size = 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= GROUP_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def token_counts(
    documents: DataFrame,
    tokenizer_path: str,
    cache_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 512,
) -> DataFrame:
    """One row per document: ``id_col, n_bytes, n_tokens, over_limit``.

    Runs the encoding of the misses and appends them to ``cache_path`` before it returns.  The tokenizer's
    file must be at ``tokenizer_path`` on every machine.  Null texts count as empty ones (0 bytes, 0
    tokens).  Repeated texts are encoded once; repeated rows and null ids stay as they are.  An empty table
    gives an empty result and leaves the cache as it was.  A cache that was written twice for one text
    (two jobs at once) still gives one row per document.
    """
    spark = documents.sparkSession
    version = tokenizer_digest(tokenizer_path)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    keyed = documents.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")).withColumn(
        "content", F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    )
    #: Digests alone are compared with the cache; of each one that it lacks, one row is to be encoded.
    known = read_cache(spark, cache_path).where(F.col("tokenizer") == version).select("content")
    digests = keyed.groupBy("content").agg(F.min("id").alias("least"))
    misses = written(digests.join(known, "content", "left_anti").select(F.col("content").alias("missed"), "least"), "misses")
    if misses.limit(1).count():
        _encode(keyed.join(misses, (F.col("content") == F.col("missed")) & F.equal_null("id", "least")).select("content", "text"), tokenizer_path).select(
            F.lit(version).alias("tokenizer"), "content", "n_tokens"
        ).write.mode("append").parquet(cache_path)
    stored = (
        read_cache(spark, cache_path)
        .where(F.col("tokenizer") == version)
        .groupBy("content")
        .agg(F.max("n_tokens").alias("n_tokens"))
    )
    #: Written, so that the join below has a plain shuffle on either side and a hot text's rows can be split.
    stored = written(stored.join(digests.select("content"), "content", "left_semi"), "counts")
    sizes = keyed.select("id", "content", F.octet_length("text").cast("long").alias("n_bytes"))
    return sizes.join(stored, "content").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def _encode(texts: DataFrame, tokenizer_path: str) -> DataFrame:
    """``content, n_tokens`` of rows ``content, text``; rows that repeat a digest, which meet in one task, give one."""
    schema = T.StructType([T.StructField("content", T.BinaryType()), T.StructField("n_tokens", T.LongType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        done: set[bytes] = set()
        for batch in batches:
            count = count or counter(tokenizer_path)
            fresh: dict[bytes, int] = {}
            for k, content in enumerate(batch.column(0).to_pylist()):
                if content not in done:
                    fresh.setdefault(content, k)
            done.update(fresh)
            texts = batch.column(1).take(pa.array(list(fresh.values()), pa.int64())).to_pylist()
            n = [x for group in _groups(texts) for x in count(group)]
            yield pa.RecordBatch.from_arrays([pa.array(list(fresh), pa.binary()), pa.array(n, pa.int64())], names=["content", "n_tokens"])

    return arrow_map(texts, encode, schema)
