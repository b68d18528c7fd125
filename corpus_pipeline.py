"""The corpus pipeline: five operators of ``siftglass.llm`` in order, each on all that the one before kept.

Every stage takes null texts, ids and sources, empty and repeated rows and an empty table; what it does with them is
said in its docstring or that of its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftglass.llm.bpe_automaton import encode_decode
from siftglass.llm.common import dealt, table, written
from siftglass.llm.decontaminate import drop_contaminated
from siftglass.llm.line_dedup import line_dedup
from siftglass.llm.quality_rules import fit, keep_good
from siftglass.llm.simhash import near_dedup


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base test or a learned rule go, null and empty texts with them."""
    return keep_good(docs, fit(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in too large a share of a source's distinct texts go, but never all of a text; ``n_chars`` follows the text.

    Rows without a source keep their lines, and a null text stays null.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = line_dedup(docs, F.col("source"), F.col("text"), "doc_id", keep=others, copies_once=True)
    columns = [F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id; null and empty texts are a group."""
    return near_dedup(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a whole benchmark window occurs go, and those that short items contaminate."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and what they decode to, as digests, of what is left; a null text has no tokens."""
    import public_tokenizers

    return encode_decode(docs, str(public_tokenizers.path("word_bpe_49k.json")), digests=True)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("bpe_encode_decode", tokens_stage),
]

#: SQL has neither the learned rules nor the fingerprints nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written and read again."""
    docs = dealt(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
