"""Checks of a transformed text against the one before: columns that read null where nothing was decided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftglass.functions.barrier import settled, small_batches
from siftglass.functions.normalize import nfc
from siftglass.functions.visible import STRUCTURE, skeleton, structure_count, without_controls, word_similarity, words

MIN_SIMILARITY = 0.98
MAX_EXAMPLES = 10
CHECK = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("passed", T.BooleanType()), T.StructField("measurements", T.StringType())]
)
CHECKS = T.ArrayType(CHECK)


def check(name: str, passed: Column, measurements: Column | None = None) -> Column:
    """One check as a struct; its measurements are JSON."""
    return F.struct(F.lit(name).alias("name"), passed.cast("boolean").alias("passed"), (F.lit("{}") if measurements is None else F.to_json(measurements)).alias("measurements"))


def all_passed(checks: Column) -> Column:
    """Whether every decided check passed; null if none was decided."""
    decided = F.filter(checks, lambda c: c["passed"].isNotNull())
    return F.when(F.size(decided) > 0, F.forall(decided, lambda c: c["passed"]))


def failed_names(checks: Column) -> Column:
    """The names of the failed checks, joined."""
    return F.array_join(F.transform(F.filter(checks, lambda c: ~F.coalesce(c["passed"], F.lit(True))), lambda c: c["name"]), "; ")


def with_text_checks(df: DataFrame, before: str, after: str, min_similarity: float = MIN_SIMILARITY, composed: tuple[str, str] | None = None) -> DataFrame:
    """``df`` with an array column ``text_checks``: the five checks of a pair of texts.

    Skeletons and words are made once, in columns of their own; words are compared one by one only where
    the skeletons differ.  Pairs with a null side get null checks.  Columns ``composed`` hold both texts in normal form C
    if they are known, and are dropped.
    """
    if composed is None:
        df, composed = small_batches(df).withColumns({"_cb": nfc(F.col(before)), "_ca": nfc(F.col(after))}), ("_cb", "_ca")
    names = [c for c in df.columns if c not in composed]
    out = df.withColumn("_sb", skeleton(F.col(composed[0]))).withColumn("_sa", skeleton(F.col(composed[1])))
    out = out.withColumn("_vb", without_controls(F.col(before))).withColumn("_va", without_controls(F.col(after)))
    out = settled(out.drop(*composed)).withColumn("_same", F.col("_sb") == F.col("_sa"))
    out = settled(out.withColumn("_wb", words(F.col("_sb"))).withColumn("_wa", words(F.col("_sa"))))
    for n in STRUCTURE:
        out = out.withColumn(f"_b_{n}", structure_count(F.col("_vb"), n)).withColumn(f"_a_{n}", structure_count(F.col("_va"), n))
    differ = ~F.col("_same")
    out = out.withColumn("_ratio", F.when(F.col("_same"), F.lit(1.0)).otherwise(word_similarity(F.when(differ, F.col("_wb")), F.when(differ, F.col("_wa")))))
    added = F.when(F.col("_same"), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_except("_wa", "_wb")))
    removed = F.when(F.col("_same"), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_except("_wb", "_wa")))
    out = settled(out.withColumn("_added", added).withColumn("_removed", removed))
    structure_kept = F.lit(True)
    for n in STRUCTURE:
        structure_kept = structure_kept & (F.col(f"_b_{n}") == F.col(f"_a_{n}"))
    size = lambda c: F.length(c).cast("long")
    checks = F.array(
        check("visible_content_preserved", F.col("_same"), F.struct(size("_sb").alias("skeleton_chars_before"), size("_sa").alias("skeleton_chars_after"))),
        check(
            "no_unintended_additions",
            F.size("_added") == 0,
            F.struct(F.slice("_added", 1, MAX_EXAMPLES).alias("added_examples"), F.slice("_removed", 1, MAX_EXAMPLES).alias("removed_examples")),
        ),
        check(
            "lexical_similarity",
            F.col("_ratio") >= min_similarity,
            F.struct(F.round("_ratio", 6).alias("ratio"), F.size("_wb").alias("words_before"), F.size("_wa").alias("words_after")),
        ),
        check(
            "structure_preserved",
            structure_kept,
            F.struct(*[F.struct(F.col(f"_b_{n}").alias("before"), F.col(f"_a_{n}").alias("after")).alias(n) for n in STRUCTURE]),
        ),
        check("semantic_similarity", F.lit(None).cast("boolean")),
    ).cast(CHECKS)
    return settled(out.select(*names, F.when(F.col(before).isNotNull() & F.col(after).isNotNull(), checks).alias("text_checks")))


def validate_pairs(pairs: DataFrame, key: str, before: str, after: str, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """The checks of pairs of texts from any origin: ``key, checks, all_passed``."""
    checked = with_text_checks(pairs.select(key, before, after), before, after, min_similarity)
    return checked.select(key, F.col("text_checks").alias("checks"), all_passed(F.col("text_checks")).alias("all_passed"))
