"""What a reader sees of a text: its skeleton, words and Markdown structure."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftglass.functions.charsets import MAYBE_CONTROL, format_and_control_class
from siftglass.functions.sequences import compare, ratio

# Markdown structure, counted line by line.
STRUCTURE = {
    "headings": "^\\s{0,3}#{1,6}\\s",
    "code_fences": "^\\s*(```|~~~)",
    "list_items": "^\\s*([-*+]|\\d+\\.)\\s",
}


def without_controls(text: Column) -> Column:
    """A text without format and control characters; line feeds and tabs stay."""
    return F.regexp_replace(text, f"(?={MAYBE_CONTROL}){format_and_control_class()}", "")


def skeleton(composed: Column) -> Column:
    """The visible content of a text in normal form C: no controls, white space collapsed."""
    return F.regexp_replace(F.regexp_replace(without_controls(composed), "(?U)\\s+", " "), "^ | $", "")


def words(skeleton_column: Column) -> Column:
    """The words of a skeleton."""
    return F.array_remove(F.split(skeleton_column, " "), "")


def structure_count(view: Column, name: str) -> Column:
    """How often a Markdown structure occurs in a text without controls."""
    return F.regexp_count(view, F.lit("(?dmU)" + STRUCTURE[name])).cast("long")


@F.arrow_udf(T.DoubleType())
def word_similarity(before: pa.Array, after: pa.Array) -> pa.Array:
    """The similarity ratio of two lists of words; null where either is null."""
    each = ((a.as_py(), b.as_py()) for a, b in zip(before, after, strict=True))
    return pa.array([None if a is None or b is None else ratio(a, b) for a, b in each], pa.float64())


_PAIR = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])


@F.arrow_udf(T.ArrayType(T.LongType()))
def _edits(pairs: pa.Array) -> pa.Array:
    """The edits of each pair of an array; null for null pairs."""
    each = (some.as_py() for some in pairs)
    return pa.array([None if some is None else [None if p is None else compare(p["a"], p["b"])[1] for p in some] for some in each], pa.list_(pa.int64()))


def _compared(before: Column, after: Column) -> Column:
    """Whether a pair has to be compared item by item: changed, and by more than a last line feed."""
    return (before != after) & (after != F.concat(before, F.lit("\n")))


def edit_counts(pairs: list[tuple[Column, Column]]) -> Column:
    """An array with the edits of each pair that has to be compared, made by one Python function for all pairs."""
    asked = F.array(*[F.when(_compared(a, b), F.struct(a.alias("a"), b.alias("b"))) for a, b in pairs]).cast(T.ArrayType(_PAIR))
    return _edits(F.when(F.size(F.array_compact(asked)) > 0, asked))


def change_count(before: Column, after: Column, edits: Column) -> Column:
    """Characters that a change affects: its edits, at every length of text."""
    return (
        F.when(before == after, F.lit(0).cast("long"))
        .when(after == F.concat(before, F.lit("\n")), F.lit(1).cast("long"))
        .otherwise(edits)
    )
