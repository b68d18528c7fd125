"""Unicode normalisation, which Spark lacks: Arrow functions that see only the texts that need them."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftglass.functions.charsets import COMPOSED


@F.arrow_udf(T.StringType())
def composed_form(texts: pa.Array) -> pa.Array:
    """Texts in normal form C."""
    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def normal_form(texts: pa.Array) -> pa.Array:
    """Null for a text in normal form C; else the first of NFD, NFKC, NFKD that holds, or ``none``."""
    def form(text: str | None) -> str | None:
        held = [f for f in ("NFC", "NFD", "NFKC", "NFKD") if text is None or unicodedata.is_normalized(f, text)]
        return None if "NFC" in held else (held or ["none"])[0]

    return pa.array([form(t) for t in texts.to_pylist()], pa.string())


def _odd(text: Column) -> Column:
    """The text if it may not be composed, else null: a conditional around a Python function guards nothing."""
    return F.when(~text.rlike(COMPOSED), text)


def nfc(text: Column) -> Column:
    """The text in normal form C."""
    return F.coalesce(composed_form(_odd(text)), text)


def other_form(text: Column) -> Column:
    """Null if the text is in normal form C; else the first of NFD, NFKC, NFKD that holds, or ``none``."""
    return normal_form(_odd(text))
