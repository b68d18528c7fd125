"""Deterministic injection of hidden signals into plain tables, in Spark and in DuckDB.

The driver's texts carry almost no signal, so queries over them would compare nothing with nothing.  Each
document gets the injection that belongs to the remainder of its id by sixteen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of each injection: an integer pair (start, length) copies from the text, -1 to its end; a string is put in.
RECIPES: dict[int, list[tuple[int, int] | str]] = {
    0: [(1, 7), "\u200b", (8, 30), "\n\u200b", (38, -1)],
    1: ["\ufeff", (1, -1)],
    2: ["\ufeff", (1, 10), "\ufeff", (11, -1)],
    3: [(1, 5), "\u202e", (6, -1)],
    4: [(1, 5), "\u00a0", (6, 5), "\u3000", (11, -1)],
    5: [(1, -1), "\U000e0048\U000e0049"],
    6: [(1, 4), "\u00ad", (5, -1)],
    7: [(1, 4), "\x07", (5, -1)],
    8: [(1, 20), "\r\n", (21, 20), "\n", (41, -1)],
    9: [(1, 10), "\r", (11, -1)],
    10: [(1, -1), "\ufe0f"],
    11: ["p\u0430ypal \u00b5m ", (1, -1), " <!-- note -->"],
    12: [(1, -1), " cafe\u0301"],
    13: [(1, -1), "  \n\n\n\n\n\nend"],
    14: [(1, -1), "\n1."],
    15: [(1, -1)],
}


def salted(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with their texts salted by their key; null texts and keys stay as they are."""
    body = F.col(text)

    def built(parts: list[tuple[int, int] | str]) -> Column:
        columns = [F.lit(p) if isinstance(p, str) else F.substring(body, p[0], p[1] if p[1] > 0 else 2**31 - 1) for p in parts]
        return F.concat(*columns)

    rest = F.pmod(F.col(key), F.lit(16))
    out: Column | None = None
    for r, parts in RECIPES.items():
        out = F.when(rest == r, built(parts)) if out is None else out.when(rest == r, built(parts))
    assert out is not None
    return documents.withColumn(text, out.otherwise(body))


def sql_text(s: str) -> str:
    """A DuckDB expression for a string, odd characters by their numbers."""
    parts: list[str] = []
    plain = ""
    for c in s:
        if c.isascii() and c.isprintable():
            plain += c.replace("'", "''")
        else:
            if plain:
                parts.append(f"'{plain}'")
                plain = ""
            parts.append(f"chr({ord(c)})")
    if plain:
        parts.append(f"'{plain}'")
    return " || ".join(parts) or "''"


def salted_sql() -> str:
    """The same as a DuckDB query over ``documents``."""
    cases = []
    for r, parts in RECIPES.items():
        made = [f"({sql_text(p)})" if isinstance(p, str) else f"substring(text, {p[0]}, {p[1] if p[1] > 0 else 1 << 30})" for p in parts]
        cases.append(f"WHEN {r} THEN {' || '.join(made)}")
    return f"SELECT doc_id, lang, source, CASE (doc_id % 16 + 16) % 16 {' '.join(cases)} ELSE text END AS text FROM documents"


def dealt_out(df: DataFrame) -> DataFrame:
    """A table as the reader splits it; one of fewer splits than cores, which one row group can't avoid, is dealt out."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
