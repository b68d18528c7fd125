"""Benchmark decontamination by Wu-Manber multi-pattern search.

Every benchmark item gives windows of ``window`` consecutive words (an item with fewer words is one
window).  A text is normalised to its words, each surrounded by single blanks, so that a window is a
plain byte string in it.  The search looks at one block of bytes at a time: the shift table says how
far no window can end, a block with shift zero selects the windows whose prefix ends in that block,
and a direct comparison confirms each occurrence.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftglass.llm.common import arrow_map, id_and_text, id_field, written

WINDOW = 13
#: Bytes of a block.  Larger blocks are rarer, so shifts are longer.
BLOCK = 8
#: Windows shorter than this many bytes get a table of their own, so that they don't shorten all shifts.
SHORT = 24
#: Bytes of items that one pass searches for; larger benchmarks take several passes.  Patterns, their owners and the
#: shift table come to about 180 bytes for each of these in every worker.
PASS_BYTES = 2 << 20
#: A text is contaminated if at least one word of this many is hit.
RATIO = 20

_KEEP = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TO_BLANK = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in set(_KEEP) else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a text: A-Z lower-cased, runs of ASCII letters, digits and non-ASCII bytes."""
    return text.translate(_TO_BLANK).split() if text else []


class WuManber:
    """Occurrences of byte patterns, all of at least ``least`` bytes."""

    def __init__(self, patterns: list[bytes]) -> None:
        self.least = min(map(len, patterns))
        self.block = min(BLOCK, self.least)
        self.default = self.least - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, list[int]] = defaultdict(list)
        self.patterns = patterns
        m, b = self.least, self.block
        for k, pattern in enumerate(patterns):
            for end in range(b, m + 1):
                block = pattern[end - b : end]
                if m - end < self.shift.get(block, self.default):
                    self.shift[block] = m - end
            self.bucket[pattern[m - b : m]].append(k)

    def search(self, text: bytes) -> Iterator[tuple[int, int]]:
        """Pairs (start, pattern number) of every occurrence, overlapping ones too."""
        m, b, default, shift, bucket, patterns = self.least, self.block, self.default, self.shift.get, self.bucket, self.patterns
        end, stop = m, len(text)
        while end <= stop:
            block = text[end - b : end]
            step = shift(block, default)
            if step:
                end += step
                continue
            start = end - m
            for k in bucket[block]:
                if text.startswith(patterns[k], start):
                    yield start, k
            end += 1


class Searcher:
    """The windows of some benchmark items, ready for search."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = WINDOW) -> None:
        self.window = window
        owners: dict[bytes, set[str | None]] = defaultdict(set)
        lengths: dict[bytes, int] = {}
        for item, text in items:
            words = words_of(text)
            for i in range(max(1, len(words) - window + 1) if words else 0):
                part = words[i : i + window]
                pattern = b" " + b" ".join(part) + b" "
                owners[pattern].add(item)
                lengths[pattern] = len(part)
        self.owners, self.lengths = owners, lengths
        groups = [[p for p in sorted(owners) if (len(p) < SHORT) == short] for short in (False, True)]
        self.tables = [WuManber(g) for g in groups if g]

    def scan(self, text: bytes | None) -> tuple[int, np.ndarray, set[str | None]]:
        """Number of words, which of them are hit, and the items that occur."""
        return self.scan_words(words_of(text))[:3]

    def scan_words(self, words: list[bytes]) -> tuple[int, np.ndarray, set[str | None], bool]:
        """The same of a text's words, and whether a window of full size occurs."""
        if not words:
            return 0, np.zeros(0, bool), set(), False
        plain = b" " + b" ".join(words) + b" "
        found: set[str | None] = set()
        spans: list[tuple[int, int]] = []
        for t in self.tables:
            for start, k in t.search(plain):
                pattern = t.patterns[k]
                found |= self.owners[pattern]
                spans.append((start, self.lengths[pattern]))
        hit = np.zeros(len(words), bool)
        if spans:
            blanks = np.flatnonzero(np.frombuffer(plain, np.uint8) == 0x20)
            for start, n in set(spans):
                first = int(np.searchsorted(blanks, start))
                hit[first : first + n] = True
        return len(words), hit, found, any(n == self.window for _, n in spans)


def _groups(benchmark: DataFrame, item_col: str, text_col: str, limit: int, null_items: bool) -> Iterator[list[tuple[str | None, bytes | None]]]:
    """The items in groups of at most ``limit`` bytes of text (one item at least), one group at a time."""
    rows = benchmark.select(
        F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text")
    ).where((F.lit(null_items) | F.col("item").isNotNull()) & F.col("text").isNotNull())
    group: list[tuple[str | None, bytes | None]] = []
    size = 0
    for row in rows.toLocalIterator():
        text = bytes(row["text"])
        if group and size + len(text) > limit:
            yield group
            group, size = [], 0
        group.append((row["item"], text))
        size += len(text)
    if group:
        yield group


_SPANS = T.ArrayType(T.ArrayType(T.LongType()))
_HITS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", _SPANS),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("whole", T.BooleanType()),
]
_HIT_KINDS = (pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string()), pa.bool_())


def _searched(texts: DataFrame, group: Broadcast, window: int, key: T.DataType) -> DataFrame:
    """``id, n_words, hit_spans, items, whole`` of rows ``(id, text)``, searched for one group of items."""
    schema = T.StructType([T.StructField("id", key), *_HITS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(group.value, window)
        for batch in batches:
            found: list[tuple[int, list[list[int]], list[str], bool]] = []
            for text in batch.column(1):
                n, hit, items, whole = searcher.scan_words(words_of(text.as_py()))
                found.append((n, _runs(hit) if hit.any() else [], sorted(items - {None}), whole))
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(_HIT_KINDS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return arrow_map(texts, run, schema)


def _united(hits: DataFrame) -> DataFrame:
    """Hits of several passes over the same rows as one row each: spans and items united."""
    schema = T.StructType([T.StructField("uid", T.LongType()), *_HITS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, list[list[int]], list[str], bool]] = []
            for n, parts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                hit = np.zeros(n, bool)
                for part in parts:
                    for first, last in part["hit_spans"]:
                        hit[first:last] = True
                found.append((n, _runs(hit), sorted({i for part in parts for i in part["items"]}), any(part["whole"] for part in parts)))
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(_HIT_KINDS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    gathered = hits.groupBy("uid").agg(F.first("n_words").alias("n_words"), F.collect_list(F.struct("hit_spans", "items", "whole")).alias("parts"))
    return arrow_map(gathered, run, schema)


def _in_passes(source: DataFrame, groups: Iterator[list[tuple[str | None, bytes | None]]], window: int) -> DataFrame:
    """The same columns as ``_searched`` for any number of groups: one pass over all rows for each.

    Rows get numbers in a written table, so passes agree on them; a pass writes only the rows it hits.  A group is
    on the driver and in the workers during its own pass alone.
    """
    spark = source.sparkSession
    rows = written(source.withColumn("uid", F.monotonically_increasing_id()), "numbered")
    hits: DataFrame | None = None
    for group in groups:
        held = spark.sparkContext.broadcast(group)
        found = _searched(rows.select(F.col("uid").alias("id"), "text"), held, window, T.LongType())
        found = written(found.where(F.size("hit_spans") > 0).withColumnRenamed("id", "uid"), "hits")
        held.destroy()
        hits = found if hits is None else hits.unionByName(found)
    assert hits is not None
    plain = _searched(rows.select(F.struct("uid", "id").alias("id"), "text"), spark.sparkContext.broadcast([]), window, T.StructType([rows.schema["uid"], rows.schema["id"]]))
    plain = plain.select("id.uid", "id.id", "n_words")
    joined = plain.join(written(_united(hits), "hits").drop("n_words"), "uid", "left")
    none = F.array()
    return joined.select("id", "n_words", F.coalesce("hit_spans", none.cast(_SPANS)).alias("hit_spans"), F.coalesce("items", none.cast("array<string>")).alias("items"), F.coalesce("whole", F.lit(False)).alias("whole"))


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    pass_bytes: int = PASS_BYTES,
    null_items: bool = False,
) -> DataFrame:
    """One row per document: ``id_col, n_words, n_hit, hit_spans, items, contaminated, whole``.

    ``hit_spans`` are the maximal runs of hit words as (first, last + 1); ``items`` are the ids of the
    items with occurring windows, sorted as strings; ``whole`` says whether one of these windows has all
    ``window`` words.  A benchmark of up to ``pass_bytes`` is searched in one pass without a shuffle.  A larger
    one is searched group by group, each in a pass of its own over all documents: only one group is ever on
    the driver or in a worker, so memory doesn't follow the benchmark's size.

    Null and empty texts have no words, hit nothing and aren't contaminated.  Repeated documents give
    repeated rows; a null document id stays null.  Items with a null id or text, or without a word, have
    no window; an item given twice counts once.  An empty benchmark hits nothing.  With ``null_items``, items
    with a null id are searched too: their windows hit and contaminate, only ``items`` can't name them.
    """
    source = id_and_text(documents, id_col, text_col, binary=True)
    groups = _groups(benchmark, item_col, item_text_col, pass_bytes, null_items)
    some = list(islice(groups, 2))
    if len(some) < 2:
        held = documents.sparkSession.sparkContext.broadcast(some[0] if some else [])
        found = _searched(source, held, window, id_field(documents, id_col))
    else:
        found = _in_passes(source, chain(iter(some), groups), window)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    found = found.withColumn("n_hit", n_hit)
    contaminated = (F.col("n_hit") > 0) & (F.lit(RATIO) * F.col("n_hit") >= F.col("n_words"))
    return found.select(F.col("id").alias(id_col), "n_words", "n_hit", "hit_spans", "items", contaminated.alias("contaminated"), "whole")


def _runs(hit: np.ndarray) -> list[list[int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edges.reshape(-1, 2).tolist()


def drop_contaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """The rows of ``documents`` without benchmark passages, with their own columns.

    A row goes if a window of full size occurs in it, however long its text is, so no such window is left in
    what stays; or if it is contaminated by the share of hit words, which is how items shorter than a window
    count: a word or two say nothing in a long text.  Items with a null id count too.  Null and empty texts
    stay, repeated rows stay or go together, columns may have any names, and an empty table or an empty
    benchmark changes nothing.
    """
    inner = [f"c{i}" for i in range(len(documents.columns))]
    plain = documents.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(documents.columns, inner, strict=True)])
    row = F.struct(*[F.col(n) for n in inner]).alias("row")
    held = plain.select(row, F.col(inner[documents.columns.index(text_col)]).alias("text"))
    out = decontaminate(held, benchmark, "row", "text", item_col, item_text_col, window, pass_bytes, null_items=True)
    return out.where(~F.col("contaminated") & ~F.col("whole")).select(*[F.col(f"row.{n}").alias(c) for c, n in zip(documents.columns, inner, strict=True)])
