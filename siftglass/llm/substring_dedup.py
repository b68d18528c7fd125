"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark.

Every window's hash is a polynomial over the hashes of its words, rolled by doubling: windows of one, two,
four and eight words give that of thirteen.  A batch of documents sends its distinct hashes, with the smallest
document of each, in ranges of the hash; in each range Spark's grouped map counts them over all batches and
answers with one bit for each: whether a smaller document elsewhere has the window.  Repeated windows are
then merged to maximal intervals of words and removed.

Hashes have 64 bits: among n windows about n^2 / 2^65 pairs share one by chance (0.0006 for 150 million).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftglass.llm.common import id_field
from siftglass.llm.packed import pack, squeeze, unsqueeze

WINDOW = 13
#: Windows of one range of hashes that one task counts.
RANGE_WINDOWS = 1_500_000
#: The base of the polynomial over words, that over bytes, both odd, and the seed of the byte table.
WORD_BASE = 0x9E3779B97F4A7C15
BYTE_BASE = 0xD1342543DE82EF95
TABLE_SEED = 7
#: Bytes hashed at once.
CHUNK = 1 << 21

_BYTES = np.random.Generator(np.random.PCG64(TABLE_SEED)).integers(0, 1 << 64, 256, np.uint64)
_NO_ID = np.iinfo(np.int64).max


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit depends on all."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(text: np.ndarray) -> np.ndarray:
    """The hash of each word of bytes in which every word is followed by one blank."""
    blanks = np.flatnonzero(text == 0x20)
    if not len(blanks):
        return np.zeros(0, np.uint64)
    out = np.empty(len(blanks), np.uint64)
    done = 0
    while done < len(blanks):
        start = int(blanks[done - 1]) + 1 if done else 0
        stop = max(done + 1, int(np.searchsorted(blanks, start + CHUNK)))
        ends = blanks[done:stop] - start
        part = text[start : int(blanks[stop - 1]) + 1]
        starts = np.concatenate([[0], ends[:-1] + 1])
        lengths = ends - starts + 1
        place = np.arange(len(part)) - np.repeat(starts, lengths)
        powers = np.full(int(lengths.max()), BYTE_BASE, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        value = _BYTES[part] * powers[place]
        out[done:stop] = np.add.reduceat(value, starts)
        done = stop
    return mixed(out)


def window_hashes(words: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """The hash of each window of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power = np.uint64(WORD_BASE)
    block, width = words, 1
    out: np.ndarray | None = None
    taken, left = 0, size
    while left:
        if left & 1:
            piece = block[taken : taken + n]
            with np.errstate(over="ignore"):
                out = piece.copy() if out is None else out * power + piece
            taken += width
        left >>= 1
        if left:
            with np.errstate(over="ignore"):
                block = block[:-width] * power + block[width:]
                power = power * power
            width *= 2
    assert out is not None
    return mixed(out)


class Batch:
    """The windows of one packed batch."""

    def __init__(self, ids: list[int | None], ends: bytes, texts: bytes, size: int) -> None:
        self.ids = ids
        self.text = np.frombuffer(unsqueeze(texts), np.uint8)
        stops = np.frombuffer(unsqueeze(ends), np.int64)
        words = word_hashes(self.text)
        self.word_ends = np.searchsorted(np.flatnonzero(self.text == 0x20), stops)
        self.word_starts = np.concatenate([[0], self.word_ends[:-1]])
        hashes = window_hashes(words, size)
        counts = np.maximum(self.word_ends - self.word_starts - size + 1, 0)
        self.document = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.place = (np.arange(int(counts.sum())) + np.repeat(self.word_starts - first, counts)).astype(np.int32)
        hashes = hashes[self.place] if len(self.place) else np.zeros(0, np.uint64)
        self.order = np.argsort(hashes, kind="stable").astype(np.int32)
        inorder = hashes[self.order]
        self.new = np.ones(len(inorder), bool)
        self.new[1:] = inorder[1:] != inorder[:-1]
        self.distinct = inorder[self.new]
        self.number = np.array([_NO_ID if i is None else i for i in ids], np.int64)
        #: Documents are in the order of their ids, so the first window of a hash is in the smallest one.
        self.least = self.number[self.document[self.order[self.new]]]


def _planes(x: np.ndarray) -> bytes:
    """Integers as planes of their bytes: the high ones compress."""
    octets = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T)
    return squeeze(octets)


def _from_planes(data: bytes, kind: type) -> np.ndarray:
    octets = np.frombuffer(unsqueeze(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(octets.T).view(kind).ravel()


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def substring_dedup(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, range_windows: int = RANGE_WINDOWS
) -> DataFrame:
    """One row per document: ``id_col, n_words, n_removed, removed, kept``.

    ``removed`` are the maximal intervals of removed words as (first, last + 1), ``kept`` the remaining words
    joined by blanks.  A word goes if it lies in a window that also starts in a document with a smaller id.

    Ids must be integers.  A document with a null id counts as larger than all others, and rows with equal
    ids never remove from each other.  Null and empty texts have no words; a text with fewer words than a
    window loses nothing.  An empty table gives an empty result.  A window in a third of all documents is sent
    once by each batch, so no range is large because of it.
    """
    packed = pack(documents.withColumn(id_col, F.col(f"`{id_col}`").cast("long")), id_col, text_col, words_only=True, by_id=True)
    total = packed.agg(F.sum("size")).first()
    bits = max(0, int((total[0] or 0) // range_windows)).bit_length() if total else 0
    chunk_schema = T.StructType(
        [
            T.StructField("range", T.LongType()),
            T.StructField("batch", T.LongType()),
            T.StructField("hashes", T.BinaryType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("owners", T.BinaryType()),
        ]
    )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in rows.to_pylist():
                b = Batch(row["ids"], row["ends"], row["texts"], window)
                if not len(b.distinct):
                    continue
                out: list[list[object]] = [[], [], [], [], []]
                ranges = (b.distinct >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(b.distinct), np.int64)
                cuts = np.flatnonzero(np.diff(ranges, prepend=-1))
                for start, stop in zip(cuts, [*cuts[1:], len(ranges)], strict=True):
                    ids, owner = np.unique(b.least[start:stop], return_inverse=True)
                    kind = np.uint16 if len(ids) < 1 << 16 else np.uint32
                    values = (int(ranges[start]), row["batch"], _planes(_steps(b.distinct[start:stop])), _planes(_steps(ids)), _planes(owner.astype(kind)))
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 2 else pa.binary()) for k, c in enumerate(out)], names=chunk_schema.names)

    chunks = packed.select("batch", "ids", "ends", "texts").mapInArrow(send, chunk_schema)
    answer_schema = T.StructType(
        [T.StructField("batch", T.LongType()), T.StructField("range", T.LongType()), T.StructField("smaller", T.BinaryType())]
    )

    def count(chunk: pa.Table) -> pa.Table:
        batches, ranges = chunk.column("batch"), chunk.column("range")
        hashes, least = [], []
        for steps, id_steps, owners in zip(*[chunk.column(n) for n in ("hashes", "ids", "owners")], strict=True):
            hashes.append(np.cumsum(_from_planes(steps.as_py(), np.uint64), dtype=np.uint64))
            ids = np.cumsum(_from_planes(id_steps.as_py(), np.int64))
            kind = np.uint16 if len(ids) < 1 << 16 else np.uint32
            least.append(ids[_from_planes(owners.as_py(), kind)])
        sizes = [len(h) for h in hashes]
        every, owner = np.concatenate(hashes), np.concatenate(least)
        del hashes, least
        order = np.argsort(every, kind="stable")
        inorder = every[order]
        new = np.ones(len(order), bool)
        new[1:] = inorder[1:] != inorder[:-1]
        del every, inorder
        firsts = np.flatnonzero(new)
        owner = owner[order]
        smallest = np.repeat(np.minimum.reduceat(owner, firsts), np.diff(np.append(firsts, len(order))))
        smaller = np.empty(len(order), bool)
        smaller[order] = smallest < owner
        stops = np.cumsum(sizes)
        parts = [squeeze(np.packbits(smaller[e - n : e])) for n, e in zip(sizes, stops, strict=True)]
        return pa.table([batches, ranges, pa.array(parts, pa.binary())], names=answer_schema.names)

    answers = chunks.groupBy("range").applyInArrow(count, answer_schema)
    made = T.StructType(
        [
            T.StructField("id", id_field(documents, id_col)),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("removed", T.ArrayType(T.ArrayType(T.LongType()))),
            T.StructField("kept", T.StringType()),
        ]
    )
    made[0].dataType = T.LongType()

    def cut(packed: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[list[object]] = [[], [], [], [], []]
        answered = answers.select(["range", "smaller"]).to_pylist()
        answered.sort(key=lambda r: r["range"])
        for row in packed.to_pylist():
            b = Batch(row["ids"], row["ends"], row["texts"], window)
            gone = np.zeros(int(b.word_ends[-1]) + 1 if len(b.word_ends) else 1, np.int64)
            if len(b.distinct):
                ranges = (b.distinct >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(b.distinct), np.int64)
                sizes = np.bincount(np.searchsorted(np.unique(ranges), ranges))
                bitmaps = [np.unpackbits(np.frombuffer(unsqueeze(r["smaller"]), np.uint8), count=n) for r, n in zip(answered, sizes.tolist(), strict=True)]
                elsewhere = np.concatenate(bitmaps).astype(bool)
                group = np.cumsum(b.new) - 1
                owner = b.number[b.document[b.order]]
                repeated = elsewhere[group] | (owner > b.least[group])
                starts = b.place[b.order[repeated]]
                np.add.at(gone, starts, 1)
                np.subtract.at(gone, starts + window, 1)
            removed = np.cumsum(gone)[:-1] > 0
            keep = ~removed
            text = b.text
            for i, (first, last) in enumerate(zip(b.word_starts.tolist(), b.word_ends.tolist(), strict=True)):
                out[0].append(row["ids"][i])
                out[1].append(last - first)
                lost = removed[first:last]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], lost.astype(np.int8), [0]]))) if lost.any() else np.zeros(0, np.int64)
                out[2].append(int(lost.sum()))
                out[3].append(edges.reshape(-1, 2).tolist())
            stops = np.frombuffer(unsqueeze(row["ends"]), np.int64)
            ends = np.flatnonzero(text == 0x20)
            stays = np.repeat(keep, np.diff(ends, prepend=-1)) if len(text) else np.zeros(0, bool)
            start = 0
            for stop in stops.tolist():
                out[4].append(text[start:stop][stays[start:stop]].tobytes()[:-1].decode())
                start = stop
        return pa.table([pa.array(c, f) for c, f in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string()), strict=True)], names=made.names)

    texts = packed.select("batch", "ids", "ends", "texts")
    done = texts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(cut, made)
    return done.withColumnRenamed("id", id_col)
