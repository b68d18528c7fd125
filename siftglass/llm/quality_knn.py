"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A text's terms are of two kinds, each hashed to a fixed number of columns: runs of four characters with letters
and digits reduced to their kind (small, capital, digit), which tell its form, and runs of four bytes as they
are but for the case of A-Z, which tell its words.  Damped counts, weighted by rarity, of a bounded sample of
labelled texts are decomposed into singular vectors; the labelled texts' coordinates are broadcast.  Every document is projected, compared with all labelled texts in blocks of exact cosine products,
and the labels of the nearest vote with weights that grow with similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftglass.llm.common import arrow_map, id_and_text, id_field
from siftglass.llm.packed import squeeze, unsqueeze

#: Labelled texts that the space is made from, at most.  They and their coordinates are what is broadcast.
LABELLED_ROWS = 4000
#: Columns of each kind of term, and the weight of words beside form.
COLUMNS = 2048
WORDS_WEIGHT = 0.5
DIMENSIONS = 64
#: Rounds of the subspace iteration that finds the singular vectors, vectors beyond those wanted, and its seed.
ROUNDS, SPARE, SEED = 3, 32, 3
NEIGHBOURS = 25
#: Weight of a vote: the cosine (0 if negative) to this power.
SHARPNESS = 8
THRESHOLD = 0.3
#: One row in so many, by CRC-32 of the id, is held out from learning.
FOLDS = 5


def _kinds() -> np.ndarray:
    """A kind below 32 for each byte."""
    out = np.ones(256, np.uint32)
    for b in range(128):
        c = chr(b)
        if c.isupper():
            out[b] = 2
        elif c.isdigit():
            out[b] = 3
        elif c == " ":
            out[b] = 4
        elif c.isspace():
            out[b] = 5
        elif not c.isalpha():
            out[b] = 6 + b % 26
    return out


_KINDS = _kinds()
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[ord("A") : ord("Z") + 1] += 32


def terms(text: bytes | None) -> np.ndarray:
    """How often each hashed term occurs in a text: COLUMNS for form, COLUMNS for words."""
    octets = np.frombuffer(text or b"", np.uint8)
    out = np.zeros(2 * COLUMNS, np.float32)
    if len(octets) >= 4:
        for k, (values, bits) in enumerate(((_KINDS[octets], 5), (_LOWER[octets], 8))):
            four = values[:-3] | (values[1:-2] << bits) | (values[2:-1] << 2 * bits) | (values[3:] << 3 * bits)
            out[k * COLUMNS : (k + 1) * COLUMNS] = np.bincount((four * np.uint32(2654435761)) >> np.uint32(21), minlength=COLUMNS)
    return out


def held_out(id_column: Column) -> Column:
    """Whether a row is held out from learning."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


@dataclass(frozen=True)
class Space:
    """Rarity of each term, the singular vectors, the labelled coordinates and their labels."""

    rarity: np.ndarray
    vectors: np.ndarray
    points: np.ndarray
    labels: np.ndarray

    def project(self, counts: np.ndarray) -> np.ndarray:
        """Coordinates of length one (zero for a text without terms)."""
        return _unit(_weighted(counts, self.rarity) @ self.vectors)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """The weighted share of label 1 among the nearest labelled texts."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        cosine = self.project(counts) @ self.points.T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** SHARPNESS
        total = weight.sum(axis=1)
        share = (weight * self.labels[near]).sum(axis=1) / np.where(total > 0, total, 1)
        return np.clip(np.where(total > 1e-9, share, self.labels.mean()), 0.0, 1.0)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def _weighted(counts: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Damped counts by rarity, form and words each of length one before they are weighted."""
    out = np.log1p(counts) * rarity
    out[:, :COLUMNS] = _unit(out[:, :COLUMNS])
    out[:, COLUMNS:] = _unit(out[:, COLUMNS:]) * np.float32(WORDS_WEIGHT)
    return out


def _singular_vectors(rows: np.ndarray) -> np.ndarray:
    """The strongest right singular vectors, the strongest first, by subspace iteration."""
    wanted = min(DIMENSIONS, *rows.shape)
    start = np.random.Generator(np.random.PCG64(SEED)).standard_normal((rows.shape[1], min(wanted + SPARE, rows.shape[1])))
    basis = rows.T @ (rows @ start.astype(np.float32))
    for _ in range(ROUNDS):
        basis = rows.T @ (rows @ np.linalg.qr(basis)[0])
    basis = np.linalg.qr(basis)[0]
    turned = np.linalg.svd(rows @ basis, full_matrices=False)[2]
    return np.ascontiguousarray((basis @ turned.T)[:, :wanted]).astype(np.float32)


def space(counts: np.ndarray, labels: np.ndarray) -> Space:
    """The latent-semantic space of labelled texts."""
    if not len(labels):
        none = np.zeros((0, DIMENSIONS), np.float32)
        return Space(np.ones(2 * COLUMNS, np.float32), np.zeros((2 * COLUMNS, DIMENSIONS), np.float32), none, np.zeros(0))
    rarity = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    weighted = _weighted(counts, rarity)
    vectors = _singular_vectors(weighted)
    return Space(rarity, vectors, _unit(weighted @ vectors), labels.astype(np.float64))


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = LABELLED_ROWS) -> Space:
    """The space of at most ``rows`` labelled texts that aren't held out: those with the smallest id digests.

    Labels other than 0 and 1, null ids and ids without a document don't count; a document labelled twice counts
    twice, and null or empty texts count as texts without terms.  Without labelled texts the space is empty.
    """
    chosen = (
        labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
        .orderBy(F.xxhash64("id"), "id", "label")
        .limit(rows)
    )
    texts = id_and_text(documents, id_col, text_col, binary=True).join(F.broadcast(chosen), "id").select("id", "label", "text")
    schema = T.StructType([T.StructField("id", id_field(documents, id_col)), T.StructField("label", T.IntegerType()), T.StructField("counts", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [squeeze(np.minimum(terms(t.as_py()), 65535).astype(np.uint16)) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.binary())], names=schema.names)

    found = sorted(arrow_map(texts, run, schema).collect())
    counts = np.stack([np.frombuffer(unsqueeze(r["counts"]), np.uint16) for r in found]).astype(np.float32) if found else np.zeros((0, 2 * COLUMNS), np.float32)
    return space(counts, np.array([r["label"] for r in found], np.int64))


def classify(documents: DataFrame, model: Space, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``id_col, held_out, score, predicted``.

    Null, empty and very short texts (under four bytes) have no terms; they get the share of label 1 among
    the labelled texts.  Without labelled texts every score is 0.5.  A null id counts as not held out.
    Repeated rows stay as they are; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    held = spark.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("id", id_field(documents, id_col)), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            counts = np.stack([terms(t.as_py()) for t in texts]) if len(texts) else np.zeros((0, 2 * COLUMNS), np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.scores(counts), pa.float64())], names=["id", "score"])

    scored = arrow_map(id_and_text(documents, id_col, text_col, binary=True), run, schema)
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
