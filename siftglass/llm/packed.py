"""Documents packed into batches of several megabytes, written once to the shared folder.

A batch has a number of its own and never changes, so what later stages say about places in it holds even
if tasks are run again elsewhere.  Texts are kept compressed; a batch ends once it has ``BATCH_BYTES``, so its
size doesn't follow the input's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siftglass.llm.common import arrow_map, id_and_text, id_field, written

BATCH_BYTES = 5 << 20
#: Level of the compressor; higher ones take more time than they save disk.
LEVEL = 1


def squeeze(data: bytes | memoryview | np.ndarray) -> bytes:
    """``data`` compressed, its length first."""
    raw = data.tobytes() if isinstance(data, np.ndarray) else bytes(data)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", LEVEL).compress(raw, asbytes=True)


def unsqueeze(data: bytes) -> bytes:
    """What ``squeeze`` was given."""
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def pack(documents: DataFrame, id_col: str, text_col: str, words_only: bool = False, by_id: bool = False) -> DataFrame:
    """``batch, ids, size, ends, texts``, written to the shared folder.

    ``texts`` holds the UTF-8 bytes of a batch's texts one after another, ``ends`` where each ends (int64),
    both compressed; ``size`` is the number of bytes, or of words with ``words_only``.  ``words_only`` keeps of
    each text its words, each followed by one blank.  ``by_id`` puts the documents of a batch in the order of
    their (integer) ids, nulls last.  A null text is empty.
    """
    kind = id_field(documents, id_col)
    schema = T.StructType(
        [
            T.StructField("batch", T.LongType()),
            T.StructField("ids", T.ArrayType(kind)),
            T.StructField("size", T.LongType()),
            T.StructField("ends", T.BinaryType()),
            T.StructField("texts", T.BinaryType()),
        ]
    )
    most = BATCH_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        ids: list[object] = []
        texts: list[bytes] = []
        held = 0

        def one() -> pa.RecordBatch:
            order = range(len(ids))
            if by_id:
                order = sorted(order, key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))
            some = [texts[i] for i in order]
            ends = np.cumsum([len(t) for t in some], dtype=np.int64)
            size = sum(t.count(b" ") for t in some) if words_only else int(ends[-1])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([at], pa.int64()),
                    pa.array([[ids[i] for i in order]], pa.list_(kind_of)),
                    pa.array([size], pa.int64()),
                    pa.array([squeeze(ends)], pa.binary()),
                    pa.array([squeeze(b"".join(some))], pa.binary()),
                ],
                names=[f.name for f in schema],
            )

        for batch in batches:
            kind_of = batch.column(0).type
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = t.as_py() or b""
                if words_only:
                    words = text.split()
                    text = b" ".join(words) + b" " if words else b""
                ids.append(i)
                texts.append(text)
                held += len(text) + 64
                if held >= most:
                    yield one()
                    at += 1
                    ids, texts, held = [], [], 0
        if ids:
            yield one()

    return written(arrow_map(id_and_text(documents, id_col, text_col, binary=True), run, schema), "packed")
