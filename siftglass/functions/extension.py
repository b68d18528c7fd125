"""Functions and table functions for SQL: what leaves the JVM here, under names of a session.

``register(spark)`` makes them callable from ``spark.sql``; table functions go behind ``LATERAL``.  A null argument
gives null, or no rows; data that isn't what a function reads gives null or the rows before the fault.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftglass.functions import images, office, pdfs
from siftglass.functions.normalize import composed_form, normal_form
from siftglass.functions.visible import word_similarity

#: What all registered names begin with.
PREFIX = "siftglass_"


@F.arrow_udf(T.StringType())
def pixel_digest(files: pa.Array) -> pa.Array:
    """A digest of what an image shows, whatever its metadata."""
    return pa.array([None if f is None else images.pixel_digest(f) for f in files.to_pylist()], pa.string())


@F.arrow_udf(T.MapType(T.StringType(), T.StringType()))
def pdf_fields(files: pa.Array) -> pa.Array:
    """The information dictionary of a PDF."""
    return pa.array([None if f is None else pdfs.info_fields(f) for f in files.to_pylist()], pa.map_(pa.string(), pa.string()))


@F.udtf(returnType="ordinal int, kind string, size bigint", useArrow=True)
class PngChunks:
    """The chunks of a PNG file in order, and the bytes of their payloads; one counts if its payload is whole."""

    def eval(self, data: bytes | None) -> Iterator[tuple[int, str, int]]:
        if data is not None and data.startswith(images.PNG_MAGIC):
            for k, c in enumerate(images.png_chunks(data, with_checksum=False)):
                yield k, c.kind, c.body_end - c.body


@F.udtf(returnType="ordinal int, marker int, size bigint", useArrow=True)
class JpegSegments:
    """The segments of a JPEG file before its scan in order, and the bytes of their payloads."""

    def eval(self, data: bytes | None) -> Iterator[tuple[int, int, int]]:
        if data is not None and data.startswith(images.JPEG_MAGIC):
            for k, s in enumerate(images.jpeg_segments(data, skip_bare_markers=True)):
                if s.marker != images.SCAN:
                    yield k, s.marker, s.end - s.body


@F.udtf(returnType="part string, size bigint, sha256 string", useArrow=True)
class OfficeParts:
    """The content parts of an Office file, without its properties and its list of content types."""

    def eval(self, data: bytes | None) -> Iterator[tuple[str, int, str]]:
        for part, body in ((office.content_parts(data) if data is not None else None) or {}).items():
            yield part, len(body), hashlib.sha256(body).hexdigest()


FUNCTIONS = {
    "nfc": composed_form,
    "normal_form": normal_form,
    "word_similarity": word_similarity,
    "pixel_digest": pixel_digest,
    "pdf_fields": pdf_fields,
}
TABLE_FUNCTIONS = {"png_chunks": PngChunks, "jpeg_segments": JpegSegments, "office_parts": OfficeParts}


def register(spark: SparkSession, prefix: str = PREFIX) -> list[str]:
    """Make all functions known to a session; their names."""
    for name, function in FUNCTIONS.items():
        spark.udf.register(prefix + name, function)
    for name, table in TABLE_FUNCTIONS.items():
        spark.udtf.register(prefix + name, table)
    return [prefix + n for n in (*FUNCTIONS, *TABLE_FUNCTIONS)]


def listed(files: DataFrame, name: str, data: str = "data") -> DataFrame:
    """``files`` without its data, with the rows of a table function for each file."""
    rows = files.lateralJoin(TABLE_FUNCTIONS[name](F.col(data).outer()))
    return rows.drop(data)
