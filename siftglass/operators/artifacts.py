"""Artifacts: one row for each thing to inspect, classified by Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftglass.functions.barrier import small_batches

#: Bytes of the beginning in which a NUL makes data binary.
SNIFF = 8192
MAX_BYTES = 32 << 20

# Languages and media types by file suffix.
LANGUAGES = {
    ".kt": "kotlin",
    ".kts": "kotlin",
    ".java": "java",
    ".swift": "swift",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".py": "python",
    ".pyi": "python",
}
MEDIA_TYPES = {
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".svg": "image/svg+xml",
    ".webp": "image/webp",
    ".gif": "image/gif",
    ".pdf": "application/pdf",
    ".md": "text/markdown",
    ".txt": "text/plain",
    ".json": "application/json",
    ".html": "text/html",
    ".xml": "text/xml",
}

PNG = b"\x89PNG\r\n\x1a\n"
JPEG = b"\xff\xd8"
COLUMNS = ["artifact_id", "path", "data", "text", "kind", "language", "media_type", "sha256", "size_bytes", "encoding", "decoded"]


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def suffix(path: Column) -> Column:
    """The last suffix of a path's name in lower case, with its dot; empty if it has none.

    A name's leading dot and a dot at its end begin no suffix.
    """
    name = F.regexp_extract(path, "([^/]*)/*$", 1)
    return F.lower(F.regexp_extract(name, "^.+(\\.[^.]+)$", 1))


def decoded_text(data: Column) -> Column:
    """The text of UTF-8 data, its byte order mark included; null for anything else."""
    return F.when(F.locate("\0", F.decode(F.substring(data, 1, SNIFF), "ISO-8859-1")) == 0, F.try_validate_utf8(data.cast("string")))


def _classified(df: DataFrame) -> DataFrame:
    """Adds what follows from data, text and path."""
    tail = suffix(F.coalesce("path", F.lit("")))
    language = F.when(F.col("text").isNotNull(), _lookup(LANGUAGES, tail))
    bom = F.startswith("text", F.lit("\ufeff"))
    return small_batches(df).select(
        "artifact_id",
        "path",
        "data",
        "text",
        F.when(F.col("text").isNull(), "binary").when(language.isNotNull(), "source_code").otherwise("text").alias("kind"),
        language.alias("language"),
        _lookup(MEDIA_TYPES, tail).alias("media_type"),
        F.sha2("data", 256).alias("sha256"),
        F.octet_length("data").cast("long").alias("size_bytes"),
        F.when(F.col("text").isNotNull(), F.when(bom, "utf-8-sig").otherwise("utf-8")).alias("encoding"),
        F.col("text").isNotNull().alias("decoded"),
    )


def artifacts_from_binary(df: DataFrame, key: str, data: str, path: str | None = None) -> DataFrame:
    """Artifacts from a column of bytes.  Rows without data are left out: there is nothing to inspect."""
    name = F.col(f"`{path}`") if path else F.lit(None).cast("string")
    base = df.select(F.col(f"`{key}`").alias("artifact_id"), name.alias("path"), F.col(f"`{data}`").alias("data")).where("data IS NOT NULL")
    return _classified(base.withColumn("text", decoded_text(F.col("data"))))


def artifacts_from_text(df: DataFrame, key: str, text: Column | str, path: Column | None = None) -> DataFrame:
    """Artifacts from a column of texts: valid UTF-8 by itself, so only a NUL at the beginning makes one binary."""
    body = F.col(f"`{text}`") if isinstance(text, str) else text
    name = path if path is not None else F.lit(None).cast("string")
    base = df.select(F.col(f"`{key}`").alias("artifact_id"), name.alias("path"), body.alias("body")).where("body IS NOT NULL")
    data = F.col("body").cast("binary")
    plain = F.when(F.locate("\0", F.decode(F.substring(data, 1, SNIFF), "ISO-8859-1")) == 0, F.col("body"))
    return _classified(base.select("artifact_id", "path", data.alias("data"), plain.alias("text")))


def is_png(data: Column) -> Column:
    """PNG by signature."""
    return F.startswith(data, F.lit(PNG))


def is_jpeg(data: Column) -> Column:
    """JPEG by signature."""
    return F.startswith(data, F.lit(JPEG))


def is_pdf(data: Column) -> Column:
    """PDF by signature."""
    return F.startswith(data, F.lit(b"%PDF-"))


def is_zip(data: Column) -> Column:
    """A ZIP archive by signature: what may be an Office document."""
    return F.startswith(data, F.lit(b"PK\x03\x04"))


def is_encrypted_pdf(data: Column) -> Column:
    """A PDF whose trailer refers to an encryption dictionary."""
    return F.decode(data, "ISO-8859-1").rlike("/Encrypt[ \\t\\n\\r\\f\\x0B]+[0-9]+[ \\t\\n\\r\\f\\x0B]+[0-9]+[ \\t\\n\\r\\f\\x0B]+R")


def guessed_media_type(data: Column) -> Column:
    """The media type that the signature shows, if any."""
    return F.when(is_png(data), "image/png").when(is_jpeg(data), "image/jpeg").when(is_pdf(data), "application/pdf")
