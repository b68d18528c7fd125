"""Registered queries over containers that are made from the documents, and their DuckDB equivalents.

Spark writes the files (``recipes``), and the operators read, strip and check them.  DuckDB never sees a file: it
states from the recipe what must be found in it and which bytes must be left.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from siftglass.functions import office
from siftglass.functions.barrier import settled
from siftglass.functions.extension import listed
from siftglass.operators import artifacts as A
from siftglass.operators.file_findings import inspected_containers
from siftglass.operators.inspect import statuses
from siftglass.operators.transform import ENCRYPTED, UNSUPPORTED, pdf_checks, transform
from siftglass.plans import recipes as R
from siftglass.sources.salt import dealt_out

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str) -> Callable[[Query], Query]:
    def keep(function: Query) -> Query:
        QUERIES[name], SQL[name] = function, sql
        return function

    return keep


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt_out(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _files(spark: SparkSession, sf_dir: str, made: Callable[[Column], Column]) -> DataFrame:
    """Artifacts of the documents' files."""
    return A.artifacts_from_binary(_made(spark, sf_dir, made(F.col("text")).alias("data")), "doc_id", "data")


def _made(spark: SparkSession, sf_dir: str, *columns: Column) -> DataFrame:
    """The documents' numbers with columns made from their texts, each once: every later name would repeat its expression."""
    return settled(_documents(spark, sf_dir).select("doc_id", *columns))


def _inspected(artifacts: DataFrame) -> DataFrame:
    """``doc_id, categories`` and the findings of each container."""
    found = inspected_containers(artifacts)
    return found.select(F.col("artifact_id").alias("doc_id"), F.array_join(F.array_sort(F.transform("findings", lambda f: f["category"])), ",").alias("categories"), "findings")


def _of(category: str) -> Column:
    return F.get(F.filter("findings", lambda f: f["category"] == category), 0)


def _detail(category: str, path: str) -> Column:
    return F.get_json_object(_of(category)["details"], f"$.{path}")


def _transformed(artifacts: DataFrame) -> DataFrame:
    """``doc_id, route, accepted, rejected_reason, removed, changes, output_sha256`` and the checks by name."""
    done = transform(artifacts)
    step = F.get("operations", F.lit(0))
    removed = F.coalesce(F.get_json_object(step["details"], "$.removed"), F.get_json_object(step["details"], "$.removed_parts"))
    checks = F.array_join(F.transform("checks", lambda c: F.concat(c["name"], F.lit("="), F.coalesce(c["passed"].cast("string"), F.lit("null")))), ",")
    return done.select(
        F.col("artifact_id").alias("doc_id"), "route", "accepted", "rejected_reason", F.array_join(F.from_json(removed, "array<string>"), ",").alias("removed"), step["changes"].alias("changes"),
        checks.alias("checks"), "output_sha256", "output",
    )


def _hex(data: bytes) -> str:
    return f"unhex('{data.hex()}')"


_D = "d AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) AS n, length(doc_id::VARCHAR) AS w FROM documents)"
_PASSED = "'image_parses_after=true,pixel_data_identical=true'"

# PNG ------------------------------------------------------------------------------------------------------------

_PNG = f"""WITH {_D}, p AS (SELECT *, doc_id % 6 = 5 AS cut, doc_id % 6 <> 5 AND doc_id % 4 <> 0 AS tx, doc_id % 6 <> 5 AND doc_id % 3 = 0 AS z,
  doc_id % 6 <> 5 AND doc_id % 5 = 0 AS i, doc_id % 6 <> 5 AND doc_id % 5 = 1 AS box, doc_id % 6 <> 5 AND doc_id % 7 = 2 AS icc FROM d)"""


@_query(
    "png_findings",
    f"""{_PNG} SELECT doc_id, concat_ws(',', CASE WHEN box THEN 'c2pa_manifest' END, CASE WHEN cut THEN 'malformed_container' END, CASE WHEN tx OR z OR i OR icc THEN 'png_metadata' END) AS categories,
  CASE WHEN tx OR z OR i OR icc THEN 'PNG carries ' || (tx::INT + z::INT + i::INT + icc::INT) || ' metadata chunk(s)' END AS summary,
  CASE WHEN tx OR z OR i OR icc THEN concat_ws(',', CASE WHEN icc THEN 'iCCP' END, CASE WHEN i THEN 'iTXt' END, CASE WHEN tx THEN 'tEXt' END, CASE WHEN z THEN 'zTXt' END) END AS kinds,
  CASE WHEN tx THEN substring(t, 1, 200) END AS description, CASE WHEN i THEN 'author ' || doc_id END AS author, CASE WHEN z THEN '<compressed>' END AS comment,
  CASE WHEN box THEN 'not_performed' END AS verification FROM p""",
)
def png_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _inspected(_files(spark, sf_dir, R.png))
    kinds = F.array_join(F.from_json(_detail("png_metadata", "chunks"), "array<string>"), ",")
    return found.select(
        "doc_id", "categories", _of("png_metadata")["summary"].alias("summary"), kinds.alias("kinds"), _detail("png_metadata", "entries.Description").alias("description"),
        _detail("png_metadata", "entries.Author").alias("author"), _detail("png_metadata", "entries.Comment").alias("comment"), _detail("c2pa_manifest", "verification").alias("verification"),
    )


_PIXELS = " ".join(f"WHEN {k} THEN {_hex(R.constant_chunk(b'IDAT', R.pixel_payload(k)))}" for k in range(R.PIXELS))


@_query(
    "png_transform",
    f"""{_PNG} SELECT doc_id, 'image' AS route, true AS accepted, concat_ws(',', CASE WHEN tx THEN 'tEXt' END, CASE WHEN z THEN 'zTXt' END, CASE WHEN i THEN 'iTXt' END, CASE WHEN box THEN 'caBX' END) AS removed,
  (CASE WHEN cut THEN 2 ELSE tx::INT * (24 + n) + z::INT * (21 + w) + i::INT * (32 + w) + box::INT * 20 END)::BIGINT AS changes, {_PASSED} AS checks,
  sha256({_hex(R.PNG_HEAD)} || CASE WHEN cut THEN {_hex(b'')} ELSE {_hex(R.PNG_FIRST)} || CASE WHEN icc THEN {_hex(R.constant_chunk(b'iCCP', b'profile'))} ELSE {_hex(b'')} END
    || CASE doc_id % {R.PIXELS} {_PIXELS} END || {_hex(R.PNG_LAST)} END) AS output_sha256 FROM p""",
)
def png_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transformed(_files(spark, sf_dir, R.png)).drop("output", "rejected_reason")


_IDAT = " ".join(f"WHEN {k} THEN {len(R.pixel_payload(k))}" for k in range(R.PIXELS))


def _parts_sql(head: str, table: str, column: str, parts: list[tuple[str, str, str]]) -> str:
    """The parts of each file in order; one stands in a file if its condition holds."""
    rows = " UNION ALL ".join(f"SELECT doc_id, {k} AS place, {name} AS {column}, ({size})::BIGINT AS size FROM {table} WHERE {holds}" for k, (name, size, holds) in enumerate(parts))
    return f"{head}, c AS ({rows}) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1)::INT AS ordinal, {column}, size FROM c"


@_query(
    "png_chunk_list",
    _parts_sql(
        _PNG,
        "p",
        "kind",
        [
            ("'IHDR'", "13", "NOT cut"),
            ("'tEXt'", "12 + n", "tx"),
            ("'zTXt'", "9 + w", "z"),
            ("'iTXt'", "20 + w", "i"),
            ("'caBX'", "8", "box"),
            ("'iCCP'", "7", "icc"),
            ("'IDAT'", f"CASE doc_id % {R.PIXELS} {_IDAT} END", "NOT cut"),
            ("'IEND'", "0", "NOT cut"),
        ],
    ),
)
def png_chunk_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(_made(spark, sf_dir, R.png(F.col("text")).alias("data")), "png_chunks")


# JPEG -----------------------------------------------------------------------------------------------------------

_JPEG = f"""WITH {_D}, j AS (SELECT *, doc_id % 3 <> 1 AS ex, doc_id % 5 = 0 AS xmp, doc_id % 4 = 0 AS com, doc_id % 7 = 0 AS box, doc_id % 8 <> 3 AS scan FROM d)"""
_PLACE = "((doc_id % {most} * 3600 + doc_id % 60 * 60 + 3.6) / 3600 * 1000000 * CASE WHEN doc_id % {side} = 0 THEN 1 ELSE -1 END)"


@_query(
    "jpeg_findings",
    f"""{_JPEG} SELECT doc_id, concat_ws(',', CASE WHEN box THEN 'c2pa_manifest' END, 'jpeg_metadata', CASE WHEN ex THEN 'photo_location' END) AS categories,
  'JPEG carries ' || (1 + ex::INT + xmp::INT + com::INT + box::INT) || ' metadata segment(s)' AS summary, CASE WHEN ex THEN 'warning' END AS severity,
  CASE WHEN ex THEN lpad((doc_id % 100000)::VARCHAR, 5, '0') || ' cam' END AS make,
  CASE WHEN ex THEN round({_PLACE.format(most=90, side=2)})::BIGINT END AS latitude, CASE WHEN ex THEN round({_PLACE.format(most=180, side=3)})::BIGINT END AS longitude FROM j""",
)
def jpeg_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _inspected(_files(spark, sf_dir, R.jpeg))
    millionths = lambda name: F.round(_detail("photo_location", name).cast("double") * 1000000).cast("long").alias(name[4:])
    make = F.get_json_object(_of("photo_location")["details"], "$['camera make']")
    return found.select(
        "doc_id", "categories", _of("jpeg_metadata")["summary"].alias("summary"), _of("photo_location")["severity"].alias("severity"), make.alias("make"), millionths("gps_latitude"), millionths("gps_longitude")
    )


@_query(
    "jpeg_transform",
    f"""{_JPEG} SELECT doc_id, 'image' AS route, scan AS accepted, CASE WHEN NOT scan THEN 'image validation failed: image_parses_after; pixel_data_identical' END AS rejected_reason,
  CASE WHEN scan THEN concat_ws(',', CASE WHEN ex THEN 'APP1' END, CASE WHEN xmp THEN 'APP1' END, CASE WHEN com THEN 'APP30' END, CASE WHEN box THEN 'APP11' END) ELSE '' END AS removed,
  (scan::INT * (ex::INT * 160 + xmp::INT * (33 + w) + com::INT * 14 + box::INT * 16))::BIGINT AS changes,
  CASE WHEN scan THEN {_PASSED} ELSE 'image_parses_after=false,pixel_data_identical=false' END AS checks,
  CASE WHEN scan THEN sha256({_hex(R.JPEG_HEAD + R.JPEG_SCAN)} || encode(t) || {_hex(R.JPEG_TAIL)}) END AS output_sha256 FROM j""",
)
def jpeg_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transformed(_files(spark, sf_dir, R.jpeg)).drop("output")


@_query(
    "jpeg_segment_list",
    _parts_sql(
        f"WITH {_D}",
        "d",
        "marker",
        [
            (f"{0xE0}", "14", "true"),
            (f"{0xE1}", "156", "doc_id % 3 <> 1"),
            (f"{0xE1}", "29 + w", "doc_id % 5 = 0"),
            (f"{0xFE}", "10", "doc_id % 4 = 0"),
            (f"{0xEB}", "12", "doc_id % 7 = 0"),
        ],
    ),
)
def jpeg_segment_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(_made(spark, sf_dir, R.jpeg(F.col("text")).alias("data")), "jpeg_segments")


# PDF ------------------------------------------------------------------------------------------------------------

_PDF = f"""WITH {_D}, f AS (SELECT *, doc_id % 11 = 0 AS locked, doc_id % 4 <> 3 AS au, doc_id % 2 = 0 AS ti, doc_id % 3 = 0 AS cr, doc_id % 5 IN (0, 2) AS pk,
  doc_id % 13 = 0 AS box FROM d), g AS (SELECT *, NOT locked AND (au OR ti OR cr) AS info, NOT locked AND pk AS live FROM f)"""


@_query(
    "pdf_findings",
    f"""{_PDF} SELECT doc_id, concat_ws(',', CASE WHEN box THEN 'c2pa_manifest' END, CASE WHEN info THEN 'pdf_info_dictionary' END, CASE WHEN live THEN 'pdf_xmp_metadata' END) AS categories,
  CASE WHEN info THEN 'PDF information dictionary carries ' || (au::INT + ti::INT + cr::INT) || ' field(s)' || CASE WHEN au OR ti THEN ' including author/title information' ELSE '' END END AS summary,
  CASE WHEN info AND au THEN 'Writer (' || doc_id || ') aA' END AS author, CASE WHEN info AND ti THEN doc_id::VARCHAR END AS title, CASE WHEN info AND cr THEN 'D:2024' END AS created,
  CASE WHEN live THEN 'tool ' || doc_id END AS tool FROM g""",
)
def pdf_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = lambda name, alias: _detail("pdf_info_dictionary", name).alias(alias)
    return _inspected(_files(spark, sf_dir, R.pdf)).select(
        "doc_id", "categories", _of("pdf_info_dictionary")["summary"].alias("summary"), field("Author", "author"), field("Title", "title"), field("CreationDate", "created"),
        _detail("pdf_xmp_metadata", "creator_tool").alias("tool"),
    )


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _pdf_sql(author: str, title: str, created: str, packet: str) -> str:
    """The PDF of a row with these contents in its strings and packet."""
    return f"""({_sql_text(R.PDF_HEAD)} || lower(hex(encode(t))) || {_sql_text(R.PDF_DECOY)}
  || CASE WHEN au THEN '/Author (' || {author} || ') ' ELSE '' END || CASE WHEN ti THEN '/Title <' || {title} || '> ' ELSE '' END
  || CASE WHEN cr THEN '/CreationDate (' || {created} || ') ' ELSE '' END || {_sql_text(R.PDF_PACKET)}
  || CASE WHEN pk THEN '{R.PACKET_HEAD}' || {packet} || '{R.PACKET_TAIL}' ELSE 'no packet' END || {_sql_text(R.PDF_TAIL)}
  || CASE WHEN locked THEN '/Encrypt 7 0 R ' ELSE '' END || CASE WHEN box THEN '/AF /C2PA_Manifest ' ELSE '' END || '>>' || chr(10) || '%%EOF' || chr(10))"""


_AUTHOR = "'Writer \\(' || doc_id || '\\) a\\101'"
_PACKET = "'<xmp:CreatorTool>tool ' || doc_id || '</xmp:CreatorTool>' || repeat(' ', 20)"
_BLANK = _pdf_sql(
    f"repeat(' ', length({_AUTHOR}))", "repeat(' ', 4 + 4 * w)", "repeat(' ', 6)", f"rpad('<x:xmpmeta xmlns:x=\"adobe:ns:meta/\"/>', length({_PACKET})::INT, ' ')"
)
_PDF_PASSED = "'pdf_size_unchanged=true,pdf_header_and_eof_intact=true,pdf_changes_confined_to_metadata=true'"


@_query(
    "pdf_transform",
    f"""{_PDF} SELECT doc_id, 'pdf' AS route, NOT locked AS accepted, CASE WHEN locked THEN {_sql_text(ENCRYPTED)} END AS rejected_reason,
  CASE WHEN NOT locked THEN concat_ws(',', CASE WHEN au THEN 'info:Author' END, CASE WHEN ti THEN 'info:Title' END, CASE WHEN cr THEN 'info:CreationDate' END, CASE WHEN pk THEN 'xmp_packet' END) END AS removed,
  CASE WHEN locked THEN '' ELSE {_PDF_PASSED} END AS checks, CASE WHEN NOT locked THEN sha256({_BLANK}) END AS output_sha256 FROM g""",
)
def pdf_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transformed(_files(spark, sf_dir, R.pdf)).drop("output", "changes")


_VERDICT = T.StructType([T.StructField(n, T.BooleanType()) for n in ("same_size", "ends_intact", "confined")])


_VERDICT_KIND = to_arrow_type(_VERDICT)


@F.arrow_udf(_VERDICT)
def _pdf_verdict(before: pa.Array, after: pa.Array) -> pa.Array:
    each = (pdf_checks(a.as_py(), b.as_py()) for a, b in zip(before, after, strict=True))
    return pa.array([dict(zip(_VERDICT.names, (passed for _, passed, _ in checks), strict=True)) for checks in each], _VERDICT_KIND)


@_query(
    "pdf_tampering",
    "SELECT doc_id, doc_id % 5 <> 2 AS same_size, doc_id % 5 <> 3 AS ends_intact, CASE WHEN doc_id % 5 = 2 THEN NULL ELSE doc_id % 5 NOT IN (1, 3) END AS confined FROM documents",
)
def pdf_tampering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks of PDFs against copies with a byte changed outside metadata, a byte more, another header, or inside metadata."""
    files = _made(spark, sf_dir, R.pdf(F.col("text")).alias("data"))
    rest = F.octet_length("data")
    change = lambda at, size, by: F.concat(F.substring("data", 1, at - 1), R.raw(by), F.substring(F.col("data"), F.lit(at + size), rest))
    after = (
        F.when(R.every(5, 1), change(10, 1, b"7"))
        .when(R.every(5, 2), R.joined(F.col("data"), b" "))
        .when(R.every(5, 3), change(1, 1, b"#"))
        .when(R.every(5, 4), F.encode(F.regexp_replace(F.decode("data", "ISO-8859-1"), "D:2024", "X:2024"), "ISO-8859-1"))
        .otherwise(F.col("data"))
    )
    return files.select("doc_id", _pdf_verdict("data", after).alias("v")).select("doc_id", "v.*")


# Office ---------------------------------------------------------------------------------------------------------

_OFFICE = f"""WITH {_D}, o AS (SELECT *, doc_id % 9 <> 4 AS doc, doc_id % 6 <> 1 AS wr, doc_id % 2 = 0 AS ap, doc_id % 4 = 0 AS cu, ['docx', 'xlsx', 'pptx'][(doc_id % 3 + 1)::INT] AS kind FROM d),
  q AS (SELECT *, doc AND (wr OR ap OR cu) AS any_of FROM o)"""


def _offices(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = settled(R.with_office(_documents(spark, sf_dir), "data").select("doc_id", "data"))
    return A.artifacts_from_binary(files, "doc_id", "data")


@_query(
    "office_findings",
    f"""{_OFFICE} SELECT doc_id, CASE WHEN any_of THEN 'office_metadata' ELSE '' END AS categories, CASE WHEN any_of THEN CASE WHEN cu THEN 'warning' ELSE 'notice' END END AS severity,
  CASE WHEN any_of THEN upper(kind) || ' document carries ' || (2 * wr::INT + ap::INT + cu::INT) || ' metadata field(s)' || CASE WHEN cu THEN ' including author/company information' ELSE '' END END AS summary,
  CASE WHEN any_of AND wr THEN 'Writer ' || doc_id END AS creator, CASE WHEN any_of AND ap THEN 'Firm ' || (doc_id % 10) END AS company, CASE WHEN any_of AND cu THEN doc_id::VARCHAR END AS code FROM q""",
)
def office_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = "office_metadata"
    return _inspected(_offices(spark, sf_dir)).select(
        "doc_id", "categories", _of(name)["severity"].alias("severity"), _of(name)["summary"].alias("summary"), _detail(name, "core.creator").alias("creator"),
        _detail(name, "app.Company").alias("company"), _detail(name, "custom.ClientCode").alias("code"),
    )


_CONTENT = T.StructType([T.StructField("parts", T.StringType()), T.StructField("content", T.BinaryType()), T.StructField("properties", T.LongType())])


_CONTENT_KIND = to_arrow_type(_CONTENT)


@F.arrow_udf(_CONTENT)
def _office_content(files: pa.Array) -> pa.Array:
    """Names and bytes of the content parts, and how many properties are left."""
    rows = []
    for data in (f.as_py() for f in files):
        parts = office.content_parts(data) or {}
        rows.append({"parts": ",".join(parts), "content": b"".join(parts.values()), "properties": sum(map(len, office.properties(data).values()))})
    return pa.array(rows, _CONTENT_KIND)


_MAIN = "[" + ", ".join(f"'{n}'" for n in R.FOLDERS) + "][(doc_id % 3 + 1)::INT]"


@_query(
    "office_transform",
    f"""{_OFFICE} SELECT doc_id, CASE WHEN doc THEN 'office' ELSE 'image' END AS route, doc AS accepted, CASE WHEN NOT doc THEN {_sql_text(UNSUPPORTED)} END AS rejected_reason,
  CASE WHEN doc THEN concat_ws(',', 'docProps/core.xml', CASE WHEN ap THEN 'docProps/app.xml' END, CASE WHEN cu THEN 'docProps/custom.xml' END) END AS removed,
  CASE WHEN doc THEN 'office_parses_after=true,document_content_identical=true' ELSE '' END AS checks, {_MAIN} AS parts,
  sha256('<doc>' || replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</doc>') AS content_sha256,
  CASE WHEN doc THEN 0 ELSE 2 * wr::INT + ap::INT + cu::INT END::BIGINT AS properties_left FROM q""",
)
def office_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _transformed(_offices(spark, sf_dir)).drop("changes", "output_sha256").withColumn("left", _office_content("output"))
    return done.select(*[c for c in done.columns if c not in ("output", "left")], "left.parts", F.sha2("left.content", 256).alias("content_sha256"), F.col("left.properties").alias("properties_left"))


@_query(
    "office_part_list",
    f"""{_OFFICE}, x AS (SELECT *, '<doc>' || replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</doc>' AS body FROM o)
SELECT doc_id, {_MAIN} AS part, strlen(body)::BIGINT AS size, sha256(body) AS sha256 FROM x""",
)
def office_part_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(_offices(spark, sf_dir).select(F.col("artifact_id").alias("doc_id"), "data"), "office_parts")


# All kinds ------------------------------------------------------------------------------------------------------

#: What a document becomes by its number: PNG, JPEG, PDF, Office file, drawing, text, other binary data.
_NAMES = ("a.png", "b.JPEG", "c.pdf", "d.docx", "e.svg", "f.md", "g.gif")


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    made = [R.png(text), R.jpeg(text), R.pdf(text), F.col("office"), R.drawing(text).cast("binary"), text.cast("binary"), R.joined(b"GIF89a\0\0", text)]
    data, name = None, None
    for k, (m, n) in enumerate(zip(made, _NAMES, strict=True)):
        data = F.when(R.every(7, k), m) if data is None else data.when(R.every(7, k), m)
        name = F.when(R.every(7, k), F.lit(n)) if name is None else name.when(R.every(7, k), F.lit(n))
    files = settled(R.with_office(_documents(spark, sf_dir), "office").select("doc_id", data.alias("data"), name.alias("path")))
    return A.artifacts_from_binary(files, "doc_id", "data", "path")


_MIXED = "m AS (SELECT doc_id, doc_id % 7 AS k, doc_id % 7 IN (2, 4, 5) AS textual, CASE WHEN doc_id % 7 IN (2, 4, 5) THEN 'text' ELSE 'binary' END AS kind FROM documents)"


@_query(
    "detector_status",
    f"""WITH {_MIXED}, s AS (SELECT doc_id, k, kind, name, CASE name WHEN 'unicode' THEN textual WHEN 'text_markers' THEN textual WHEN 'file_metadata' THEN k IN (0, 1, 4)
    WHEN 'office_metadata' THEN k = 3 AND doc_id % 9 <> 4 WHEN 'pdf_metadata' THEN k = 2 AND doc_id % 11 <> 0 ELSE k IN (0, 1, 2, 4) END AS ran
  FROM m CROSS JOIN (SELECT unnest(['unicode', 'text_markers', 'file_metadata', 'office_metadata', 'pdf_metadata', 'c2pa']) AS name))
SELECT doc_id, name, ran, CASE WHEN ran THEN NULL WHEN name = 'pdf_metadata' AND k = 2 THEN 'encrypted PDF: strings are encrypted and cannot be inspected'
  ELSE 'not applicable to a ' || kind || ' artifact' END AS reason FROM s""",
)
def detector_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statuses(_mixed(spark, sf_dir)).withColumnRenamed("artifact_id", "doc_id")


@_query(
    "container_kinds",
    f"""WITH {_MIXED} SELECT doc_id, kind, CASE k WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'application/pdf' WHEN 4 THEN 'image/svg+xml' WHEN 5 THEN 'text/markdown' WHEN 6 THEN 'image/gif' END AS media_type,
  CASE k WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'application/pdf' END AS guessed, k = 3 AS zip, k = 2 AND doc_id % 11 = 0 AS encrypted FROM m""",
)
def container_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.col("data")
    return _mixed(spark, sf_dir).select(
        F.col("artifact_id").alias("doc_id"), "kind", "media_type", A.guessed_media_type(data).alias("guessed"), A.is_zip(data).alias("zip"), (A.is_pdf(data) & A.is_encrypted_pdf(data)).alias("encrypted")
    )


@_query(
    "routes",
    """SELECT doc_id, CASE doc_id % 7 WHEN 2 THEN 'pdf' WHEN 4 THEN 'svg' WHEN 5 THEN 'text' WHEN 3 THEN CASE WHEN doc_id % 9 <> 4 THEN 'office' ELSE 'image' END ELSE 'image' END AS route,
  CASE doc_id % 7 WHEN 0 THEN true WHEN 1 THEN doc_id % 8 <> 3 WHEN 2 THEN doc_id % 11 <> 0 WHEN 3 THEN doc_id % 9 <> 4 WHEN 4 THEN doc_id % 3 <> 0 AND doc_id % 10 <> 7 WHEN 5 THEN true ELSE false END AS accepted FROM documents""",
)
def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transformed(_mixed(spark, sf_dir)).select("doc_id", "route", "accepted")


@_query(
    "byte_artifacts",
    f"""WITH {_D}, b AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN encode(t) WHEN 1 THEN encode(t) || unhex('ff') WHEN 2 THEN unhex('6100') || encode(t)
    WHEN 3 THEN unhex('efbbbf') || encode(t) ELSE encode(repeat('x', 8192)) || unhex('00') || encode(t) END AS data, doc_id % 5 IN (1, 2) AS bin FROM d)
SELECT doc_id, CASE WHEN bin THEN 'binary' ELSE 'text' END AS kind, CASE WHEN NOT bin THEN CASE WHEN doc_id % 5 = 3 THEN 'utf-8-sig' ELSE 'utf-8' END END AS encoding, NOT bin AS decoded,
  octet_length(data)::BIGINT AS size_bytes, sha256(data) AS sha256 FROM b""",
)
def byte_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text").cast("binary")
    data = (
        F.when(R.every(5, 1), R.joined(text, b"\xff"))
        .when(R.every(5, 2), R.joined(b"a\0", text))
        .when(R.every(5, 3), R.joined(b"\xef\xbb\xbf", text))
        .when(R.every(5, 4), R.joined(b"x" * 8192, b"\0", text))
        .otherwise(text)
    )
    made = A.artifacts_from_binary(_made(spark, sf_dir, data.alias("data")), "doc_id", "data")
    return made.select(F.col("artifact_id").alias("doc_id"), "kind", "encoding", "decoded", "size_bytes", "sha256")


_DRAWING = """('<svg xmlns="http://www.w3.org/2000/svg" xmlns:x="x">' || {blocks} || '<path d=''' || doc_id || '''/><text>'
  || replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</text>' || CASE WHEN doc_id % 10 = 7 THEN '<rect>' ELSE '' END || '</svg>')"""


@_query(
    "svg_transform",
    f"""WITH {_D} SELECT doc_id, nullif(concat_ws(',', CASE WHEN doc_id % 2 = 0 OR contains(lower(t), 'c2pa') THEN 'c2pa_manifest' END,
    CASE WHEN doc_id % 2 = 0 OR doc_id % 3 = 0 OR doc_id % 5 = 0 OR contains(t, 'dc:') THEN 'svg_metadata' END), '') AS categories,
  doc_id % 3 <> 0 AND doc_id % 10 <> 7 AS accepted,
  CASE WHEN doc_id % 3 = 0 OR doc_id % 10 = 7 THEN 'svg validation failed: ' || concat_ws('; ', CASE WHEN doc_id % 10 = 7 THEN 'svg_parses_after' END, CASE WHEN doc_id % 3 = 0 THEN 'drawing_elements_preserved' END) END AS rejected_reason,
  CASE WHEN doc_id % 3 <> 0 AND doc_id % 10 <> 7 THEN sha256({_DRAWING.format(blocks="''")}) END AS output_sha256 FROM d""",
)
def svg_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawings of the documents' texts, with metadata to find and to strip."""
    drawings = _made(spark, sf_dir, R.drawing(F.col("text")).alias("text"))
    artifacts = A.artifacts_from_text(drawings, "doc_id", "text", F.lit("a.svg"))
    found = _inspected(artifacts).select("doc_id", F.nullif("categories", F.lit("")).alias("categories"))
    done = transform(artifacts).withColumnRenamed("artifact_id", "doc_id").select("doc_id", "accepted", "rejected_reason", "output_sha256")
    return done.join(found, "doc_id", "left").select("doc_id", "categories", "accepted", "rejected_reason", "output_sha256")


_KEPT = "'import sys  # kept' || chr(10) || 'from json import loads, dumps' || chr(10)"
_REST = "CASE WHEN doc_id % 3 = 0 THEN 'import re  # noqa' || chr(10) ELSE '' END || regexp_replace('# ' || replace(t, chr(10), chr(10) || '# '), '(?m)[ \\t]+$', '', 'g') || chr(10) || 'print(sys.argv, ''dumps'')' || chr(10)"


@_query(
    "remove_unused_imports",
    f"""WITH {_D}, v AS (SELECT *, doc_id % 7 = 0 AS broken, doc_id % 5 = 0 AS zw FROM d)
SELECT doc_id, NOT broken AND NOT zw AS accepted, CASE WHEN broken OR zw THEN false ELSE true END AS all_passed,
  CASE WHEN NOT broken AND NOT zw THEN sha256({_KEPT} || {_REST}) END AS output_sha256,
  CASE WHEN broken THEN 'code_parses_after=false,code_semantics_preserved=null' WHEN zw THEN 'code_semantics_preserved=false' ELSE 'code_semantics_preserved=true' END AS code,
  CASE WHEN broken THEN '' ELSE 'structural_output_parses=true,structural_delta_is_import_removal_only=true,removed_imports_unreferenced=true' END AS proofs FROM v""",
)
def remove_unused_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python modules around the documents' texts, cleaned with the code profile."""
    from siftglass.operators.transform import Options

    sources = _made(spark, sf_dir, R.module(F.col("text")).alias("text"))
    artifacts = A.artifacts_from_text(sources, "doc_id", "text", F.concat(F.lit("m"), F.col("doc_id").cast("string"), F.lit(".py")))
    done = transform(artifacts, Options(profile="code", changes=False))
    named = lambda pattern: F.array_join(F.transform(F.filter("checks", lambda c: c["name"].rlike(pattern)), lambda c: F.concat(c["name"], F.lit("="), F.coalesce(c["passed"].cast("string"), F.lit("null")))), ",")
    code = F.when(named("^code_parses").endswith("false"), named("^code_")).otherwise(named("^code_sem"))
    return done.select(F.col("artifact_id").alias("doc_id"), "accepted", "all_passed", F.sha2(F.when(F.col("accepted"), F.col("output")), 256).alias("output_sha256"), code.alias("code"), named("^structural_|^removed_").alias("proofs"))
