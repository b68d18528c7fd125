"""Findings in containers: images, drawings, Office documents and PDFs.

Only artifacts that a signature or media type lets in reach Python, in Arrow batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from siftglass.functions import images, office, pdfs
from siftglass.operators.artifacts import is_jpeg, is_pdf, is_png, is_zip
from siftglass.operators.text_findings import FINDING

#: Detectors of containers in the order in which they run.
DETECTORS = ("file_metadata", "office_metadata", "pdf_metadata", "c2pa")

Finding = tuple[str, str, str, str, dict[str, object], list[str]]


def _file(data: bytes, text: str | None, media: str | None) -> list[Finding] | None:
    """Metadata of PNG, JPEG and SVG; null if the detector doesn't apply."""
    one = lambda category, summary, details: ("embedded_metadata", category, "info", summary, details, [])
    if data.startswith(images.PNG_MAGIC):
        read = images.png_entries(data)
        if read is None:
            return [one("malformed_container", "PNG signature present but no readable chunks", {"container": "png"})]
        n, kinds, entries = read
        return [one("png_metadata", f"PNG carries {n} metadata chunk(s)", {"container": "png", "chunks": kinds, "entries": entries})] if n else []
    if data.startswith(images.JPEG_MAGIC):
        names, fields = images.jpeg_names(data)
        if not names:
            return []
        out = [one("jpeg_metadata", f"JPEG carries {sum(names.values())} metadata segment(s)", {"container": "jpeg", "segments": names})]
        if fields:
            placed = {"gps_latitude", "gps_longitude"} <= fields.keys()
            what = ("photo_location", "warning", "Photo embeds GPS location") if placed else ("photo_exif", "notice", "Photo embeds camera/EXIF details")
            out.append(("embedded_metadata", *what, fields, ["strip_image_metadata"]))
        return out
    if media != "image/svg+xml" or text is None:
        return None
    marks = {"metadata_element": ("<metadata",), "xmp": ("x:xmpmeta", "adobe:ns:meta"), "dublin_core": ("dc:", "purl.org/dc/"), "rdf": ("rdf:RDF",)}
    blocks = [name for name, any_of in marks.items() if any(m in text for m in any_of)]
    return [one("svg_metadata", f"SVG carries metadata blocks: {', '.join(blocks)}", {"container": "svg", "blocks": blocks})] if blocks else []


def _office(data: bytes, text: str | None, media: str | None) -> list[Finding] | None:
    package = office.Package.of(data) if data.startswith(b"PK\x03\x04") else None
    if package is None or not package.is_document:
        return None
    found, kind = package.properties(), package.kind
    names = [n for bucket in found.values() for n in bucket]
    if not names:
        return []
    personal = bool(found["custom"]) or any(n in office.PERSONAL for n in names)
    summary = f"{kind.upper()} document carries {len(set(names))} metadata field(s)" + personal * " including author/company information"
    return [("embedded_metadata", "office_metadata", "warning" if personal else "notice", summary, {"container": kind, **found}, ["strip_office_metadata"])]


def _pdf(data: bytes, text: str | None, media: str | None) -> list[Finding] | None:
    layout = pdfs.Layout.of(data) if data.startswith(b"%PDF-") else None
    if layout is None or layout.encrypted:
        return None
    out: list[Finding] = []
    if fields := layout.fields():
        personal = not fields.keys().isdisjoint(("Author", "Title", "Subject", "Keywords"))
        summary = f"PDF information dictionary carries {len(fields)} field(s)" + personal * " including author/title information"
        out.append(("embedded_metadata", "pdf_info_dictionary", "warning" if personal else "notice", summary, dict(fields), ["strip_pdf_metadata"]))
    n, tool = layout.summary()
    if n:
        details: dict[str, object] = {"packets": n} | ({"creator_tool": tool} if tool is not None else {})
        summary = f"PDF carries {n} XMP metadata packet(s)" + (f" (creator tool: {tool})" if tool else "")
        out.append(("embedded_metadata", "pdf_xmp_metadata", "notice", summary, details, ["strip_pdf_metadata"]))
    return out


def _credential(data: bytes, text: str | None, media: str | None) -> list[Finding] | None:
    """Content credentials by their structure; nothing here verifies a signature, and the finding says so."""
    if data.startswith(images.PNG_MAGIC):
        where = ("png", "caBX chunk") if images.has_png_credential(data) else None
    elif data.startswith(images.JPEG_MAGIC):
        where = ("jpeg", "APP11 JUMBF segment") if images.has_jpeg_credential(data) else None
    elif data.startswith(b"%PDF-"):
        where = ("pdf", "associated file with /C2PA_Manifest relationship") if b"/C2PA_Manifest" in data else None
    elif media == "image/svg+xml":
        where = ("svg", "c2pa reference in SVG markup") if "c2pa" in (text or "").lower() else None
    else:
        return None
    if where is None:
        return []
    details: dict[str, object] = {
        "container": where[0],
        "located_in": where[1],
        "verification": "not_performed",
        "verification_reason": "no verifier is installed; manifest presence was detected structurally but the signature was not verified",
    }
    return [("signed_provenance", "c2pa_manifest", "info", f"C2PA manifest store present in {where[0]} container", details, [])]


_RUN: dict[str, Callable[[bytes, str | None, str | None], list[Finding] | None]] = dict(
    zip(DETECTORS, (_file, _office, _pdf, _credential), strict=True)
)
STATUS = T.StructType([T.StructField("name", T.StringType()), T.StructField("ran", T.BooleanType()), T.StructField("reason", T.StringType())])


def detect(data: bytes, text: str | None, kind: str, media: str | None) -> tuple[list[dict[str, object]], list[tuple[str, bool, str | None]]]:
    """Findings of one artifact's container, and how each detector fared.  One that fails doesn't stop the others."""
    findings: list[dict[str, object]] = []
    status: list[tuple[str, bool, str | None]] = []
    for name, run in _RUN.items():
        try:
            found = run(data, text, media)
        except Exception as problem:  # noqa: BLE001 - a broken file is a status, not the end of the task
            status.append((name, False, f"{type(problem).__name__}: {problem}"))
            continue
        if found is None:
            encrypted = name == "pdf_metadata" and data.startswith(b"%PDF-")
            reason = "encrypted PDF: strings are encrypted and cannot be inspected" if encrypted else f"not applicable to a {kind} artifact"
            if name == "file_metadata" and media == "image/svg+xml":
                reason = "unsupported container for metadata inspection"
            status.append((name, False, reason))
            continue
        status.append((name, True, None))
        for evidence, category, severity, summary, details, operations in found:
            findings.append(
                {
                    "detector": name,
                    "category": category,
                    "evidence_class": evidence,
                    "severity": severity,
                    "summary": summary,
                    "label": "confirmed",
                    "count": 1,
                    "locations": [],
                    "details": json.dumps(details, ensure_ascii=False),
                    "removable_by": operations,
                }
            )
    return findings, status


DETECTED = T.StructType([T.StructField("findings", T.ArrayType(FINDING)), T.StructField("statuses", T.ArrayType(STATUS))])


def is_container(data: Column, media_type: Column) -> Column:
    """Whether a container detector may apply."""
    return is_png(data) | is_jpeg(data) | is_pdf(data) | is_zip(data) | F.coalesce(media_type == "image/svg+xml", F.lit(False))


@F.arrow_udf(DETECTED)
def _detected(data: pa.Array, text: pa.Array, kind: pa.Array, media: pa.Array) -> pa.Array:
    rows: list[dict[str, object] | None] = []
    for one in zip(data.to_pylist(), text.to_pylist(), kind.to_pylist(), media.to_pylist(), strict=True):
        if one[0] is None:
            rows.append(None)
            continue
        findings, states = detect(*one)
        rows.append({"findings": findings, "statuses": [dict(zip(STATUS.names, s, strict=True)) for s in states]})
    return pa.array(rows, _DETECTED_KIND)


_DETECTED_KIND = to_arrow_type(DETECTED)


def detected() -> Column:
    """The findings and detector states of a row's container; null, and nothing sent to Python, for other artifacts."""
    apt = is_container(F.col("data"), F.col("media_type"))
    return _detected(F.when(apt, F.col("data")), F.when(apt, F.col("text")), F.col("kind"), F.col("media_type"))


def inspected_containers(artifacts: DataFrame) -> DataFrame:
    """``artifact_id, findings, statuses`` of the artifacts that a container detector may apply to."""
    chosen = artifacts.where(is_container(F.col("data"), F.col("media_type")))
    return chosen.select("artifact_id", detected().alias("d")).select("artifact_id", "d.*")


def file_findings(artifacts: DataFrame) -> DataFrame:
    """Findings of containers: ``artifact_id`` and the columns of a finding."""
    return inspected_containers(artifacts).select("artifact_id", F.explode("findings").alias("f")).select("artifact_id", "f.*")
