"""Containers: reading, stripping, checking, and the whole way through Spark."""

import json

import pytest

from siftglass.functions import images, office, pdfs
from tests.builders import docx, exif, jpeg, pdf, png, segment


def test_png():
    data = png([("Software", "x"), ("Software", "y" * 300)], credential=True, extra=[(b"zTXt", b"Key\0\0abc"), (b"iTXt", b"K\0\0\0en\0k\0text"), (b"iCCP", b"p")])
    n, kinds, entries = images.png_entries(data)
    assert (n, kinds) == (5, ["iCCP", "iTXt", "tEXt", "zTXt"])
    assert entries == {"Software": "y" * 200, "Key": "<compressed>", "K": "text"}
    fresh, gone = images.strip_png(data)
    assert gone == ["tEXt", "tEXt", "zTXt", "iTXt", "caBX"]
    assert images.pixel_digest(fresh) == images.pixel_digest(data)
    assert images.strip_png(fresh) == (fresh, [])
    assert images.png_entries(images.PNG_MAGIC + b"\0\0") is None
    assert images.strip_png(data + b"tail")[0] == fresh


@pytest.mark.parametrize("order", [">", "<"])
def test_exif(order):
    assert images.exif_fields(exif(b"Camera\0", order=order)) == {"camera make": "Camera", "gps_latitude": 37.8, "gps_longitude": -122.416667}
    assert images.exif_fields(exif(gps=False, order=order)) == {"camera make": "Cam"}
    whole = exif(b"Camera\0", order=order)
    for k in range(len(whole)):
        images.exif_fields(whole[:k])


def test_jpeg():
    data = jpeg(segment(0xE1, exif()), segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0x"), segment(0xFE, b"note"), segment(0xDB, b"table"), segment(0xEB, b"JP\0\0jumb"))
    names, fields = images.jpeg_names(data)
    assert names == {"APP0 (JFIF)": 1, "APP1 (Exif)": 1, "APP1 (XMP)": 1, "COM (comment)": 1, "other": 1, "APP11 (JUMBF)": 1}
    assert fields["camera make"] == "Cam"
    fresh, gone = images.strip_jpeg(data)
    assert gone == ["APP1", "APP1", "APP30", "APP11"]
    assert images.pixel_digest(fresh) == images.pixel_digest(data) != ""
    assert images.jpeg_names(fresh)[0] == {"APP0 (JFIF)": 1, "other": 1}
    bare = jpeg(scan=False)
    assert images.strip_jpeg(bare) == (bare, []) and images.pixel_digest(bare) == ""


def test_office():
    data = docx()
    assert office.is_office(data) and office.office_kind(data) == "docx"
    assert office.properties(data) == {"core": {"creator": "A. Writer", "revision": "7"}, "app": {"Company": "Acme"}, "custom": {"ClientCode": "42"}}
    fresh, gone = office.strip_office(data)
    assert gone == ["docProps/core.xml", "docProps/app.xml", "docProps/custom.xml"]
    assert office.properties(fresh) == {"core": {}, "app": {}, "custom": {}}
    assert office.content_parts(fresh) == office.content_parts(data) == {"word/document.xml": b"<doc>text</doc>"}
    assert b"stays" in __import__("zipfile").ZipFile(__import__("io").BytesIO(fresh)).read("docProps/core.xml")
    assert not office.is_office(b"PK\x03\x04junk") and office.content_parts(b"x") is None


def test_pdf():
    data = pdf()
    assert pdfs.info_fields(data) == {"Author": "A (b) c", "Producer": "AB", "CreationDate": "D:2024"}
    assert pdfs.packet_summary(data) == (1, "Tool")
    fresh, gone = pdfs.strip_pdf(data)
    assert gone == ["info:Author", "info:Producer", "info:CreationDate", "xmp_packet"]
    assert len(fresh) == len(data) and pdfs.info_fields(fresh) == {} and pdfs.packet_summary(fresh) == (0, None)
    assert pdfs.strip_pdf(fresh) == (fresh, [])
    decoy = pdf(content="3 0 obj << /Author (kept) >> endobj (<?xpacket begin=)")
    assert b"(kept)" in pdfs.strip_pdf(decoy)[0]
    assert pdfs.is_encrypted(pdf(trailer="/Info 3 0 R /Encrypt 9 0 R"))
    assert pdfs.info_fields(pdf(info="/Title (a\\101\\n\\x) /Author (open")) == {"Title": "aA\nx"}


def test_pdf_check_notices_a_stray_byte():
    from siftglass.operators.transform import pdf_checks

    data = pdf()
    fresh = pdfs.strip_pdf(data)[0]
    assert [p for _, p, _ in pdf_checks(data, fresh)] == [True, True, True]
    assert [p for _, p, _ in pdf_checks(data, fresh.replace(b"Hello", b"HellO"))] == [True, True, False]
    assert [p for _, p, _ in pdf_checks(data, fresh + b" ")] == [False, True, None]


@pytest.fixture(scope="module")
def tree(spark):
    from siftglass.operators.artifacts import artifacts_from_binary

    files = {
        "a.png": png([("Author", "x")], credential=True),
        "plain.png": png(),
        "short.png": images.PNG_MAGIC + b"\0\0",
        "b.jpg": jpeg(segment(0xE1, exif())),
        "noscan.jpg": jpeg(scan=False),
        "c.docx": docx(),
        "d.pdf": pdf(),
        "locked.pdf": pdf(trailer="/Encrypt 9 0 R"),
        "e.svg": b"<svg xmlns:x='u'><metadata>c2pa</metadata><path/></svg>",
        "broken.svg": b"<svg><metadata>x</metadata><path></svg>",
        "f.gif": b"GIF89a\0\0",
        "g.md": "﻿# Hi​ there  \r\n\r\ntext\n".encode(),
        "h.zip": b"PK\x03\x04\0\0\0",
        "i.py": b"import os\nimport re\nprint(re)\n",
        "j.txt": "ok ‮".encode() + b"\n",
    }
    rows = [(k, n, bytearray(d)) for k, (n, d) in enumerate(files.items())]
    return files, artifacts_from_binary(spark.createDataFrame(rows, "id long, name string, data binary"), "id", "data", "name")


def test_findings_of_a_tree(tree):
    from siftglass.operators.inspect import findings, provenance, statuses

    files, artifacts = tree
    names = list(files)
    found = {}
    for r in findings(artifacts).collect():
        found.setdefault(names[r["artifact_id"]], {})[r["category"]] = r
    assert {n: sorted(f) for n, f in found.items()} == {
        "a.png": ["c2pa_manifest", "png_metadata"],
        "short.png": ["malformed_container"],
        "b.jpg": ["jpeg_metadata", "photo_location"],
        "noscan.jpg": ["jpeg_metadata"],
        "c.docx": ["office_metadata"],
        "d.pdf": ["pdf_info_dictionary", "pdf_xmp_metadata"],
        "e.svg": ["c2pa_manifest", "svg_metadata"],
        "broken.svg": ["svg_metadata"],
        "g.md": ["byte_order_mark", "mixed_line_endings", "zero_width"],
        "j.txt": ["bidi_control"],
    }
    assert found["c.docx"]["office_metadata"]["severity"] == "warning"
    assert json.loads(found["a.png"]["c2pa_manifest"]["details"])["verification"] == "not_performed"
    zero = found["g.md"]["zero_width"]
    assert zero["summary"] == "1 zero width character(s) present"
    place = zero["locations"][0]
    assert (place["offset"], place["line"], place["column"], place["excerpt"]) == (5, 1, 6, "U+200B ZERO WIDTH SPACE")
    status = {(names[r["artifact_id"]], r["name"]): (r["ran"], r["reason"]) for r in statuses(artifacts).collect()}
    assert len(status) == 6 * len(files)
    assert status["f.gif", "unicode"] == (False, "not applicable to a binary artifact")
    assert status["locked.pdf", "pdf_metadata"] == (False, "encrypted PDF: strings are encrypted and cannot be inspected")
    told = {names[r["artifact_id"]]: r for r in provenance(artifacts).collect()}
    assert told["a.png"]["known_signals"] == ["c2pa:c2pa_manifest", "file_metadata:png_metadata"]
    assert len(told["g.md"]["unknown_signals"]) == 3 and len(told["i.py"]["unknown_signals"]) == 2 and len(told["a.png"]["unknown_signals"]) == 1
    assert {r["confidence"] for r in told.values()} == {"insufficient_evidence"}


def test_transforms_of_a_tree(tree):
    from siftglass.operators.transform import Options, transform

    files, artifacts = tree
    names = list(files)
    done = {names[r["artifact_id"]]: r for r in transform(artifacts, Options(profile="code")).collect()}
    assert {n for n, r in done.items() if r["accepted"]} == {"a.png", "plain.png", "short.png", "b.jpg", "c.docx", "d.pdf", "e.svg", "g.md", "i.py", "j.txt"}
    for n, r in done.items():
        if not r["accepted"]:
            assert bytes(r["output"]) == files[n] and r["rejected_reason"] and r["output_sha256"] is None
    assert bytes(done["i.py"]["output"]) == b"import re\nprint(re)\n"
    assert bytes(done["g.md"]["output"]).decode() == "# Hi there\n\ntext\n"
    assert done["locked.pdf"]["rejected_reason"].startswith("encrypted PDF")
    assert done["broken.svg"]["rejected_reason"] == "svg validation failed: svg_parses_after"
    assert done["noscan.jpg"]["rejected_reason"] == "image validation failed: image_parses_after; pixel_data_identical"
    assert [c["name"] for c in done["i.py"]["checks"]][:5] == [
        "structural_output_parses",
        "structural_delta_is_import_removal_only",
        "removed_imports_unreferenced",
        "code_parses_after",
        "code_semantics_preserved",
    ]
