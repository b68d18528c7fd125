"""Containers made from plain rows with Spark expressions: PNG, JPEG with EXIF, PDF and Office files.

Each file holds a document's whole text and, by the document's id, metadata of every kind.  The formats are written
here byte by byte, with valid lengths and checksums, so that whole tables can be turned into files without a file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftglass.functions.barrier import settled

def number() -> Column:
    """The document's number."""
    return F.col("doc_id")


def raw(data: bytes) -> Column:
    """Constant bytes."""
    return F.lit(data)


def joined(*parts: Column | bytes) -> Column:
    """Bytes one after another; constant neighbours are one constant."""
    runs: list[Column | bytes] = []
    for p in parts:
        if isinstance(p, bytes) and runs and isinstance(runs[-1], bytes):
            runs[-1] += p
        else:
            runs.append(p)
    return F.concat(*[raw(p) if isinstance(p, bytes) else p.cast("binary") for p in runs])


def only_if(condition: Column, part: Column | bytes) -> Column:
    """A part where a condition holds, nothing elsewhere."""
    part = raw(part) if isinstance(part, bytes) else part.cast("binary")
    return F.when(condition, part).otherwise(raw(b""))


def big(value: Column, size: int) -> Column:
    """A number in ``size`` bytes, the highest first."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))


def little(value: Column, size: int) -> Column:
    """A number in ``size`` bytes, the lowest first."""
    digits = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))]))


def every(n: int, rest: int = 0) -> Column:
    """Whether a document's number leaves a remainder."""
    return F.pmod(number(), F.lit(n)) == rest


# PNG ------------------------------------------------------------------------------------------------------------

PNG_HEAD = b"\x89PNG\r\n\x1a\n"
PIXELS = 7


def png_chunk(kind: bytes, payload: Column | bytes) -> Column:
    """A chunk of a PNG file."""
    body = joined(kind, payload)
    return joined(big(F.octet_length(body) - 4, 4), body, big(F.crc32(body), 4))


def constant_chunk(kind: bytes, payload: bytes) -> bytes:
    """A chunk that is the same in every file."""
    return struct.pack(">I", len(payload)) + kind + payload + struct.pack(">I", zlib.crc32(kind + payload))


PNG_FIRST = constant_chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0))
PNG_LAST = constant_chunk(b"IEND", b"")


def pixel_payload(k: int) -> bytes:
    """The compressed single pixel of a file."""
    return zlib.compress(bytes([0, 20 * k]))


def png(text: Column) -> Column:
    """A PNG with the text as its description; every sixth one is cut off behind its signature."""
    pixels = F.element_at(F.array(*[raw(constant_chunk(b"IDAT", pixel_payload(k))) for k in range(PIXELS)]), F.pmod(number(), F.lit(PIXELS)).cast("int") + 1)
    whole = joined(
        PNG_HEAD,
        PNG_FIRST,
        only_if(~every(4), png_chunk(b"tEXt", joined(b"Description\0", text))),
        only_if(every(3), png_chunk(b"zTXt", joined(b"Comment\0\0", number().cast("string")))),
        only_if(every(5), png_chunk(b"iTXt", joined(b"Author\0\0\0en\0\0author ", number().cast("string")))),
        only_if(every(5, 1), constant_chunk(b"caBX", b"jumb box")),
        only_if(every(7, 2), constant_chunk(b"iCCP", b"profile")),
        pixels,
        PNG_LAST,
    )
    return F.when(every(6, 5), joined(PNG_HEAD, b"\0\0")).otherwise(whole)


# JPEG -----------------------------------------------------------------------------------------------------------

JPEG_HEAD = b"\xff\xd8\xff\xe0\x00\x10JFIF\0\1\1\0\0\1\0\1\0\0"
JPEG_COMMENT = b"\xff\xfe\x00\x0ca comment."
JPEG_BOX = b"\xff\xeb\x00\x0eJP\0\0\0\0jumb\0\0"
JPEG_SCAN, JPEG_TAIL = b"\xff\xda\x00\x08\1\1\0\0\x3f\0", b"\xff\xd9"


def segment(marker: int, payload: Column) -> Column:
    """A segment of a JPEG file."""
    return joined(bytes([0xFF, marker]), big(F.octet_length(payload) + 2, 2), payload)


def exif() -> Column:
    """An EXIF block in either byte order: the camera's make, and with it a place."""

    def block(written: Callable[[Column, int], Column], order: str) -> Column:
        n = lambda value, size: value.to_bytes(size, order) if isinstance(value, int) else written(value, size)
        entry = lambda tag, kind, count, *value: [n(tag, 2), n(kind, 2), n(count, 4), *value]
        make = joined(F.lpad(F.pmod(number(), F.lit(100000)).cast("string"), 5, "0"), b" cam\0")  # ten bytes
        main_at, make_at, place_at, degrees_at = 8, 38, 48, 102
        main = [n(2, 2), *entry(0x010F, 2, 10, n(make_at, 4)), *entry(0x8825, 4, 1, n(place_at, 4)), n(0, 4)]
        north, east = F.when(every(2), "N").otherwise("S"), F.when(every(3), "E").otherwise("W")
        place = [
            n(4, 2),
            *entry(1, 2, 2, north, b"\0\0\0"),
            *entry(2, 5, 3, n(degrees_at, 4)),
            *entry(3, 2, 2, east, b"\0\0\0"),
            *entry(4, 5, 3, n(degrees_at + 24, 4)),
            n(0, 4),
        ]
        minutes = n(F.pmod(number(), F.lit(60)), 4)
        degrees = [x for most in (90, 180) for x in (n(F.pmod(number(), F.lit(most)), 4), n(1, 4), minutes, n(1, 4), n(36, 4), n(10, 4))]
        return joined(n(main_at, 4), *main, make, *place, *degrees)

    order = F.when(every(2), joined(b"MM\0*", block(big, "big"))).otherwise(joined(b"II*\0", block(little, "little")))
    return joined(b"Exif\0\0", order)


def jpeg(text: Column) -> Column:
    """A JPEG whose scan is the text; every eighth one has no scan."""
    return joined(
        JPEG_HEAD,
        only_if(~every(3, 1), segment(0xE1, exif())),
        only_if(every(5), segment(0xE1, joined(b"http://ns.adobe.com/xap/1.0/\0", number().cast("string")))),
        only_if(every(4), JPEG_COMMENT),
        only_if(every(7), JPEG_BOX),
        F.when(every(8, 3), raw(b"")).otherwise(joined(JPEG_SCAN, text, JPEG_TAIL)),
    )


# PDF ------------------------------------------------------------------------------------------------------------

PDF_HEAD = "%PDF-1.4\n1 0 obj\n<< /Type /Catalog >>\nendobj\n2 0 obj\n<< /Filter /ASCIIHexDecode >>\nstream\n"
PDF_DECOY = "\nendstream\nendobj\n9 0 obj\n<< >>\nstream\n3 0 obj << /Author (decoy) >> endobj\nendstream\nendobj\n3 0 obj\n<< "
PDF_PACKET = ">>\nendobj\n4 0 obj\n<< /Type /Metadata >>\nstream\n"
PACKET_HEAD, PACKET_TAIL = '<?xpacket begin="" id="x"?>', '<?xpacket end="w"?>'
PDF_TAIL = "\nendstream\nendobj\ntrailer\n<< /Root 1 0 R /Info 3 0 R "


def number_text(c: Column | None = None) -> Column:
    """The document's number, or another one, as text."""
    return (number() if c is None else c).cast("string")


def pdf(text: Column) -> Column:
    """A PDF whose page is the text in hexadecimal, with a decoy in a stream; every eleventh one is encrypted."""
    author = F.concat(F.lit("/Author (Writer \\("), number_text(), F.lit("\\) a\\101) "))
    title = F.concat(F.lit("/Title <FEFF"), F.regexp_replace(F.hex(number_text().cast("binary")), "(..)", "00$1"), F.lit("> "))
    packet = F.concat(F.lit(PACKET_HEAD), F.lit("<xmp:CreatorTool>tool "), number_text(), F.lit("</xmp:CreatorTool>"), F.lit(" " * 20), F.lit(PACKET_TAIL))
    pieces = [
        F.lit(PDF_HEAD),
        F.lower(F.hex(text.cast("binary"))),
        F.lit(PDF_DECOY),
        F.when(~every(4, 3), author).otherwise(""),
        F.when(every(2), title).otherwise(""),
        F.when(every(3), "/CreationDate (D:2024) ").otherwise(""),
        F.lit(PDF_PACKET),
        F.when(every(5) | every(5, 2), packet).otherwise("no packet"),
        F.lit(PDF_TAIL),
        F.when(every(11), "/Encrypt 7 0 R ").otherwise(""),
        F.when(every(13), "/AF /C2PA_Manifest ").otherwise(""),
        F.lit(">>\n%%EOF\n"),
    ]
    return reduce(lambda a, b: F.concat(a, b), pieces).cast("binary")


# Office ---------------------------------------------------------------------------------------------------------


def with_archive(df: DataFrame, members: list[tuple[Column, Column, Column]], out: str) -> DataFrame:
    """``df`` with a ZIP archive of stored members (name, content, whether it is there) as a column.

    Contents, members and the index are columns of their own, one settled after the other, so that none is
    written out where a later one uses it.
    """
    n = range(len(members))
    df = settled(df.select("*", *[x.alias(f"_{w}{k}") for k, m in enumerate(members) for w, x in zip(("name", "body", "there"), m, strict=True)]))
    sized = [F.octet_length(f"_body{k}") for k in n]
    common = [joined(b"\x14\0\0\0\0\0\0\0\x21\0", little(F.crc32(F.col(f"_body{k}").cast("binary")), 4), little(sized[k], 4), little(sized[k], 4), little(F.octet_length(f"_name{k}"), 2), b"\0\0") for k in n]
    df = settled(df.select("*", *[c.alias(f"_common{k}") for k, c in enumerate(common)]))
    local = [only_if(F.col(f"_there{k}"), joined(b"PK\x03\x04", F.col(f"_common{k}"), F.col(f"_name{k}"), F.col(f"_body{k}"))) for k in n]
    df = settled(df.select("*", *[x.alias(f"_local{k}") for k, x in enumerate(local)]))
    offsets = [sum((F.octet_length(f"_local{j}") for j in range(k)), F.lit(0)) for k in range(len(members) + 1)]
    index = [only_if(F.col(f"_there{k}"), joined(b"PK\x01\x02\x14\0", F.col(f"_common{k}"), b"\0\0\0\0\0\0\0\0\0\0", little(offsets[k], 4), F.col(f"_name{k}"))) for k in n]
    count = sum((F.when(F.col(f"_there{k}"), 1).otherwise(0) for k in n), F.lit(0))
    df = settled(df.select("*", joined(*index).alias("_index"), little(count, 2).alias("_count"), offsets[-1].alias("_end")))
    end = joined(b"PK\x05\x06\0\0\0\0", F.col("_count"), F.col("_count"), little(F.octet_length("_index"), 4), little(F.col("_end"), 4), b"\0\0")
    data = joined(*[F.col(f"_local{k}") for k in n], F.col("_index"), end)
    return df.select(*[c for c in df.columns if not c.startswith("_")], data.alias(out))


FOLDERS = ("word/document.xml", "xl/workbook.xml", "ppt/presentation.xml")


def escaped_xml(text: Column) -> Column:
    """A text as the content of an element."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def with_office(df: DataFrame, out: str) -> DataFrame:
    """``df`` (``doc_id, text``) with a document, workbook or presentation that has the text as its content.

    Every ninth archive is no document.
    """
    core = F.concat(
        F.lit('<c:p xmlns:c="c" xmlns:d="d">'),
        F.when(~every(6, 1), F.concat(F.lit("<d:creator>Writer "), number_text(), F.lit("</d:creator><c:revision>7</c:revision>"))).otherwise(""),
        F.lit("<c:other>stays</c:other></c:p>"),
    )
    app = F.concat(F.lit('<P xmlns="e"><Company>Firm '), number_text(F.pmod(number(), F.lit(10))), F.lit("</Company><Pages>1</Pages></P>"))
    custom = F.concat(F.lit('<P xmlns="f"><property name="ClientCode"><v>'), number_text(), F.lit("</v></property></P>"))
    main = F.element_at(F.array(*[F.lit(n) for n in FOLDERS]), F.pmod(number(), F.lit(3)).cast("int") + 1)
    yes = F.lit(True)
    members = [
        (F.lit("[Content_Types].xml"), F.lit("<Types/>"), ~every(9, 4)),
        (main, F.concat(F.lit("<doc>"), escaped_xml(F.col("text")), F.lit("</doc>")), yes),
        (F.lit("docProps/core.xml"), core, yes),
        (F.lit("docProps/app.xml"), app, every(2)),
        (F.lit("docProps/custom.xml"), custom, every(4)),
    ]
    return with_archive(df, members, out)


# Drawings and modules -------------------------------------------------------------------------------------------


def drawing(text: Column) -> Column:
    """An SVG drawing that shows the text, with metadata to find and to strip; every tenth one doesn't parse."""
    return F.concat(
        F.lit('<svg xmlns="http://www.w3.org/2000/svg" xmlns:x="x">'),
        F.when(every(2), "<metadata>c2pa</metadata>").otherwise(""),
        F.when(every(3), "<x:xmpmeta><g/></x:xmpmeta>").otherwise(""),
        F.when(every(5), "<metadata id='k'/>").otherwise(""),
        F.lit("<path d='"), number_text(), F.lit("'/><text>"), escaped_xml(text), F.lit("</text>"),
        F.when(every(10, 7), "<rect>").otherwise(""),
        F.lit("</svg>"),
    )


def module(text: Column) -> Column:
    """A Python module with the text as its comment; by its number with strings that must stay, or broken."""
    return F.concat(
        F.lit("import os\nimport sys  # kept\nfrom json import loads, dumps\n"),
        F.when(every(3), "import re  # noqa\n").otherwise(""),
        F.lit("# "), F.replace(text, F.lit("\n"), F.lit("\n# ")), F.lit("\n"),
        F.when(every(5), "x = '\u200b'\n").otherwise("print(sys.argv, 'dumps')   \n"),
        F.when(every(7), "def broken(:\n").otherwise(""),
    )
