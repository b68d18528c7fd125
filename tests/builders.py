"""Small files of each format, built from the formats' public rules."""

import io
import struct
import zipfile
import zlib

PNG_MAGIC = b"\x89PNG\r\n\x1a\n"


def png_chunk(kind, payload=b""):
    body = kind + payload
    return struct.pack(">I", len(payload)) + body + struct.pack(">I", zlib.crc32(body))


def png(texts=(), credential=False, extra=()):
    parts = [png_chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0))]
    parts += [png_chunk(b"tEXt", k.encode() + b"\0" + v.encode()) for k, v in texts]
    parts += [png_chunk(k, v) for k, v in extra]
    if credential:
        parts.append(png_chunk(b"caBX", b"jumb"))
    parts += [png_chunk(b"IDAT", zlib.compress(b"\0\0")), png_chunk(b"IEND")]
    return PNG_MAGIC + b"".join(parts)


def segment(marker, payload):
    return bytes([0xFF, marker]) + struct.pack(">H", len(payload) + 2) + payload


def jpeg(*segments, scan=True):
    head = b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + b"".join(segments)
    return head + (segment(0xDA, b"\1\1\0\0\x3f\0") + b"\x11\x22\x33\xff\xd9" if scan else b"")


def exif(make=b"Cam\0", gps=True, order=">"):
    """An EXIF block: the camera's make, and 37.8 N, 122.41667 W."""
    pack = lambda f, *v: struct.pack(order + f, *v)
    entries = 2 if gps else 1
    heap_at = 8 + 2 + 12 * entries + 4
    make_at, gps_at = heap_at, heap_at + 16
    ifd = pack("H", entries) + pack("HHII", 0x010F, 2, len(make), make_at if len(make) > 4 else 0)[:8]
    ifd += pack("I", make_at) if len(make) > 4 else make.ljust(4, b"\0")
    if gps:
        ifd += pack("HHII", 0x8825, 4, 1, gps_at)
    ifd += pack("I", 0)
    heap = make.ljust(16, b"\0")
    if gps:
        values_at = gps_at + 2 + 12 * 4 + 4
        directory = pack("H", 4)
        directory += pack("HHI", 1, 2, 2) + b"N\0\0\0" + pack("HHII", 2, 5, 3, values_at)
        directory += pack("HHI", 3, 2, 2) + b"W\0\0\0" + pack("HHII", 4, 5, 3, values_at + 24) + pack("I", 0)
        heap += directory + pack("6I", 37, 1, 48, 1, 0, 1) + pack("6I", 122, 1, 25, 1, 0, 0)
    return b"Exif\0\0" + (b"MM\0\x2a" if order == ">" else b"II\x2a\0") + pack("I", 8) + ifd + heap


def docx(author="A. Writer", company="Acme", custom="42", parts=None):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", "<doc>text</doc>")
        for name, body in (parts or {}).items():
            z.writestr(name, body)
        z.writestr("docProps/core.xml", f'<c:p xmlns:c="c" xmlns:d="d"><d:creator>{author}</d:creator><c:revision>7</c:revision><c:other>stays</c:other></c:p>')
        z.writestr("docProps/app.xml", f'<P xmlns="e"><Company>{company}</Company><Pages>1</Pages></P>')
        if custom:
            z.writestr("docProps/custom.xml", f'<P xmlns="f"><property name="ClientCode"><v>{custom}</v></property></P>')
    return buffer.getvalue()


def pdf(info="/Author (A \\(b\\) c) /Producer <FEFF00410042> /CreationDate (D:2024)", xmp="<xmp:CreatorTool>Tool</xmp:CreatorTool>", trailer="/Info 3 0 R", content="BT (Hello) Tj ET"):
    packet = f'<?xpacket begin="" id="x"?>{xmp:<80}<?xpacket end="w"?>'
    return (
        "%PDF-1.4\n1 0 obj\n<< /Type /Catalog >>\nendobj\n"
        f"2 0 obj\n<< /Length {len(content)} >>\nstream\n{content}\nendstream\nendobj\n"
        f"3 0 obj\n<< {info} >>\nendobj\n4 0 obj\n<< /Type /Metadata >>\nstream\n{packet}\nendstream\nendobj\n"
        f"trailer\n<< /Root 1 0 R {trailer} >>\n%%EOF\n"
    ).encode("latin-1")
