"""What a reader is shown: hidden characters as labels in their place, and plain words for categories and severities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The label of each hidden character, as a class of code points.
LABELS = {
    "ZWSP": r"\x{200B}",
    "ZWNJ": r"\x{200C}",
    "ZWJ": r"\x{200D}",
    "WJ": r"\x{2060}",
    "BOM": r"\x{FEFF}",
    "LRM": r"\x{200E}",
    "RLM": r"\x{200F}",
    "BIDI": r"\x{202A}-\x{202E}\x{2066}-\x{2069}",
    "SHY": r"\x{AD}",
    "CGJ": r"\x{34F}",
    "BRAILLE": r"\x{2800}",
    "TAG": r"\x{E0000}-\x{E007F}",
    "VS": r"\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}",
    "NBSP": r"\x{A0}",
    "SPACE": r"\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}",
    "CTRL": r"\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{7F}-\x{9F}",
}
# Titles of categories and wording of severities.
TITLES = {
    "zero_width": "Invisible characters",
    "unicode_tag_char": "Hidden message characters",
    "bidi_control": "Text-direction controls",
    "exotic_space": "Disguised spaces",
    "other_invisible": "Hidden formatting marks",
    "variation_selector": "Invisible symbol modifiers",
    "control_char": "Machine control characters",
    "byte_order_mark": "Hidden file marker",
    "mixed_script_word": "Look-alike letters",
    "unicode_normalization": "Non-standard letterforms",
    "mixed_line_endings": "Mixed line breaks",
    "markup_comment": "Hidden comments",
    "c2pa_manifest": "Content credentials",
    "png_metadata": "Hidden image info",
    "jpeg_metadata": "Hidden image info",
    "svg_metadata": "Hidden image info",
    "file_metadata": "Hidden file info",
    "pdf_info_dictionary": "Hidden document info",
    "pdf_xmp_metadata": "Hidden document info (XMP)",
}
SEVERITY_WORDS = {"warning": "Worth removing", "notice": "Unusual", "info": "Good to know"}

ANY_LABELLED = f"[{''.join(LABELS.values())}]"
OPEN, CLOSE = "⟦", "⟧"


def revealed(text: Column) -> Column:
    """The text with a bracketed label in place of each hidden character; null for null.

    One look decides whether the labels are tried at all.
    """
    out = text
    for label, points in LABELS.items():
        out = F.regexp_replace(out, f"[{points}]", f"{OPEN}{label}{CLOSE}")
    return F.when(text.rlike(ANY_LABELLED), out).otherwise(text)


def labelled(text: Column) -> Column:
    """How many hidden characters of each label a text has, as an array of ``label, n`` without zeros."""
    counts = F.array(*[F.struct(F.lit(label).alias("label"), F.regexp_count(text, F.lit(f"[{points}]")).cast("long").alias("n")) for label, points in LABELS.items()])
    return F.when(text.rlike(ANY_LABELLED), F.filter(counts, lambda c: c["n"] > 0)).otherwise(F.array().cast("array<struct<label:string,n:bigint>>"))


def _looked_up(names: dict[str, str], key: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), key), key)


def title(category: Column) -> Column:
    """A category in plain words; one without a title keeps its name."""
    return _looked_up(TITLES, category)


def severity_words(severity: Column) -> Column:
    """A severity in plain words."""
    return _looked_up(SEVERITY_WORDS, severity)
