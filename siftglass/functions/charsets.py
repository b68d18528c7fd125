"""Classes of code points, as regular-expression classes that Java and RE2 both read.

Detectors and cleaners share them, so what is found is what is removed.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

BOM = "\ufeff"

# The named characters of each class.
ZERO_WIDTH = {
    0x200B: "ZERO WIDTH SPACE",
    0x200C: "ZERO WIDTH NON-JOINER",
    0x200D: "ZERO WIDTH JOINER",
    0x2060: "WORD JOINER",
    0x180E: "MONGOLIAN VOWEL SEPARATOR",
    0xFEFF: "ZERO WIDTH NO-BREAK SPACE (BOM)",
}
BIDI_CONTROLS = {
    0x202A: "LEFT-TO-RIGHT EMBEDDING",
    0x202B: "RIGHT-TO-LEFT EMBEDDING",
    0x202C: "POP DIRECTIONAL FORMATTING",
    0x202D: "LEFT-TO-RIGHT OVERRIDE",
    0x202E: "RIGHT-TO-LEFT OVERRIDE",
    0x2066: "LEFT-TO-RIGHT ISOLATE",
    0x2067: "RIGHT-TO-LEFT ISOLATE",
    0x2068: "FIRST STRONG ISOLATE",
    0x2069: "POP DIRECTIONAL ISOLATE",
    0x061C: "ARABIC LETTER MARK",
    0x200E: "LEFT-TO-RIGHT MARK",
    0x200F: "RIGHT-TO-LEFT MARK",
}
EXOTIC_SPACES = {
    0x00A0: "NO-BREAK SPACE",
    0x1680: "OGHAM SPACE MARK",
    0x2000: "EN QUAD",
    0x2001: "EM QUAD",
    0x2002: "EN SPACE",
    0x2003: "EM SPACE",
    0x2004: "THREE-PER-EM SPACE",
    0x2005: "FOUR-PER-EM SPACE",
    0x2006: "SIX-PER-EM SPACE",
    0x2007: "FIGURE SPACE",
    0x2008: "PUNCTUATION SPACE",
    0x2009: "THIN SPACE",
    0x200A: "HAIR SPACE",
    0x202F: "NARROW NO-BREAK SPACE",
    0x205F: "MEDIUM MATHEMATICAL SPACE",
    0x3000: "IDEOGRAPHIC SPACE",
}
OTHER_INVISIBLE = {
    0x00AD: "SOFT HYPHEN",
    0x034F: "COMBINING GRAPHEME JOINER",
    0x2800: "BRAILLE PATTERN BLANK",
}


def regex_class(points: object) -> str:
    """A bracket expression for code points, with runs written as ranges."""
    runs: list[list[int]] = []
    for p in sorted(points):  # type: ignore[call-overload]
        if runs and runs[-1][1] == p - 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "[" + "".join(f"\\x{{{a:X}}}" + (f"-\\x{{{b:X}}}" if b > a else "") for a, b in runs) + "]"


ZERO_WIDTH_CLASS = regex_class(ZERO_WIDTH)
BIDI_CLASS = regex_class(BIDI_CONTROLS)
SPACE_CLASS = regex_class(EXOTIC_SPACES)
OTHER_CLASS = regex_class(OTHER_INVISIBLE)
VARIATION_CLASS = "[\\x{FE00}-\\x{FE0F}\\x{E0100}-\\x{E01EF}]"
TAG_CLASS = "[\\x{E0000}-\\x{E007F}]"
CONTROL_CLASS = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]"
#: Any character of the seven classes.
ANY_HIDDEN = "[" + "".join(c[1:-1] for c in (ZERO_WIDTH_CLASS, BIDI_CLASS, SPACE_CLASS, OTHER_CLASS, VARIATION_CLASS, TAG_CLASS, CONTROL_CLASS)) + "]"
#: Coarse classes of few ranges that hold every letter of another script, and every one whose name is Latin.
MAYBE_OTHER = "[\\x{AA}\\x{B5}\\x{BA}\\x{250}-\\x{10FFFF}]"
MAYBE_LATIN = "[A-Za-z\\x{AA}-\\x{2AF}\\x{1D00}-\\x{1EFF}\\x{2071}-\\x{2184}\\x{2C60}-\\x{2C7F}\\x{A722}-\\x{AB6F}\\x{FB00}-\\x{FB06}\\x{FF21}-\\x{FF5A}\\x{10780}-\\x{107BF}\\x{1DF00}-\\x{1DFFF}]"
#: Runs of two or more letters and letter-like numbers.
LETTER_RUN = "[\\p{L}\\p{Nl}\\p{No}]{2,}"
#: Texts below U+0300 are in every composed normal form's fixed set.
COMPOSED = "^[\\x{0}-\\x{2FF}]*$"


@functools.cache
def format_and_control_class() -> str:
    """Format and control characters other than line feed and tab, by their general category."""
    points = [p for p in range(sys.maxunicode + 1) if p not in (9, 10) and unicodedata.category(chr(p)) in ("Cf", "Cc")]
    return regex_class(points)


#: A class of few ranges that holds every format and control character: most letters are told by it alone.
MAYBE_CONTROL = "[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x9F\\x{AD}\\x{600}-\\x{10FFFF}]"


@functools.cache
def latin_class() -> str:
    """Letters whose Unicode name begins with the word LATIN."""
    return regex_class(p for p in range(sys.maxunicode + 1) if chr(p).isalpha() and unicodedata.name(chr(p), "").split(" ")[0] == "LATIN")


@functools.cache
def other_letter_class() -> str:
    """Named letters of any other script, as ranges (for engines without class intersection)."""
    return regex_class(
        p for p in range(sys.maxunicode + 1) if chr(p).isalpha() and unicodedata.name(chr(p), "LATIN").split(" ")[0] != "LATIN"
    )
