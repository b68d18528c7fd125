"""The text operations and their profiles, as functions from column to column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftglass.functions import charsets as C
from siftglass.functions.barrier import settled, small_batches
from siftglass.functions.normalize import nfc


@dataclass(frozen=True)
class Operation:
    """One deterministic operation on text."""

    id: str
    description: str
    apply: Callable[[Column], Column] | None
    note: str | None = None
    semantics_preserving: bool = True


def _drop(pattern: str) -> Callable[[Column], Column]:
    return lambda text: F.regexp_replace(text, pattern, "")


#: A byte order mark at the beginning stays; every other one goes.
_ZERO_WIDTH = C.regex_class(set(C.ZERO_WIDTH) - {0xFEFF}) + "|(?<!^)\\x{FEFF}"


def _line_endings(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


# Ids, descriptions and notes.
OPERATIONS = {
    o.id: o
    for o in (
        Operation("strip_zero_width", "Remove zero-width and word-joiner characters", _drop(_ZERO_WIDTH)),
        Operation(
            "strip_tag_characters",
            "Remove deprecated Unicode tag characters (U+E0000-U+E007F)",
            _drop(C.TAG_CLASS),
            "These carry hidden ASCII payloads; inspect before removing.",
        ),
        Operation(
            "strip_bidi_controls",
            "Remove bidirectional formatting controls",
            _drop(C.BIDI_CLASS),
            "Removing these changes display order in genuinely right-to-left text.",
        ),
        Operation(
            "strip_variation_selectors",
            "Remove variation selectors",
            _drop(C.VARIATION_CLASS),
            "Can change emoji presentation (text vs emoji style).",
        ),
        Operation("strip_other_invisible", "Remove soft hyphens, combining grapheme joiners and blank Braille", _drop(C.OTHER_CLASS)),
        Operation("strip_control_characters", "Remove C0/C1 control characters other than tab, CR and LF", _drop(C.CONTROL_CLASS)),
        Operation(
            "normalize_spaces",
            "Replace non-standard space characters with U+0020",
            lambda t: F.regexp_replace(t, C.SPACE_CLASS, " "),
            "Changes line-breaking behaviour where NO-BREAK SPACE was intentional.",
        ),
        Operation("strip_bom", "Remove a leading UTF-8 byte order mark", _drop("^\\x{FEFF}")),
        Operation("normalize_nfc", "Normalize to Unicode NFC", nfc, "Canonical-equivalence only; NFKC (which is lossy) is not used."),
        Operation("normalize_line_endings", "Convert CRLF and CR to LF", _line_endings),
        Operation(
            "strip_trailing_whitespace",
            "Remove trailing spaces and tabs from each line",
            lambda t: F.regexp_replace(t, "(?dm)[ \\t]+$", ""),
            "In Markdown, two trailing spaces are a hard line break.",
        ),
        Operation("collapse_blank_lines", "Collapse runs of more than two blank lines", lambda t: F.regexp_replace(t, "\\n{4,}", "\n\n\n")),
        Operation("ensure_final_newline", "Ensure the file ends with a newline", lambda t: F.regexp_replace(t, "([^\\n])\\z", "$1\n")),
        Operation(
            "remove_unused_imports",
            "Remove module-level Python imports that nothing references",
            None,
            "Structural: importing a module runs its top-level code, so removing even an "
            "unreferenced import can change behaviour when it was imported for side "
            "effects. Proof-gated: the change is discarded (even under --force) unless "
            "the removal is proven to be the only difference and every removed name is "
            "unreferenced, including inside string literals.",
            False,
        ),
    )
}
_MINIMAL = [
    "strip_zero_width",
    "strip_tag_characters",
    "strip_bidi_controls",
    "strip_variation_selectors",
    "strip_other_invisible",
    "strip_control_characters",
    "strip_bom",
]
_STANDARD = [*_MINIMAL, "normalize_nfc", "normalize_spaces", "normalize_line_endings", "strip_trailing_whitespace", "ensure_final_newline"]
PROFILES = {
    "minimal": _MINIMAL,
    "standard": _STANDARD,
    "code": ["remove_unused_imports", *_STANDARD],
    "tidy": [*_STANDARD[:-1], "collapse_blank_lines", "ensure_final_newline"],
}


def resolve_operations(profile: str | None = None, operations: list[str] | None = None) -> list[Operation]:
    """The operations of an explicit list, in its order, or else of a profile (``standard`` by default)."""
    if not operations:
        name = profile or "standard"
        if name not in PROFILES:
            raise KeyError(f"unknown profile '{name}'; choose from {', '.join(sorted(PROFILES))}")
        operations = PROFILES[name]
    if unknown := sorted({o for o in operations if o not in OPERATIONS}):
        raise KeyError(f"unknown operation(s): {', '.join(unknown)}")
    return [OPERATIONS[o] for o in operations]


def cleaned(text: Column, operation: str) -> Column:
    """A text after one operation."""
    (o,) = resolve_operations(None, [operation])
    if o.apply is None:
        raise ValueError(f"{operation} is no operation on plain text")
    return o.apply(text)


def with_cleaned(df: DataFrame, text: str, out: str, profile: str | None = None, operations: list[str] | None = None) -> DataFrame:
    """``df`` with a column ``out``: the text after all text operations of a profile or list.

    Each operation gets a column of its own: nested in one expression, those that name their input several
    times would multiply.
    """
    df = small_batches(df).withColumn(out, F.col(text))
    for o in resolve_operations(profile, operations):
        if o.apply is not None:
            df = df.withColumn(out, o.apply(F.col(out)))
    return settled(df)
