"""Findings in texts: hidden characters, structure, look-alike words and comments.

All findings of an artifact are made in one projection and exploded; nothing is shuffled and, but for
normal forms, nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftglass.functions import charsets as C
from siftglass.functions.barrier import settled
from siftglass.functions.normalize import other_form

MAX_LOCATIONS = 50
MAX_COMMENTS = 25
MAX_EXCERPT = 160
MAX_EXAMPLES = 10

LOCATION = T.StructType(
    [
        T.StructField("offset", T.LongType()),
        T.StructField("line", T.LongType()),
        T.StructField("column", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("excerpt", T.StringType()),
    ]
)
FINDING = T.StructType(
    [
        T.StructField("detector", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("evidence_class", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("count", T.LongType()),
        T.StructField("locations", T.ArrayType(LOCATION)),
        T.StructField("details", T.StringType()),
        T.StructField("removable_by", T.ArrayType(T.StringType())),
    ]
)

# Class, severity (outside code), operation, names or one name.
BUCKETS = {
    "zero_width": (C.ZERO_WIDTH_CLASS, "warning", "strip_zero_width", C.ZERO_WIDTH),
    "bidi_control": (C.BIDI_CLASS, "notice", "strip_bidi_controls", C.BIDI_CONTROLS),
    "exotic_space": (C.SPACE_CLASS, "notice", "normalize_spaces", C.EXOTIC_SPACES),
    "variation_selector": (C.VARIATION_CLASS, "notice", "strip_variation_selectors", "VARIATION SELECTOR"),
    "unicode_tag_char": (C.TAG_CLASS, "warning", "strip_tag_characters", "UNICODE TAG CHARACTER"),
    "other_invisible": (C.OTHER_CLASS, "notice", "strip_other_invisible", C.OTHER_INVISIBLE),
    "control_char": (C.CONTROL_CLASS, "warning", "strip_control_characters", "CONTROL CHARACTER"),
}


def _substring(text: Column, start: Column | int, length: Column | int) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, int) else x.cast("int")
    return F.substring(text, as_column(start), as_column(length))


def location(text: Column, offset: Column, length: Column, excerpt: Column) -> Column:
    """A place in a text: lines and columns count from one and are parted by line feeds."""
    before = _substring(text, 1, offset)
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    column = F.length(F.substring_index(before, "\n", -1)) + 1
    return F.struct(
        offset.cast("long").alias("offset"),
        line.cast("long").alias("line"),
        column.cast("long").alias("column"),
        length.cast("long").alias("length"),
        excerpt.alias("excerpt"),
    )


def finding(detector: str, category: str, severity: Column | str, summary: Column | str, count: Column, locations: Column | None = None, details: Column | None = None, removable_by: list[str] | None = None, evidence_class: str = "embedded_metadata") -> Column:
    """One finding; ``details`` is JSON."""
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(
        F.lit(detector).alias("detector"),
        F.lit(category).alias("category"),
        F.lit(evidence_class).alias("evidence_class"),
        as_column(severity).alias("severity"),
        as_column(summary).alias("summary"),
        F.lit("confirmed").alias("label"),
        count.cast("long").alias("count"),
        (F.array().cast(T.ArrayType(LOCATION)) if locations is None else locations).alias("locations"),
        (F.lit("{}") if details is None else details).alias("details"),
        F.array(*[F.lit(x) for x in removable_by or []]).cast("array<string>").alias("removable_by"),
    ).cast(FINDING)


def masked(text: Column, category: str) -> Column:
    """The text in which a bucket is looked for: a byte order mark at the beginning is no zero-width character."""
    if category != "zero_width":
        return text
    return F.when(F.startswith(text, F.lit(C.BOM)), F.substring(text, 2, 2**31 - 1)).otherwise(text)


def bucket_count(text: Column, category: str) -> Column:
    """How many characters of a bucket a text has."""
    return F.regexp_count(masked(text, category), F.lit(BUCKETS[category][0])).cast("long")


def bucket_hits(text: Column, category: str) -> Column:
    """The characters of a bucket, in order."""
    return F.regexp_extract_all(masked(text, category), F.lit(BUCKETS[category][0]), F.lit(0))


def code_point(c: Column) -> Column:
    """A character's number in the usual notation."""
    return F.format_string("U+%04X", F.ascii(c))


def bucket_names(category: str, c: Column) -> Column:
    """The name under which a bucket lists a character."""
    names = BUCKETS[category][3]
    if isinstance(names, str):
        return F.lit(names)
    return F.element_at(F.create_map(*[F.lit(x) for p, n in names.items() for x in (p, n)]), F.ascii(c))


def tag_payload(hits: Column) -> Column:
    """The ASCII text that tag characters hide; empty if none of them stands for a printable one."""
    shown = F.filter(hits, lambda c: (F.ascii(c) >= 0xE0020) & (F.ascii(c) <= 0xE007E))
    return F.array_join(F.transform(shown, lambda c: F.char(F.ascii(c) - 0xE0000)), "")


def hit_offsets(text: Column, category: str, most: int = MAX_LOCATIONS) -> Column:
    """Where the first characters of a bucket stand, from zero, in code points."""
    shift = F.length(text) - F.length(masked(text, category))
    pieces = F.split(masked(text, category), BUCKETS[category][0], most + 1)
    between = F.slice(pieces, 1, F.size(pieces) - 1)
    places = F.aggregate(
        between,
        F.struct(F.lit(-1).alias("last"), F.array().cast("array<int>").alias("all")),
        lambda a, s: F.struct((a["last"] + 1 + F.length(s)).alias("last"), F.concat(a["all"], F.array(a["last"] + 1 + F.length(s))).alias("all")),
        lambda a: a["all"],
    )
    return F.transform(places, lambda p: p + shift)


def _bucket(category: str) -> Column:
    """The finding of one bucket, or null."""
    _, severity, operation, _ = BUCKETS[category]
    text, n, hits = F.col("text"), F.col(f"n_{category}"), F.col(f"hits_{category}")
    where = F.arrays_zip(hit_offsets(text, category).alias("p"), F.slice(hits, 1, MAX_LOCATIONS).alias("c"))
    locations = F.transform(
        where, lambda x: location(text, x["p"], F.lit(1), F.concat_ws(" ", code_point(x["c"]), bucket_names(category, x["c"])))
    )
    parts = [
        F.array_sort(F.array_distinct(F.transform(hits, code_point))).alias("codepoints"),
        F.array_sort(F.array_distinct(F.transform(hits, lambda c: bucket_names(category, c)))).alias("names"),
    ]
    if category == "unicode_tag_char":
        parts.append(F.nullif(tag_payload(hits), F.lit("")).alias("decoded_ascii_payload"))
    level = F.when(F.col("kind") == "source_code", "warning").otherwise(severity) if category == "bidi_control" else F.lit(severity)
    summary = F.concat(n.cast("string"), F.lit(f" {category.replace('_', ' ')} character(s) present"))
    return F.when(n > 0, finding("unicode", category, level, summary, n, locations, F.to_json(F.struct(*parts)), [operation]))


def line_ending_counts(text: Column) -> tuple[Column, Column, Column]:
    """How many CRLF, lone LF and lone CR a text has."""
    size = F.length(text)
    gone = lambda s: F.length(F.replace(text, F.lit(s), F.lit("")))
    crlf = (size - gone("\r\n")) / 2
    return tuple(x.cast("long") for x in (crlf, size - gone("\n") - crlf, size - gone("\r") - crlf))  # type: ignore[return-value]


def mixed_script_words(text: Column) -> Column:
    """Runs of letters that mix Latin with another script, in order, repetitions included.

    Coarse classes of a few ranges decide first: a text without any character that could be another script's
    letter isn't cut into runs, and a run is compared with the exact classes only if it has both kinds.
    """
    runs = F.when(text.rlike(C.MAYBE_OTHER), F.regexp_extract_all(text, F.lit(C.LETTER_RUN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    latin = C.latin_class()
    other = f"[\\p{{L}}&&[^{latin[1:-1]}]]"
    both = F.filter(runs, lambda w: w.rlike(C.MAYBE_OTHER) & w.rlike(C.MAYBE_LATIN))
    return F.filter(both, lambda w: w.rlike(other) & w.rlike(latin))


def comments(text: Column) -> Column:
    """The bodies of the markup comments of a text."""
    return F.regexp_extract_all(text, F.lit("(?s)<!--(.*?)-->"), F.lit(1))


def _comment_finding() -> Column:
    text, bodies = F.col("text"), F.col("comment_bodies")
    pieces = F.split(text, "(?s)<!--.*?-->", MAX_COMMENTS + 1)
    zipped = F.arrays_zip(F.slice(pieces, 1, F.size(pieces) - 1).alias("s"), F.slice(bodies, 1, MAX_COMMENTS).alias("b"))
    placed = F.aggregate(
        zipped,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<p:int,b:string>>").alias("all")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["s"]) + F.length(x["b"]) + 7).alias("at"),
            F.concat(a["all"], F.array(F.struct((a["at"] + F.length(x["s"])).alias("p"), x["b"].alias("b")))).alias("all"),
        ),
        lambda a: a["all"],
    )
    excerpt = lambda b: F.substring(F.regexp_replace(F.regexp_replace(b, "(?U)[\\s\\x{1C}-\\x{1F}]+", " "), "^ | $", ""), 1, MAX_EXCERPT)
    locations = F.transform(placed, lambda x: location(text, x["p"], F.length(x["b"]) + 7, excerpt(x["b"])))
    n = F.size(bodies)
    summary = F.concat(n.cast("string"), F.lit(" HTML/XML comment(s) present (not rendered, but present in the source)"))
    return F.when((F.col("kind") != "source_code") & (n > 0), finding("text_markers", "markup_comment", "info", summary, n, locations))


def with_text_findings(df: DataFrame, out: str) -> DataFrame:
    """``df`` (with ``text`` and ``kind``) with an array of findings as a column; empty for a null text.

    One look for any hidden character decides whether the seven buckets are counted, placed and named at all.
    """
    names = df.columns
    text = F.col("text")
    hidden = F.coalesce(text.rlike(C.ANY_HIDDEN), F.lit(False))
    none = F.array().cast("array<string>")
    base = df.select(
        "*",
        hidden.alias("hidden"),
        *[n.alias(a) for n, a in zip(line_ending_counts(text), ("crlf", "lf", "cr"), strict=True)],
        mixed_script_words(text).alias("mixed"),
        F.when(F.contains(text, F.lit("<!--")), comments(text)).otherwise(none).alias("comment_bodies"),
        other_form(text).alias("form"),
    )
    base = base.select("*", *[F.when(F.col("hidden"), bucket_hits(text, c)).otherwise(none).alias(f"hits_{c}") for c in BUCKETS])
    base = base.select("*", *[F.size(f"hits_{c}").cast("long").alias(f"n_{c}") for c in BUCKETS])
    one = F.lit(1)
    bom_place = F.array(location(text, F.lit(0), one, F.lit(None).cast("string")))
    styles = sum((F.when(F.col(c) > 0, 1).otherwise(0) for c in ("crlf", "lf", "cr")), F.lit(0))
    mixed = F.col("mixed")
    found = [
        *[_bucket(c) for c in BUCKETS],
        F.when(
            F.startswith(text, F.lit(C.BOM)),
            finding("unicode", "byte_order_mark", "notice", "File begins with a UTF-8 byte order mark", one, bom_place, None, ["strip_bom"]),
        ),
        F.when(
            F.col("form").isNotNull(),
            finding("unicode", "unicode_normalization", "info", "Text is not in Unicode NFC normalization form", one, None, F.to_json(F.struct(F.col("form").alias("current_form"))), ["normalize_nfc"]),
        ),
        F.when(
            styles > 1,
            finding("unicode", "mixed_line_endings", "notice", "File mixes line ending styles", one, None, F.to_json(F.struct("crlf", "lf", "cr")), ["normalize_line_endings"]),
        ),
        F.when(
            F.size(mixed) > 0,
            finding(
                "unicode",
                "mixed_script_word",
                "warning",
                F.concat(F.size(mixed).cast("string"), F.lit(" word(s) mix Latin with another script (possible homoglyphs)")),
                F.size(mixed),
                None,
                F.to_json(F.struct(F.slice(mixed, 1, MAX_EXAMPLES).alias("examples"))),
            ),
        ),
        _comment_finding(),
    ]
    every = F.when(text.isNotNull(), F.array_compact(F.array(*found))).otherwise(F.array().cast(T.ArrayType(FINDING)))
    return settled(base.select(*names, every.alias(out)))


def text_findings(artifacts: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Findings of the textual artifacts: ``artifact_id``, the columns ``keep`` and those of a finding."""
    base = artifacts.where(F.col("text").isNotNull()).select("artifact_id", *keep, "kind", "text")
    return with_text_findings(base, "f").select("artifact_id", *keep, F.explode("f").alias("f")).select("artifact_id", *keep, "f.*")
