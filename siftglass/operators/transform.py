"""Transformations: every artifact goes one route, and its output is kept only if that route's checks accept it."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from siftglass.functions import images, office, pdfs, pycode
from siftglass.functions.barrier import settled, small_batches
from siftglass.functions.cleaning import Operation, resolve_operations
from siftglass.functions.normalize import nfc
from siftglass.functions.visible import STRUCTURE, change_count, edit_counts, skeleton, structure_count, without_controls
from siftglass.operators.artifacts import is_pdf
from siftglass.operators.checks import CHECKS, MIN_SIMILARITY, all_passed, failed_names, with_text_checks

# Why a change is refused.
UNPROVEN = (
    "Refusing to write transformed source code whose behaviour could not be proven "
    "unchanged. No structural validator was available for this language in this "
    "environment (compile/test-based validation is planned). Re-run with --force to "
    "write it anyway; the report will record that semantic preservation was not proven."
)
CHANGED = (
    "Refusing to write transformed source code that provably changed the program "
    "(the abstract syntax tree differs - a change landed inside a string or another "
    "semantic node). Re-run with --force to write it anyway."
)
BROKEN = "Transformed source code no longer parses; refusing to write broken code. This is never overridable."
ENCRYPTED = "encrypted PDF: its strings cannot be safely rewritten, so nothing was changed"
UNSUPPORTED = "unsupported binary type; only PNG and JPEG metadata stripping is implemented"
SVG_PATTERNS = (
    r"(?is)<metadata\b.*?</metadata\s*>",
    r"(?i)<metadata\b[^>]*/>",
    r"(?is)<x:xmpmeta\b.*?</x:xmpmeta\s*>",
    r"(?is)<\?xpacket\b.*?\?>",
)
DRAWN = ("path", "rect", "circle", "g", "polygon")

OPERATION = T.StructType(
    [
        T.StructField("operation", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("semantics_preserving", T.BooleanType()),
        T.StructField("applied", T.BooleanType()),
        T.StructField("changes", T.LongType()),
        T.StructField("details", T.StringType()),
    ]
)


def result_schema(key: T.DataType) -> T.StructType:
    """The columns of a transformed artifact."""
    return T.StructType(
        [
            T.StructField("artifact_id", key),
            T.StructField("route", T.StringType()),
            T.StructField("performed", T.BooleanType()),
            T.StructField("accepted", T.BooleanType()),
            T.StructField("rejected_reason", T.StringType()),
            T.StructField("operations", T.ArrayType(OPERATION)),
            T.StructField("checks", CHECKS),
            T.StructField("all_passed", T.BooleanType()),
            T.StructField("output", T.BinaryType()),
            T.StructField("output_sha256", T.StringType()),
            T.StructField("output_size_bytes", T.LongType()),
        ]
    )


@dataclass(frozen=True)
class Options:
    """What to apply and how strict to be.  ``changes`` counts edits, which compares texts step by step."""

    profile: str | None = None
    operations: tuple[str, ...] | None = None
    min_similarity: float = MIN_SIMILARITY
    force_code: bool = False
    changes: bool = True


_CHECKS_KIND = to_arrow_type(CHECKS)
_PRUNED = T.StructType([T.StructField("text", T.StringType()), T.StructField("failing", T.StringType()), T.StructField("checks", CHECKS)])


_PRUNED_KIND = to_arrow_type(_PRUNED)


@F.arrow_udf(_PRUNED)
def _pruned(sources: pa.Array) -> pa.Array:
    """Sources without unused imports where that is proven; else why not."""
    out: list[dict[str, object]] = []
    for source in sources.to_pylist():
        if source is None:
            out.append({"checks": []})
            continue
        fresh = pycode.without_unused_imports(source)
        proof = pycode.removal_checks(source, fresh) if fresh != source else []
        failing = "; ".join(n for n, passed in proof if passed is not True)
        checks = [] if failing else [{"name": n, "passed": p, "measurements": "{}"} for n, p in proof]
        out.append({"text": source if failing else fresh, "failing": failing or None, "checks": checks})
    return pa.array(out, _PRUNED_KIND)


@F.arrow_udf(CHECKS)
def _code_checks(before: pa.Array, after: pa.Array, language: pa.Array) -> pa.Array:
    def one(a: str | None, b: str | None, name: str | None) -> list[dict[str, object]] | None:
        if a is None or b is None:
            return None
        return [{"name": n, "passed": p, "measurements": json.dumps({"language": name})} for n, p in pycode.code_checks(a, b, name)]

    return pa.array([one(*x) for x in zip(before.to_pylist(), after.to_pylist(), language.to_pylist(), strict=True)], _CHECKS_KIND)


def _passed(checks: Column, name: str) -> Column:
    return F.get(F.filter(checks, lambda c: c["name"] == name), 0)["passed"]


def _operation(o: Operation, before: Column, after: Column, edits: Column | None, details: Column | None = None) -> Column:
    changes = F.when(before == after, F.lit(0).cast("long")) if edits is None else change_count(before, after, edits)
    details = F.lit(json.dumps({"note": o.note} if o.note else {})) if details is None else details
    return F.struct(F.lit(o.id), F.lit(o.description), F.lit(o.semantics_preserving), before != after, changes, details)


def transform_text(artifacts: DataFrame, options: Options = Options(), keep: tuple[str, ...] = ()) -> DataFrame:
    """The text route: imports first (Python only, each removal proven), then the operations in order, then the checks.

    Columns ``keep`` go along and come out last.
    """
    chosen = resolve_operations(options.profile, list(options.operations) if options.operations else None)
    structural = [o for o in chosen if o.apply is None]
    plain = [o for o in chosen if o.apply is not None]
    df = artifacts.where(F.col("text").isNotNull()).select("artifact_id", "kind", "language", "data", *keep, F.col("text").alias("t0"))
    done: list[tuple[Operation, str, str, Column | None]] = []
    if structural:
        python = F.col("language") == "python"
        df = df.withColumn("pruned", _pruned(F.when(python, F.col("t0"))))
        df = df.withColumn("mid", F.when(python, F.col("pruned.text")).otherwise(F.col("t0")))
        o = structural[0]
        why = (
            F.when(~F.coalesce(python, F.lit(False)), F.to_json(F.struct(F.lit(o.note).alias("note"), F.lit("structural operations are implemented for Python only").alias("skipped"))))
            .when(F.col("pruned.failing").isNotNull(), F.to_json(F.struct(F.lit(o.note).alias("note"), F.concat(F.lit("the change could not be proven safe and was not applied (not overridable with --force); failing: "), F.col("pruned.failing")).alias("discarded"))))
            .otherwise(F.to_json(F.struct(F.lit(o.note).alias("note"))))
        )
        done.append((o, "t0", "mid", why))
        proofs = F.coalesce(F.col("pruned.checks"), F.array().cast(CHECKS))
    else:
        df = df.withColumn("mid", F.col("t0"))
        proofs = F.array().cast(CHECKS)
    df = df.withColumn("proofs", proofs)
    last = "mid"
    for k, o in enumerate(plain, 1):
        assert o.apply is not None
        df = df.withColumn(f"t{k}", o.apply(F.col(last)))
        done.append((o, last, f"t{k}", None))
        last = f"t{k}"
    code = F.col("kind") == "source_code"
    # What Python tells of the settled texts is asked for at once: each further question would be a process a task.
    asked = {
        "code_checks": F.coalesce(_code_checks(F.when(code, F.col("mid")), F.when(code, F.col(last)), F.col("language")), F.array().cast(CHECKS)),
        "_cb": nfc(F.col("mid")),
        "_ca": nfc(F.col(last)),
    }
    if options.changes:
        asked["edits"] = edit_counts([(F.col(a), F.col(b)) for _, a, b, _ in done])
    df = settled(small_batches(df)).withColumns(asked)
    steps = [_operation(o, F.col(a), F.col(b), F.get("edits", F.lit(k)) if options.changes else None, why) for k, (o, a, b, why) in enumerate(done)]
    df = df.withColumn("operations", F.array(*steps).cast(T.ArrayType(OPERATION)))
    df = settled(df.select("artifact_id", "kind", "language", "data", *keep, "mid", F.col(last).alias("final"), "proofs", "operations", "code_checks", "_cb", "_ca"))
    df = with_text_checks(df, "mid", "final", options.min_similarity, ("_cb", "_ca"))
    df = df.withColumn("text_ok", F.coalesce(all_passed(F.col("text_checks")), F.lit(True)))
    df = df.withColumn("checks", F.concat("proofs", "code_checks", "text_checks"))
    parses, kept = _passed(F.col("code_checks"), "code_parses_after"), _passed(F.col("code_checks"), "code_semantics_preserved")
    force = F.lit(options.force_code)
    broken, proven, changed = F.coalesce(~parses, F.lit(False)), F.coalesce(kept, F.lit(False)) & F.col("text_ok"), F.coalesce(~kept, F.lit(False))
    accepted = F.when(~code, F.col("text_ok")).when(broken, F.lit(False)).when(proven, F.lit(True)).otherwise(force)
    verdict = F.when(~code, all_passed(F.col("text_checks"))).when(broken, F.lit(False)).when(proven, F.lit(True)).when(changed, F.lit(False))
    reason = (
        F.when(F.col("accepted"), F.lit(None).cast("string"))
        .when(~code, F.concat(F.lit("validation failed: "), failed_names(F.col("checks"))))
        .when(broken, BROKEN)
        .when(changed, CHANGED)
        .otherwise(UNPROVEN)
    )
    df = df.withColumn("accepted", accepted)
    output = F.when(F.col("accepted"), F.col("final").cast("binary"))
    return df.select(
        "artifact_id",
        F.lit("text").alias("route"),
        F.lit(True).alias("performed"),
        "accepted",
        reason.alias("rejected_reason"),
        "operations",
        "checks",
        verdict.alias("all_passed"),
        F.coalesce(output, F.col("data")).alias("output"),
        F.sha2(output, 256).alias("output_sha256"),
        F.octet_length(output).cast("long").alias("output_size_bytes"),
        *keep,
    )


Step = tuple[str, str, bytes, int, dict[str, object], list[tuple[str, bool | None, dict[str, object]]]]


def _image(data: bytes) -> Step | str:
    if data.startswith(images.PNG_MAGIC):
        kind, (fresh, gone) = "png", images.strip_png(data)
    elif data.startswith(images.JPEG_MAGIC):
        kind, (fresh, gone) = "jpeg", images.strip_jpeg(data)
    else:
        return UNSUPPORTED
    old, new = images.pixel_digest(data), images.pixel_digest(fresh)
    checks: list[tuple[str, bool | None, dict[str, object]]] = [
        ("image_parses_after", bool(new), {}),
        ("pixel_data_identical", bool(new) and old == new, {"digest_before": old, "digest_after": new}),
    ]
    if new is None:
        checks = [("image_recognized", None, {})]
    description = f"Remove metadata chunks/segments from the {kind} container"
    return "strip_image_metadata", description, fresh, len(data) - len(fresh), {"removed": gone, "container": kind}, checks


def _office(data: bytes) -> Step | str:
    fresh, gone = office.strip_office(data)
    kind = office.office_kind(data)
    readable, old, new = office.is_office(fresh), office.content_parts(data), office.content_parts(fresh)
    same: bool | None = None
    measured: dict[str, object] = {}
    if readable and old is not None and new is not None:
        same = old == new
        measured = {
            "content_parts": len(old),
            "changed_parts": sorted(n for n in old.keys() & new.keys() if old[n] != new[n])[:10],
            "added_or_removed_parts": sorted(old.keys() ^ new.keys())[:10],
        }
    checks = [("office_parses_after", readable, {}), ("document_content_identical", same, measured)]
    description = f"Remove author/company/custom metadata from the {kind} document"
    return "strip_office_metadata", description, fresh, len(data) - len(fresh), {"removed_parts": gone, "container": kind}, checks


def outside_spans(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The bytes outside sorted spans."""
    starts = [0, *[b for _, b in spans]]
    return b"".join(data[a:b] for a, b in zip(starts, [*[a for a, _ in spans], len(data)], strict=True))


def pdf_checks(before: bytes, after: bytes) -> list[tuple[str, bool | None, dict[str, object]]]:
    """The checks of a PDF: same size, both ends there, and nothing changed outside its metadata."""
    same_size = len(before) == len(after)
    spans = pdfs.Layout.of(before).spans()
    confined = outside_spans(before, spans) == outside_spans(after, spans) if same_size else None
    return [
        ("pdf_size_unchanged", same_size, {"before_bytes": len(before), "after_bytes": len(after)}),
        ("pdf_header_and_eof_intact", after.startswith(b"%PDF-") and b"%%EOF" in after, {}),
        ("pdf_changes_confined_to_metadata", confined, {"metadata_regions": len(spans)} if same_size else {}),
    ]


def _pdf(data: bytes) -> Step | str:
    layout = pdfs.Layout.of(data)
    if layout.encrypted:
        return ENCRYPTED
    fresh, gone = layout.blanked()
    changes = sum(x != y for a, b in layout.spans() for x, y in zip(data[a:b], fresh[a:b], strict=True))
    note = "values are blanked in place rather than deleted, so the file size and structure are exactly preserved"
    description = "Blank the information-dictionary values and XMP packets in place, preserving every byte offset"
    return "strip_pdf_metadata", description, fresh, changes, {"removed": gone, "note": note}, pdf_checks(data, fresh)


def _svg(data: bytes) -> Step | str:
    before = data.decode()
    after, blocks = before, 0
    for pattern in SVG_PATTERNS:
        after, n = re.subn(pattern, "", after)
        blocks += n
    try:
        ElementTree.fromstring(after)
        parses = True
    except ElementTree.ParseError:
        parses = False
    drawn = lambda text: sum(text.count(f"<{tag}") for tag in DRAWN)
    checks = [("svg_parses_after", parses, {}), ("drawing_elements_preserved", drawn(before) == drawn(after), {})]
    description = "Remove <metadata>, XMP and xpacket blocks from SVG"
    return "strip_svg_metadata", description, after.encode(), len(before) - len(after), {"blocks_removed": blocks}, checks


def _container(data: bytes, route: str) -> dict[str, object]:
    """One container's transformation; a file that breaks its reader is refused, not an error of the job."""
    if route == "binary":
        route = "office" if office.is_office(data) else "image"
    try:
        step = {"pdf": _pdf, "office": _office, "image": _image, "svg": _svg}[route](data)
    except Exception as problem:  # noqa: BLE001
        step = f"unreadable {route}: {type(problem).__name__}: {problem}"
    out: dict[str, object] = {"route": route, "performed": False, "accepted": False, "operations": [], "checks": [], "output": data}
    if isinstance(step, str):
        return out | {"rejected_reason": step}
    operation, description, fresh, changes, details, checks = step
    decided = [c[1] for c in checks if c[1] is not None]
    passed = all(decided) if decided else None
    out |= {
        "performed": True,
        "accepted": passed is True,
        "all_passed": passed,
        "operations": [
            {
                "operation": operation,
                "description": description,
                "semantics_preserving": True,
                "applied": fresh != data,
                "changes": changes,
                "details": json.dumps(details, ensure_ascii=False),
            }
        ],
        "checks": [{"name": n, "passed": p, "measurements": json.dumps(m)} for n, p, m in checks],
    }
    if passed:
        return out | {"output": fresh, "output_size_bytes": len(fresh)}
    return out | {"rejected_reason": f"{route} validation failed: " + "; ".join(n for n, p, _ in checks if p is False)}


_TRANSFORMED = T.StructType([f for f in result_schema(T.NullType()) if f.name not in ("artifact_id", "output_sha256")])
_TRANSFORMED_KIND = to_arrow_type(_TRANSFORMED)


@F.arrow_udf(_TRANSFORMED)
def _transformed(data: pa.Array, way: pa.Array) -> pa.Array:
    return pa.array([_container(d.as_py(), w.as_py()) for d, w in zip(data, way, strict=True)], _TRANSFORMED_KIND)


def route(df: DataFrame) -> DataFrame:
    """``df`` with the route of each artifact: PDF by signature first, then binary data, drawings, text."""
    way = (
        F.when(is_pdf(F.col("data")), "pdf")
        .when(F.col("kind") == "binary", "binary")
        .when((F.col("media_type") == "image/svg+xml") & F.col("text").isNotNull(), "svg")
        .otherwise("text")
    )
    return df.withColumn("route", way)


def transform_containers(routed: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The container routes, in small Arrow batches; columns ``keep`` go along."""
    schema = result_schema(routed.schema["artifact_id"].dataType)
    done = small_batches(routed).select("artifact_id", *keep, _transformed("data", "route").alias("_done")).select("artifact_id", *keep, "_done.*")
    return done.withColumn("output_sha256", F.when(F.col("accepted"), F.sha2("output", 256))).select(*schema.names, *keep)


def transform(artifacts: DataFrame, options: Options = Options(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Every artifact transformed: one row each, the output being the original unless it was accepted.

    Columns ``keep`` go along with their row.
    """
    routed = route(artifacts)
    text = transform_text(routed.where("route = 'text'"), options, keep)
    return text.unionByName(transform_containers(routed.where("route <> 'text'"), keep))


def accepted_profiles(artifacts: DataFrame, profiles: tuple[str, ...]) -> DataFrame:
    """``artifact_id, profile, accepted`` of each text artifact (no source code) and profile, in one pass.

    Operations that profiles share at their beginning are applied once, and so is what the text before them looks like.
    A text whose skeleton and structure stay the same passes every check, and no other is accepted, so words
    are never compared.
    """
    text = small_batches(artifacts).where(F.col("text").isNotNull() & (F.col("kind") != "source_code")).select("artifact_id", F.col("text").alias("t"))
    made: dict[tuple[str, ...], str] = {(): "t"}
    ends: dict[str, str] = {}
    for profile in profiles:
        ids = [o.id for o in resolve_operations(profile) if o.apply is not None]
        for k in range(1, len(ids) + 1):
            if tuple(ids[:k]) not in made:
                name = made[tuple(ids[:k])] = f"t{len(made)}"
                step = resolve_operations(None, [ids[k - 1]])[0]
                assert step.apply is not None
                text = text.withColumn(name, step.apply(F.col(made[tuple(ids[: k - 1])])))
        ends[profile] = made[tuple(ids)]
    sides = list(dict.fromkeys(["t", *ends.values()]))
    text = settled(text.select("artifact_id", *sides))
    text = settled(text.select("*", *[nfc(F.col(s)).alias(f"{s}_c") for s in sides]))
    text = settled(text.select("artifact_id", *[skeleton(F.col(f"{s}_c")).alias(f"{s}_s") for s in sides], *[without_controls(F.col(s)).alias(f"{s}_v") for s in sides]))
    counted = [F.struct(*[structure_count(F.col(f"{s}_v"), n).alias(n) for n in STRUCTURE]).alias(f"{s}_n") for s in sides]
    text = settled(text.select("artifact_id", *[f"{s}_s" for s in sides], *counted))
    same = lambda s: (F.col(f"{s}_s") == F.col("t_s")) & (F.col(f"{s}_n") == F.col("t_n"))
    each = F.array(*[F.struct(F.lit(p).alias("profile"), same(s).alias("accepted")) for p, s in ends.items()])
    return text.select("artifact_id", F.explode(each).alias("e")).select("artifact_id", "e.*")
