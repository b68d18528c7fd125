"""Reports: one nested row per artifact, as JSON or text, and what a batch adds up to."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftglass.functions.cleaning import OPERATIONS, PROFILES
from siftglass.operators.inspect import SEVERITIES, Detector, inspectors, severity_rank, with_findings, with_provenance
from siftglass.operators.transform import Options, route, transform_containers, transform_text

SCHEMA_VERSION = "1.0"
TOOL_VERSION = "0.1.0"
EXIT_OK, EXIT_FINDINGS, EXIT_ERROR = 0, 1, 2
MARKS = {"info": " i", "notice": " *", "warning": " !"}
DISCLAIMER = (
    "Nothing here tells who wrote an artifact, and finding nothing doesn't tell that a person did. What no public "
    "detector can check is listed as unknown signals."
)


def analyze(artifacts: DataFrame, options: Options | None = None, extra: Sequence[Detector] = ()) -> DataFrame:
    """One row per artifact: its reference, findings, detectors, provenance and, with options, transformation.

    Detectors ``extra`` run beside the others and are told of after them. Each row is worked on by itself, so rows that share an id are artifacts of their own.
    """
    columns = [c for c in artifacts.columns if c not in ("data", "text")]

    def told(part: DataFrame, keep: list[str]) -> tuple[DataFrame, list[Column | str]]:
        out = with_provenance(with_findings(part, [*columns, *keep], extra))
        order = F.array_sort(F.transform("findings", lambda f: F.struct(f["detector"], f["category"], f.alias("f"))))
        out = out.withColumn("findings", F.transform(order, lambda x: x["f"])).withColumn("inspectors", F.concat(inspectors(F.col("kind"), F.col("textual"), F.col("statuses")), "extra_statuses"))
        return out, [*columns, "findings", "known_signals", "unknown_signals", "confidence", "notes", "inspectors", F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(TOOL_VERSION).alias("tool_version")]

    if options is None:
        out, names = told(artifacts, [])
        return out.select(*names)
    routed = route(artifacts)
    done: list[DataFrame] = []
    for way, change in (("route = 'text'", lambda df: transform_text(df, options, ("_report",))), ("route <> 'text'", lambda df: transform_containers(df, ("_report",)))):
        out, names = told(routed.where(way), ["data", "text", "route"])
        changed = change(out.select("artifact_id", "kind", "language", "route", "data", "text", F.struct(*names).alias("_report")))
        done.append(changed.select("_report.*", *[c for c in changed.columns if c not in ("_report", "artifact_id")]))
    return done[0].unionByName(done[1])


REFERENCE = ("path", "kind", "language", "media_type", "sha256", "size_bytes", "encoding", "decoded")


def nested(reports: DataFrame) -> DataFrame:
    """Reports in their saved shape: artifact, inspection, transformation and validation as structs."""
    done = "performed" in reports.columns
    pick = lambda *names: F.struct(*names) if done else F.lit(None).cast(_EMPTY[names[1]])
    told = F.struct(F.col("known_signals").alias("known_signals_detected"), "unknown_signals", "confidence", "notes")
    return reports.select(
        "artifact_id",
        "schema_version",
        "tool_version",
        F.struct(*REFERENCE).alias("artifact"),
        F.struct("findings", "inspectors", told.alias("provenance")).alias("inspection"),
        pick("performed", "accepted", "rejected_reason", "operations", "output_sha256", "output_size_bytes").alias("transformation"),
        pick("performed", "all_passed", "checks").alias("validation"),
    )


_OPERATION = "operation:string,description:string,semantics_preserving:boolean,applied:boolean,changes:bigint,details:string"
_EMPTY = {
    "accepted": f"struct<performed:boolean,accepted:boolean,rejected_reason:string,operations:array<struct<{_OPERATION}>>,output_sha256:string,output_size_bytes:bigint>",
    "all_passed": "struct<performed:boolean,all_passed:boolean,checks:array<struct<name:string,passed:boolean,measurements:string>>>",
}


def as_json(reports: DataFrame) -> DataFrame:
    """``artifact_id, report``: each report as one JSON object, without the output's bytes."""
    shaped = nested(reports)
    return shaped.select("artifact_id", F.to_json(F.struct(*shaped.columns[1:])).alias("report"))


def read_reports(spark: SparkSession, path: str, key: str = "bigint") -> DataFrame:
    """Saved reports (one JSON object a line) in their saved shape; a line that is no report is an error."""
    from siftglass.operators.artifacts import artifacts_from_binary

    none = artifacts_from_binary(spark.createDataFrame([], f"id {key}, data binary"), "id", "data")
    schema = nested(analyze(none, Options())).drop("artifact_id").schema
    return spark.read.text(path).select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def batch_summary(reports: DataFrame) -> DataFrame:
    """One row: how many artifacts, with findings, without anything to show."""
    dirty = F.size("findings") > 0
    shown = dirty | F.col("performed") if "performed" in reports.columns else dirty
    number = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return reports.agg(F.count("*").alias("artifacts"), number(dirty).alias("with_findings"), number(~shown).alias("hidden"))


def exit_code(reports: DataFrame, fail_on: str = "never", errors: int = 0) -> int:
    """2 after errors, 1 if a finding reaches a severity or an output was rejected, else 0."""
    if errors:
        return EXIT_ERROR
    if fail_on != "never" and fail_on not in SEVERITIES:
        return EXIT_ERROR if reports.limit(1).count() else EXIT_OK
    hit = F.lit(False)
    if fail_on != "never":
        hit = F.exists("findings", lambda f: severity_rank(f["severity"]) >= SEVERITIES[fail_on])
    if "accepted" in reports.columns:
        hit = hit | ~F.col("accepted")
    return EXIT_FINDINGS if reports.where(hit).limit(1).count() else EXIT_OK


def rendered(reports: DataFrame) -> DataFrame:
    """``artifact_id, block``: the text of each report, made in Spark."""
    head = F.concat(F.lit("artifact   "), F.coalesce("path", F.lit("<stdin>")), F.lit("\n           kind="), "kind", F.lit("\n           sha256="), "sha256", F.lit("  size="), F.col("size_bytes").cast("string"), F.lit("B"))
    mark = F.create_map(*[F.lit(x) for p in MARKS.items() for x in p])
    lines = F.transform(
        "findings",
        lambda f: F.concat(F.element_at(mark, f["severity"]), F.lit(" ["), f["evidence_class"], F.lit("] "), f["category"], F.lit(": "), f["summary"], F.when(F.size(f["removable_by"]) > 0, F.concat(F.lit("\n      removable by: "), F.array_join(f["removable_by"], ", "))).otherwise("")),
    )
    found = F.when(F.size("findings") > 0, F.concat(F.lit("findings ("), F.size("findings").cast("string"), F.lit(")\n"), F.array_join(lines, "\n"))).otherwise("findings   none")
    unknown = F.array_join(F.transform("unknown_signals", lambda s: F.concat(F.lit("\n   unknown signal: "), s)), "")
    notes = F.array_join(F.transform("notes", lambda n: F.concat(F.lit("\n   note: "), n)), "")
    tail = F.concat(F.lit("provenance confidence="), "confidence", unknown, notes)
    return reports.select("artifact_id", F.concat(head, F.lit("\n\n"), found, F.lit("\n\n"), tail).alias("block"))


def operations(spark: SparkSession) -> DataFrame:
    """The operations and the profiles that use them."""
    rows = [(o.id, o.description, o.semantics_preserving, o.note, [p for p, ids in PROFILES.items() if o.id in ids]) for o in OPERATIONS.values()]
    return spark.createDataFrame(rows, "operation string, description string, semantics_preserving boolean, note string, profiles array<string>")


def build_result(spark: SparkSession, name: str, data: bytes, mode: str = "inspect", profile: str = "standard", force: bool = False) -> dict[str, object]:
    """What a service would answer for one uploaded file: its report and, if accepted and changed, the output."""
    import base64

    from siftglass.operators.artifacts import artifacts_from_binary

    upload = spark.createDataFrame([(0, name, bytearray(data))], "id int, name string, data binary")
    artifacts = artifacts_from_binary(upload, "id", "data", "name")
    reports = analyze(artifacts, Options(profile=profile, force_code=force) if mode == "transform" else None)
    row = reports.first()
    assert row is not None
    result: dict[str, object] = {"report": json.loads(as_json(spark.createDataFrame([row], reports.schema)).first()["report"])}
    if mode == "transform" and row["accepted"] and bytes(row["output"]) != data:
        result["output_base64"] = base64.b64encode(row["output"]).decode()
    return result
