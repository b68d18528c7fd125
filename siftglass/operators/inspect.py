"""Inspection: all findings of all artifacts, how each detector fared, and what it adds up to."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftglass.operators import registry
from siftglass.operators.file_findings import DETECTORS, STATUS, detected
from siftglass.operators.text_findings import FINDING, with_text_findings

# Ranks of severities, and notes of the summary.
SEVERITIES = {"info": 0, "notice": 1, "warning": 2}
NOTE_VERIFIED = (
    "A C2PA manifest was found and its signature was verified. This attests to "
    "the signer's claim of involvement; it does not establish authorship."
)
NOTE_UNVERIFIED = (
    "A C2PA manifest structure was found but its signature was NOT verified. "
    "Presence alone proves nothing: install the 'c2pa' extra to verify."
)
NOTE_UNKNOWN = (
    "One or more provenance signals that may be present cannot be checked by "
    "this tool because no public detector exists. Absence of findings is NOT "
    "evidence of absence, and no finding here speaks to authorship."
)
NOTE_EMBEDDED = (
    "Embedded-metadata findings (invisible characters, file metadata) are "
    "unsigned and trivially forged or stripped. They are not a provider "
    "watermark and do not indicate AI generation."
)


@runtime_checkable
class Detector(Protocol):
    """A detector of one's own: expressions over the columns of an artifact, evaluated in the same pass as all others."""

    name: str

    def applies(self) -> Column:
        """Whether it runs on an artifact; null means no."""

    def findings(self) -> Column:
        """An array of findings (``text_findings.finding``); null means none."""


def with_findings(artifacts: DataFrame, keep: list[str], extra: Sequence[Detector] = ()) -> DataFrame:
    """The columns ``keep`` of each artifact with ``kind, textual, findings``, ``statuses`` of its container (or null) and
    ``extra_statuses`` of the detectors ``extra``.

    One row and one pass for each artifact, whatever its id: nothing is joined, and bytes and texts end here.
    """
    none = F.array().cast(EMPTY_FINDINGS)
    own = [F.when(d.applies(), d.findings()).cast(EMPTY_FINDINGS) for d in extra]
    more = F.concat(none, *[F.coalesce(F.array_compact(c), none) for c in own])
    box = artifacts.select(
        *keep,
        *[c for c in ("kind", "text") if c not in keep],
        detected().alias("_box"),
        more.alias("_more"),
        F.array(*[_status(d.name, F.coalesce(d.applies(), F.lit(False)), F.col("kind")) for d in extra]).cast(T.ArrayType(STATUS)).alias("_ran"),
    )
    found = with_text_findings(box, "_own")
    every = F.concat("_own", F.coalesce(F.col("_box.findings"), none), "_more")
    return found.select(
        *keep,
        *[c for c in ("kind",) if c not in keep],
        F.col("text").isNotNull().alias("textual"),
        every.alias("findings"),
        F.col("_box.statuses").alias("statuses"),
        F.col("_ran").alias("extra_statuses"),
    )


def findings(artifacts: DataFrame, extra: Sequence[Detector] = ()) -> DataFrame:
    """All findings, one row each."""
    found = with_findings(artifacts, ["artifact_id"], extra)
    return found.select("artifact_id", F.explode("findings").alias("f")).select("artifact_id", "f.*")


def severity_rank(severity: Column) -> Column:
    """0, 1 or 2; null for anything else."""
    return F.element_at(F.create_map(*[F.lit(x) for p in SEVERITIES.items() for x in p]), severity)


def at_least(found: DataFrame, severity: str) -> DataFrame:
    """Findings of a severity or above; none for ``never``."""
    if severity == "never":
        return found.where(F.lit(False))
    if severity not in SEVERITIES:
        raise ValueError(f"invalid severity: {severity}")
    return found.where(severity_rank(F.col("severity")) >= SEVERITIES[severity])


def _status(name: str, applies: Column, kind: Column) -> Column:
    because = F.concat(F.lit("not applicable to a "), kind, F.lit(" artifact"))
    return F.struct(F.lit(name).alias("name"), applies.alias("ran"), F.when(~applies, because).alias("reason"))


def inspectors(kind: Column, textual: Column, states: Column) -> Column:
    """How each detector fared with an artifact, in their order."""
    own = F.array(_status("unicode", textual, kind), _status("text_markers", textual & (kind != "source_code"), kind))
    absent = F.array(*[_status(n, F.lit(False), kind) for n in DETECTORS])
    return F.concat(own.cast(T.ArrayType(STATUS)), F.coalesce(states, absent.cast(T.ArrayType(STATUS))))


def statuses(artifacts: DataFrame) -> DataFrame:
    """``artifact_id, name, ran, reason`` of every detector and artifact: a skip is never silent."""
    told = artifacts.select("artifact_id", "kind", F.col("text").isNotNull().alias("textual"), detected().alias("d"))
    every = inspectors(F.col("kind"), F.col("textual"), F.col("d.statuses"))
    return told.select("artifact_id", F.explode(every).alias("s")).select("artifact_id", "s.*")


def unknown_signals(spark: SparkSession) -> DataFrame:
    """``artifact_kind, unknown_signals``: for each kind, the signals that can't be checked, in registry order."""
    rows = registry.undetectable_signals(spark)
    name = F.concat("provider", F.lit(":"), "signal", F.lit(" ("), "detectability", F.lit(")"))
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", name.alias("name"))))
    return rows.groupBy("artifact_kind").agg(F.transform(ordered, lambda x: x["name"]).alias("unknown_signals"))


def with_provenance(found: DataFrame) -> DataFrame:
    """``found`` (with ``kind`` and ``findings``) with ``known_signals, unknown_signals, confidence, notes``.

    Only the signals of each kind, a few rows, are joined.
    """
    none = F.array().cast("array<string>")
    signed = F.filter("findings", lambda f: f["evidence_class"] == "signed_provenance")
    performed = lambda f: F.coalesce(F.get_json_object(f["details"], "$.verification") == "performed", F.lit(False))
    verified, unverified = F.exists(signed, performed), F.exists(signed, lambda f: ~performed(f))
    joined = found.join(F.broadcast(unknown_signals(found.sparkSession)), F.col("kind") == F.col("artifact_kind"), "left").drop("artifact_kind")
    joined = joined.withColumn("unknown_signals", F.coalesce("unknown_signals", none))
    notes = F.array(
        F.when(verified, NOTE_VERIFIED).when(unverified, NOTE_UNVERIFIED),
        F.when(F.size("unknown_signals") > 0, NOTE_UNKNOWN),
        F.when(F.exists("findings", lambda f: f["evidence_class"] == "embedded_metadata"), NOTE_EMBEDDED),
    )
    known = F.array_sort(F.array_distinct(F.transform("findings", lambda f: F.concat_ws(":", f["detector"], f["category"]))))
    return joined.select(
        *[c for c in joined.columns if c != "unknown_signals"],
        known.alias("known_signals"),
        "unknown_signals",
        F.when(verified, "signal_present").otherwise("insufficient_evidence").alias("confidence"),
        F.array_compact(notes).alias("notes"),
    )


def provenance(artifacts: DataFrame) -> DataFrame:
    """``artifact_id, known_signals, unknown_signals, confidence, notes``: one row per artifact."""
    told = with_provenance(with_findings(artifacts, ["artifact_id"]))
    return told.select("artifact_id", "known_signals", "unknown_signals", "confidence", "notes")


EMPTY_FINDINGS = T.ArrayType(FINDING)
