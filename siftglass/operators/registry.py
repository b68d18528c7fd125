"""What providers are known to mark, and whether anyone else can check it, as a small table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The capability matrix and its sources.
SURFACES = ("claude.ai", "api", "claude_code", "claude_cowork", "claude_tag", "aws_bedrock", "google_cloud", "microsoft_foundry")
NEWS = "https://www.anthropic.com/news/claude-text-watermark"
HELP = "https://support.claude.com/en/articles/16266773-how-claude-marks-ai-generated-content"
PROVENANCE = "https://openai.com/index/advancing-content-provenance/"
IMAGES_HELP = "https://help.openai.com/en/articles/8912793-c2pa-in-chatgpt-images"
SCHEMA = (
    "ordinal int, provider string, surface string, artifact_kind string, evidence_class string, signal string, "
    "marked boolean, detectability string, label string, source string"
)
ROWS = [
    *[("anthropic", s, "text", "statistical_watermark", "claude_text_watermark", True, "announced_not_available", "confirmed", HELP) for s in SURFACES],
    ("anthropic", "all", "source_code", "statistical_watermark", "claude_text_watermark", True, "announced_not_available", "confirmed", NEWS),
    ("anthropic", "all", "binary", "signed_provenance", "c2pa_content_credential", True, "locally_readable", "confirmed", HELP),
    ("anthropic", "api", "text", "embedded_metadata", "response_headers_or_fields", None, "unknown", "unknown", None),
    ("openai", "all", "text", "statistical_watermark", "text_watermark", None, "unknown", "unverified", None),
    ("openai", "all", "binary", "signed_provenance", "c2pa_content_credential", True, "locally_readable", "confirmed", IMAGES_HELP),
    ("openai", "all", "binary", "statistical_watermark", "synthid_image_watermark", True, "no_public_detector", "confirmed", PROVENANCE),
    ("openai", "codex", "source_code", "statistical_watermark", "code_watermark", None, "unknown", "unknown", None),
    ("generic", "all", "text", "embedded_metadata", "invisible_unicode", None, "locally_readable", "confirmed", None),
]
BLOCKED = ("no_public_detector", "announced_not_available", "unknown")


def matrix(spark: SparkSession) -> DataFrame:
    """All capabilities in their order."""
    return spark.createDataFrame([(k, *r) for k, r in enumerate(ROWS)], SCHEMA)


def capabilities(spark: SparkSession, provider: str | None = None, kind: str | None = None) -> DataFrame:
    """Capabilities of a provider, of a kind of artifact, or of both."""
    out = matrix(spark)
    if provider:
        out = out.where(F.col("provider") == provider.lower())
    return out.where(F.col("artifact_kind") == kind) if kind else out


def providers(spark: SparkSession) -> DataFrame:
    """The providers, sorted."""
    return matrix(spark).select("provider").distinct().orderBy("provider")


def undetectable_signals(spark: SparkSession, kind: str | None = None) -> DataFrame:
    """Signals that may be there but can't be checked: the first row of each provider, signal and kind."""
    rank = F.row_number().over(Window.partitionBy("artifact_kind", "provider", "signal").orderBy("ordinal"))
    blocked = capabilities(spark, kind=kind).where(F.col("detectability").isin(*BLOCKED))
    return blocked.withColumn("rank", rank).where("rank = 1").drop("rank")


def matrix_sql() -> str:
    """The matrix as a DuckDB VALUES list."""
    show = lambda v: "NULL" if v is None else str(v) if isinstance(v, (bool, int)) else f"'{v}'"
    rows = ", ".join("(" + ", ".join(show(v) for v in (k, *r)) + ")" for k, r in enumerate(ROWS))
    return f"(VALUES {rows}) AS matrix(ordinal, provider, surface, artifact_kind, evidence_class, signal, marked, detectability, label, source)"
