"""The registered queries of the inspection and cleaning operators, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftglass.functions import charsets as C
from siftglass.functions.cleaning import OPERATIONS, PROFILES, cleaned, with_cleaned
from siftglass.functions.normalize import other_form
from siftglass.functions.visible import STRUCTURE, skeleton, structure_count, without_controls, words
from siftglass.functions.wording import CLOSE, LABELS, OPEN, SEVERITY_WORDS, TITLES, labelled, revealed, severity_words, title
from siftglass.operators import registry
from siftglass.operators.artifacts import artifacts_from_text
from siftglass.operators.inspect import NOTE_EMBEDDED, NOTE_UNKNOWN, at_least, findings, provenance
from siftglass.operators.report import MARKS, analyze, as_json, batch_summary, rendered
from siftglass.operators.text_findings import BUCKETS, bucket_count, bucket_hits, comments, line_ending_counts, mixed_script_words, tag_payload, text_findings
from siftglass.operators.transform import Options, accepted_profiles, transform_text
from siftglass.plans import containers
from siftglass.sources.salt import dealt_out, salted, salted_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return dealt_out(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return salted(_table(spark, sf_dir, "documents"))


#: Suffixes that documents get by their id, so that all kinds occur.
SUFFIXES = (".md", ".py", ".txt", ".ts", ".html", ".PY", ".xml", ".kt", "", ".tar.js", ".bin", ".json")


def _paths() -> Column:
    names = F.array(*[F.lit(s) for s in SUFFIXES])
    return F.concat(F.lit("tree/file"), F.col("doc_id").cast("string"), F.get(names, F.pmod("doc_id", F.lit(len(SUFFIXES))).cast("int")))


def _artifacts(spark: SparkSession, sf_dir: str, named: bool = False) -> DataFrame:
    documents = _salted(spark, sf_dir)
    return artifacts_from_text(documents, "doc_id", "text", _paths() if named else None)


_S = f"salted AS ({salted_sql()})"
_BOM = "chr(65279)"
_MASKED = f"CASE WHEN starts_with(text, {_BOM}) THEN substring(text, 2) ELSE text END"


def _count_sql(category: str) -> str:
    text = _MASKED if category == "zero_width" else "text"
    return f"len(regexp_extract_all({text}, '{BUCKETS[category][0]}'))"


def _paths_sql() -> str:
    names = ", ".join(f"'{s}'" for s in SUFFIXES)
    return f"'tree/file' || doc_id || ([{names}])[(doc_id % {len(SUFFIXES)} + 1)::INT]"


_KIND = "CASE WHEN regexp_matches(lower(path), '\\.(kt|kts|java|swift|ts|tsx|js|jsx|mjs|cjs|py|pyi)$') THEN 'source_code' ELSE 'text' END"
_LANGUAGE = """CASE lower(regexp_extract(path, '(\\.[^.]+)$', 1)) WHEN '.kt' THEN 'kotlin' WHEN '.py' THEN 'python'
  WHEN '.ts' THEN 'typescript' WHEN '.js' THEN 'javascript' END"""
_MEDIA = """CASE lower(regexp_extract(path, '(\\.[^.]+)$', 1)) WHEN '.md' THEN 'text/markdown' WHEN '.txt' THEN 'text/plain'
  WHEN '.html' THEN 'text/html' WHEN '.xml' THEN 'text/xml' WHEN '.json' THEN 'application/json' END"""


@_query(
    "artifact_profile",
    f"""WITH {_S}, named AS (SELECT *, {_paths_sql()} AS path FROM salted WHERE text IS NOT NULL)
SELECT doc_id, path, {_KIND} AS kind, {_LANGUAGE} AS language, {_MEDIA} AS media_type, sha256(text) AS sha256,
  strlen(text)::BIGINT AS size_bytes, CASE WHEN starts_with(text, {_BOM}) THEN 'utf-8-sig' ELSE 'utf-8' END AS encoding, true AS decoded FROM named""",
)
def artifact_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _artifacts(spark, sf_dir, named=True).drop("data", "text").withColumnRenamed("artifact_id", "doc_id")


@_query("sha256_fingerprint", "SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def sha256_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts_from_text(_table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("artifact_id").alias("doc_id"), "sha256")


@_query(
    "kind_rollup",
    f"""WITH {_S}, named AS (SELECT text, {_paths_sql()} AS path FROM salted WHERE text IS NOT NULL)
SELECT {_KIND} AS kind, {_LANGUAGE} AS language, count(*) AS n, sum(strlen(text))::BIGINT AS total_bytes FROM named GROUP BY 1, 2""",
)
def kind_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _artifacts(spark, sf_dir, named=True).groupBy("kind", "language").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("total_bytes"))


def _bucket_query(category: str) -> None:
    @_query(f"{category}_findings", f"WITH {_S} SELECT doc_id, {_count_sql(category)}::BIGINT AS n FROM salted WHERE {_count_sql(category)} > 0")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _salted(spark, sf_dir).select("doc_id", bucket_count(F.col("text"), category).alias("n")).where("n > 0")


for _category in BUCKETS:
    _bucket_query(_category)


@_query(
    "tag_payload",
    f"""WITH {_S} SELECT doc_id, array_to_string(list_transform(list_filter(regexp_extract_all(text, '{C.TAG_CLASS}'),
  lambda c: unicode(c) BETWEEN 917536 AND 917630), lambda c: chr(unicode(c) - 917504)), '') AS payload
FROM salted WHERE regexp_matches(text, '{C.TAG_CLASS}')""",
)
def hidden_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return _salted(spark, sf_dir).where(text.rlike(C.TAG_CLASS)).select("doc_id", tag_payload(bucket_hits(text, "unicode_tag_char")).alias("payload"))


@_query("bom_findings", f"WITH {_S} SELECT doc_id FROM salted WHERE starts_with(text, {_BOM})")
def bom_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _salted(spark, sf_dir).where(F.startswith("text", F.lit(C.BOM))).select("doc_id")


_ENDINGS = """SELECT *, (length(text) - length(replace(text, chr(13) || chr(10), ''))) // 2 AS crlf,
  length(text) - length(replace(text, chr(10), '')) - crlf AS lf, length(text) - length(replace(text, chr(13), '')) - crlf AS cr FROM salted"""


@_query(
    "line_ending_mix",
    f"WITH {_S}, e AS ({_ENDINGS}) SELECT doc_id, crlf::BIGINT AS crlf, lf::BIGINT AS lf, cr::BIGINT AS cr FROM e WHERE (crlf > 0)::INT + (lf > 0)::INT + (cr > 0)::INT > 1",
)
def line_ending_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [n.alias(a) for n, a in zip(line_ending_counts(F.col("text")), ("crlf", "lf", "cr"), strict=True)]
    return _salted(spark, sf_dir).select("doc_id", *columns).where("int(crlf > 0) + int(lf > 0) + int(cr > 0) > 1")


_MIXED = f"""list_filter(regexp_extract_all(text, '{C.LETTER_RUN}'),
  lambda w: regexp_matches(w, '{C.latin_class()}') AND regexp_matches(w, '{C.other_letter_class()}'))"""


@_query("mixed_script_words", f"WITH {_S}, m AS (SELECT doc_id, {_MIXED} AS w FROM salted) SELECT doc_id, len(w)::BIGINT AS n, array_to_string(w[1:10], ',') AS examples FROM m WHERE len(w) > 0")
def mixed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _salted(spark, sf_dir).select("doc_id", mixed_script_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    return found.select("doc_id", F.size("w").cast("long").alias("n"), F.array_join(F.slice("w", 1, 10), ",").alias("examples"))


@_query("non_nfc_documents", f"WITH {_S} SELECT doc_id, sha256(nfc_normalize(text)) AS nfc_sha256 FROM salted WHERE nfc_normalize(text) <> text")
def non_nfc_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftglass.functions.normalize import nfc

    text = F.col("text")
    found = _salted(spark, sf_dir).select("doc_id", "text", other_form(text).alias("form")).where("form IS NOT NULL")
    return found.select("doc_id", F.sha2(nfc(text), 256).alias("nfc_sha256"))


@_query(
    "markup_comments",
    "SELECT page_id, len(regexp_extract_all(html, '(?s)<!--(.*?)-->', 1))::BIGINT AS n, array_to_string(regexp_extract_all(html, '(?s)<!--(.*?)-->', 1), '|') AS bodies FROM pages WHERE html LIKE '%<!--%-->%'",
)
def markup_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _table(spark, sf_dir, "pages").select("page_id", comments(F.col("html")).alias("c")).where(F.size("c") > 0)
    return found.select("page_id", F.size("c").cast("long").alias("n"), F.array_join("c", "|").alias("bodies"))


@_query(
    "first_hit_line_column",
    f"""WITH {_S}, h AS (SELECT doc_id, text, {_MASKED} AS m FROM salted WHERE {_count_sql('zero_width')} > 0),
p AS (SELECT doc_id, text, length(text) - length(m) + length(regexp_extract(m, '^([^{C.ZERO_WIDTH_CLASS[1:]}*)', 1)) AS place FROM h),
b AS (SELECT doc_id, place, substring(text, 1, place) AS before FROM p)
SELECT doc_id, place::BIGINT AS place, (length(before) - length(replace(before, chr(10), '')) + 1)::BIGINT AS line,
  (length(regexp_extract(before, '([^\\n]*)$', 1)) + 1)::BIGINT AS col FROM b""",
)
def first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text_findings(_artifacts(spark, sf_dir)).where("category = 'zero_width'")
    at = F.get("locations", F.lit(0))
    return found.select(F.col("artifact_id").alias("doc_id"), at["offset"].alias("place"), at["line"].alias("line"), at["column"].alias("col"))


def _found_sql() -> str:
    """All findings of salted documents in DuckDB: doc_id, category, severity, n."""
    parts = [f"SELECT doc_id, lang, source, '{c}' AS category, '{b[1]}' AS severity, {_count_sql(c)} AS n FROM salted" for c, b in BUCKETS.items()]
    parts += [
        f"SELECT doc_id, lang, source, 'byte_order_mark', 'notice', starts_with(text, {_BOM})::INT FROM salted",
        "SELECT doc_id, lang, source, 'unicode_normalization', 'info', (nfc_normalize(text) <> text)::INT FROM salted",
        f"SELECT doc_id, lang, source, 'mixed_line_endings', 'notice', ((crlf > 0)::INT + (lf > 0)::INT + (cr > 0)::INT > 1)::INT FROM ({_ENDINGS})",
        f"SELECT doc_id, lang, source, 'mixed_script_word', 'warning', len({_MIXED}) FROM salted",
        "SELECT doc_id, lang, source, 'markup_comment', 'info', len(regexp_extract_all(text, '(?s)<!--(.*?)-->')) FROM salted",
    ]
    return "found AS (SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE n > 0)"


_F = f"WITH {_S}, {_found_sql()}"


@_query("findings_by_category", f"{_F} SELECT category, severity, count(*) AS artifacts, sum(n)::BIGINT AS hits FROM found GROUP BY category, severity")
def findings_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings(_artifacts(spark, sf_dir))
    return found.groupBy("category", "severity").agg(F.count("*").alias("artifacts"), F.sum("count").alias("hits"))


def _revealed_sql() -> str:
    out = "text"
    for label, points in LABELS.items():
        out = f"regexp_replace({out}, '[{points}]', '{OPEN}{label}{CLOSE}', 'g')"
    return out


@_query("revealed_text", f"WITH {_S} SELECT doc_id, sha256({_revealed_sql()}) AS revealed_sha256 FROM salted")
def revealed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _salted(spark, sf_dir).select("doc_id", F.sha2(revealed(F.col("text")), 256).alias("revealed_sha256"))


_LABEL_ROWS = " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label, len(regexp_extract_all(text, '[{points}]')) AS n FROM salted" for label, points in LABELS.items())


@_query("hidden_labels", f"WITH {_S} SELECT doc_id, label, n::BIGINT AS n FROM ({_LABEL_ROWS}) WHERE n > 0")
def hidden_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _salted(spark, sf_dir).select("doc_id", F.explode(labelled(F.col("text"))).alias("l")).select("doc_id", "l.*")


def _words_sql(column: str, names: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE {column} END"


@_query(
    "findings_in_plain_words",
    f"{_F} SELECT {_words_sql('category', TITLES)} AS title, {_words_sql('severity', SEVERITY_WORDS)} AS advice, count(*) AS artifacts FROM found GROUP BY ALL",
)
def findings_in_plain_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings(_artifacts(spark, sf_dir))
    return found.groupBy(title(F.col("category")).alias("title"), severity_words(F.col("severity")).alias("advice")).agg(F.count("*").alias("artifacts"))


@_query("findings_by_lang_source", f"{_F} SELECT lang, source, category, count(*) AS artifacts, sum(n)::BIGINT AS hits FROM found GROUP BY ALL")
def findings_by_lang_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _salted(spark, sf_dir)
    base = documents.select(F.col("doc_id").alias("artifact_id"), "lang", "source", F.lit("text").alias("kind"), "text")
    return text_findings(base, ("lang", "source")).groupBy("lang", "source", "category").agg(F.count("*").alias("artifacts"), F.sum("count").alias("hits"))


@_query("findings_vs_labels", f"{_F} SELECT category, quality, toxic, count(*) AS artifacts FROM found JOIN labels USING (doc_id) GROUP BY ALL")
def findings_vs_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings(_artifacts(spark, sf_dir)).select(F.col("artifact_id").alias("doc_id"), "category")
    return found.join(_table(spark, sf_dir, "labels"), "doc_id").groupBy("category", "quality", "toxic").agg(F.count("*").alias("artifacts"))


@_query("severity_gate", f"{_F} SELECT DISTINCT doc_id FROM found WHERE severity = 'warning'")
def severity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at_least(findings(_artifacts(spark, sf_dir)), "warning").select(F.col("artifact_id").alias("doc_id")).distinct()


@_query("clean_artifacts", f"{_F} SELECT doc_id FROM salted WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM found)")
def clean_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    artifacts = _artifacts(spark, sf_dir)
    return artifacts.join(findings(artifacts), "artifact_id", "left_anti").select(F.col("artifact_id").alias("doc_id"))


@_query(
    "batch_summary",
    f"{_F} SELECT count(*) AS artifacts, count(f.doc_id) AS with_findings, count(*) - count(f.doc_id) AS hidden FROM salted s LEFT JOIN (SELECT DISTINCT doc_id FROM found) f USING (doc_id) WHERE text IS NOT NULL",
)
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_summary(analyze(_artifacts(spark, sf_dir)))


@_query("top_k_dirty_documents", f"{_F} SELECT doc_id, sum(n)::BIGINT AS hits, count(*) AS categories FROM found GROUP BY doc_id ORDER BY hits DESC, doc_id LIMIT 20")
def top_k_dirty_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings(_artifacts(spark, sf_dir)).groupBy(F.col("artifact_id").alias("doc_id"))
    return found.agg(F.sum("count").alias("hits"), F.count("*").alias("categories")).orderBy(F.desc("hits"), "doc_id").limit(20)


@_query(
    "first_finding_per_document",
    f"""{_F} SELECT doc_id, category, severity FROM found QUALIFY row_number() OVER (PARTITION BY doc_id
  ORDER BY CASE severity WHEN 'warning' THEN 0 WHEN 'notice' THEN 1 ELSE 2 END, category) = 1""",
)
def first_finding_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("severity") == "warning", 0).when(F.col("severity") == "notice", 1).otherwise(2)
    order = Window.partitionBy("artifact_id").orderBy(rank, "category")
    found = findings(_artifacts(spark, sf_dir)).withColumn("k", F.row_number().over(order)).where("k = 1")
    return found.select(F.col("artifact_id").alias("doc_id"), "category", "severity")


@_query(
    "conversation_findings",
    f"""SELECT conv_id, role, count(*) AS turns, sum(len(regexp_extract_all(t, '{C.BIDI_CLASS}')))::BIGINT AS bidi
FROM (SELECT *, CASE WHEN turn % 2 = 1 THEN substring(text, 1, 3) || chr(8238) || substring(text, 4) ELSE text END AS t FROM conversations) GROUP BY ALL""",
)
def conversation_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    marked = F.when(F.col("turn") % 2 == 1, F.concat(F.substring(text, 1, 3), F.lit("\u202e"), F.substring(text, 4, 2**31 - 1))).otherwise(text)
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "role", bucket_count(marked, "bidi_control").alias("n"))
    return turns.groupBy("conv_id", "role").agg(F.count("*").alias("turns"), F.sum("n").alias("bidi"))


_CC = C.format_and_control_class()
_WHITE = "[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
_OP_SQL = {
    "strip_zero_width": f"CASE WHEN starts_with({{t}}, {_BOM}) THEN {_BOM} ELSE '' END || regexp_replace({{t}}, '{C.ZERO_WIDTH_CLASS}', '', 'g')",
    "strip_tag_characters": f"regexp_replace({{t}}, '{C.TAG_CLASS}', '', 'g')",
    "strip_bidi_controls": f"regexp_replace({{t}}, '{C.BIDI_CLASS}', '', 'g')",
    "strip_variation_selectors": f"regexp_replace({{t}}, '{C.VARIATION_CLASS}', '', 'g')",
    "strip_other_invisible": f"regexp_replace({{t}}, '{C.OTHER_CLASS}', '', 'g')",
    "strip_control_characters": f"regexp_replace({{t}}, '{C.CONTROL_CLASS}', '', 'g')",
    "normalize_spaces": f"regexp_replace({{t}}, '{C.SPACE_CLASS}', ' ', 'g')",
    "strip_bom": f"CASE WHEN starts_with({{t}}, {_BOM}) THEN substring({{t}}, 2) ELSE {{t}} END",
    "normalize_nfc": "nfc_normalize({t})",
    "normalize_line_endings": "replace(replace({t}, chr(13) || chr(10), chr(10)), chr(13), chr(10))",
    "strip_trailing_whitespace": "regexp_replace({t}, '(?m)[ \\t]+$', '', 'g')",
    "collapse_blank_lines": "regexp_replace({t}, '\\n{4,}', chr(10) || chr(10) || chr(10), 'g')",
    "ensure_final_newline": "CASE WHEN {t} = '' OR suffix({t}, chr(10)) THEN {t} ELSE {t} || chr(10) END",
}


def _steps_sql(names: list[str]) -> tuple[str, str]:
    """CTEs that apply operations one after another to ``salted``, and the last one's name."""
    out, last = [], "salted"
    for k, n in enumerate(names):
        if n in _OP_SQL:
            out.append(f"s{k} AS (SELECT doc_id, {_OP_SQL[n].replace('{t}', 'text')} AS text FROM {last})")
            last = f"s{k}"
    return ", ".join(out), last


def _operation_query(name: str) -> None:
    steps, last = _steps_sql([name])

    @_query(name, f"WITH {_S}, {steps} SELECT doc_id, sha256(text) AS sha256 FROM {last}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _salted(spark, sf_dir).select("doc_id", F.sha2(cleaned(F.col("text"), name), 256).alias("sha256"))


for _name in _OP_SQL:
    _operation_query(_name)


def _view(t: str) -> str:
    return f"regexp_replace({t}, '{_CC}', '', 'g')"


def _skeleton_sql(t: str) -> str:
    return f"trim(regexp_replace({_view(f'nfc_normalize({t})')}, '{_WHITE}', ' ', 'g'))"


def _same_structure_sql() -> str:
    return " AND ".join(
        f"len(regexp_extract_all({_view('s.text')}, '(?m){p}')) = len(regexp_extract_all({_view('c.text')}, '(?m){p}'))" for p in STRUCTURE.values()
    )


def _profile_query(name: str) -> None:
    steps, last = _steps_sql(PROFILES[name])
    accepted = f"{_skeleton_sql('s.text')} = {_skeleton_sql('c.text')} AND {_same_structure_sql()}"

    @_query(
        f"profile_{name}",
        f"""WITH {_S}, {steps}, pairs AS (SELECT doc_id, s.text AS old, c.text AS new, {accepted} AS accepted FROM salted s JOIN {last} c USING (doc_id) WHERE s.text IS NOT NULL)
SELECT doc_id, accepted, sha256(CASE WHEN accepted THEN new ELSE old END) AS output_sha256 FROM pairs""",
    )
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        done = transform_text(_artifacts(spark, sf_dir), Options(profile=name, changes=False))
        return done.select(F.col("artifact_id").alias("doc_id"), "accepted", F.sha2("output", 256).alias("output_sha256"))


for _name in PROFILES:
    _profile_query(_name)


def _acceptance_sql() -> str:
    parts = [
        f"SELECT '{n}' AS profile, accepted, count(*) AS artifacts FROM ({SQL[f'profile_{n}']}) GROUP BY accepted" for n in ("minimal", "standard", "tidy")
    ]
    return " UNION ALL ".join(parts)


@_query("acceptance_by_profile", _acceptance_sql())
def acceptance_by_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = accepted_profiles(_artifacts(spark, sf_dir), ("minimal", "standard", "tidy"))
    return done.groupBy("profile", "accepted").agg(F.count("*").alias("artifacts"))


_TIDY, _TIDY_LAST = _steps_sql(PROFILES["tidy"])


@_query(
    "skeleton_preserved",
    f"WITH {_S}, {_TIDY} SELECT doc_id, {_skeleton_sql('s.text')} = {_skeleton_sql('c.text')} AS preserved, length({_skeleton_sql('s.text')})::BIGINT AS skeleton_chars FROM salted s JOIN {_TIDY_LAST} c USING (doc_id) WHERE s.text IS NOT NULL",
)
def skeleton_preserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = transform_text(_artifacts(spark, sf_dir), Options(profile="tidy", changes=False))
    check = F.get(F.filter("checks", lambda c: c["name"] == "visible_content_preserved"), 0)
    size = F.get_json_object(check["measurements"], "$.skeleton_chars_before").cast("long")
    return done.select(F.col("artifact_id").alias("doc_id"), check["passed"].alias("preserved"), size.alias("skeleton_chars"))


@_query(
    "words_added_removed",
    f"""WITH {_S}, {_TIDY}, w AS (SELECT doc_id, string_split({_skeleton_sql('s.text')}, ' ') AS a, string_split({_skeleton_sql('c.text')}, ' ') AS b
  FROM salted s JOIN {_TIDY_LAST} c USING (doc_id) WHERE s.text IS NOT NULL),
d AS (SELECT doc_id, list_filter(list_distinct(b), lambda x: NOT list_contains(a, x)) AS added, list_filter(list_distinct(a), lambda x: NOT list_contains(b, x)) AS removed FROM w WHERE a <> b)
SELECT doc_id, len(added)::BIGINT AS added, len(removed)::BIGINT AS removed, array_to_string(list_sort(added)[1:10], ' ') AS examples FROM d WHERE len(added) + len(removed) > 0""",
)
def words_added_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftglass.functions.normalize import nfc

    text = with_cleaned(_salted(spark, sf_dir).where("text IS NOT NULL").select("doc_id", "text"), "text", "clean", "tidy")
    made = text.select("doc_id", words(skeleton(nfc(F.col("text")))).alias("a"), words(skeleton(nfc(F.col("clean")))).alias("b")).where("a <> b")
    found = made.select("doc_id", F.array_except("b", "a").alias("added"), F.array_except("a", "b").alias("removed")).where(F.size("added") + F.size("removed") > 0)
    return found.select("doc_id", F.size("added").cast("long").alias("added"), F.size("removed").cast("long").alias("removed"), F.array_join(F.slice(F.array_sort("added"), 1, 10), " ").alias("examples"))


@_query(
    "structure_counts",
    f"""WITH {_S}, m AS (SELECT doc_id, {_view("'# ' || text || chr(10) || '- a' || chr(10) || '  2. b' || chr(10) || '```'")} AS v FROM salted WHERE text IS NOT NULL)
SELECT doc_id, {', '.join(f"len(regexp_extract_all(v, '(?m){p}'))::BIGINT AS {n}" for n, p in STRUCTURE.items())} FROM m""",
)
def structure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit("# "), F.col("text"), F.lit("\n- a\n  2. b\n```"))
    view = _salted(spark, sf_dir).where("text IS NOT NULL").select("doc_id", without_controls(marked).alias("v"))
    return view.select("doc_id", *[structure_count(F.col("v"), n).alias(n) for n in STRUCTURE])


@_query(
    "provenance_summary",
    f"""{_F}, k AS (SELECT doc_id, string_agg(DISTINCT CASE category WHEN 'markup_comment' THEN 'text_markers:' ELSE 'unicode:' END || category, ',' ORDER BY CASE category WHEN 'markup_comment' THEN 'text_markers:' ELSE 'unicode:' END || category) AS known FROM found GROUP BY doc_id)
SELECT doc_id, coalesce(known, '') AS known, 3::BIGINT AS unknown, 'insufficient_evidence' AS confidence, 1 + (known IS NOT NULL)::BIGINT AS notes FROM salted LEFT JOIN k USING (doc_id) WHERE text IS NOT NULL""",
)
def provenance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = provenance(_artifacts(spark, sf_dir))
    size = lambda c: F.size(c).cast("long")
    return told.select(F.col("artifact_id").alias("doc_id"), F.array_join("known_signals", ",").alias("known"), size("unknown_signals").alias("unknown"), "confidence", size("notes").alias("notes"))


_M = registry.matrix_sql()


@_query(
    "undetectable_signals",
    f"SELECT * FROM (SELECT * FROM {_M}) WHERE detectability IN ('no_public_detector', 'announced_not_available', 'unknown') QUALIFY row_number() OVER (PARTITION BY artifact_kind, provider, signal ORDER BY ordinal) = 1",
)
def undetectable_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.undetectable_signals(spark)


@_query("capabilities_by_provider", f"SELECT provider, artifact_kind, count(*) AS n, count(marked) AS known FROM {_M} GROUP BY ALL")
def capabilities_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.capabilities(spark).groupBy("provider", "artifact_kind").agg(F.count("*").alias("n"), F.count("marked").alias("known"))


@_query("providers", f"SELECT DISTINCT provider FROM {_M}")
def providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.providers(spark)


def _quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


_LISTED = ", ".join(
    f"({_quoted(o.id)}, {_quoted(o.description)}, {str(o.semantics_preserving).lower()}, {_quoted(o.note)}, {_quoted(','.join(p for p, ids in PROFILES.items() if o.id in ids))})" for o in OPERATIONS.values()
)


@_query("operations_listing", f"SELECT * FROM (VALUES {_LISTED}) AS t(operation, description, semantics_preserving, note, profiles)")
def operations_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftglass.operators.report import operations

    return operations(spark).withColumn("profiles", F.array_join("profiles", ","))


def _changes_sql() -> str:
    """Edits by operation: removed characters, but what replaces a character or two is counted by what it replaces."""
    shorter = "length(a.text) - length(b.text)"
    special = {
        "normalize_nfc": f"2 * ({shorter})",
        "normalize_spaces": f"len(regexp_extract_all(a.text, '{C.SPACE_CLASS}'))",
        "normalize_line_endings": "length(a.text) - length(replace(a.text, chr(13), ''))",
        "ensure_final_newline": "1",
    }
    ids = PROFILES["standard"]
    steps, _ = _steps_sql(ids)
    sums = [
        f"SELECT '{n}' AS operation, count(*) AS artifacts, sum({special.get(n, shorter)})::BIGINT AS changes FROM {f's{k - 1}' if k else 'salted'} a JOIN s{k} b USING (doc_id) WHERE a.text <> b.text HAVING count(*) > 0"
        for k, n in enumerate(ids)
    ]
    return f"WITH {_S}, {steps} " + " UNION ALL ".join(sums)


@_query("change_counts", _changes_sql())
def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of each operation of the standard profile."""
    done = transform_text(_artifacts(spark, sf_dir), Options(profile="standard"))
    steps = done.select(F.explode("operations").alias("o")).where("o.applied")
    return steps.groupBy("o.operation").agg(F.count("*").alias("artifacts"), F.sum("o.changes").alias("changes"))


_TWICE, _TWICE_LAST = _steps_sql([*PROFILES["tidy"], *PROFILES["tidy"]])


@_query("idempotence_violations", f"WITH {_S}, {_TWICE} SELECT doc_id FROM {_steps_sql(PROFILES['tidy'])[1]} a JOIN {_TWICE_LAST} b USING (doc_id) WHERE a.text <> b.text")
def idempotence_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose cleaned text isn't clean: there must be none."""
    once = with_cleaned(_salted(spark, sf_dir).where("text IS NOT NULL").select("doc_id", "text"), "text", "a", "tidy")
    return with_cleaned(once, "a", "b", "tidy").where("a <> b").select("doc_id")


@_query(
    "report_json",
    f"""WITH p AS ({SQL['provenance_summary']}), t AS ({SQL['profile_standard']}), {_S}
SELECT doc_id, '1.0' AS schema_version, 'text' AS kind, sha256(text) AS sha256, known, confidence, accepted, CASE WHEN accepted THEN output_sha256 END AS output_sha256,
  CASE WHEN known = '' THEN 0 ELSE len(string_split(known, ',')) END::BIGINT AS findings FROM salted JOIN p USING (doc_id) JOIN t USING (doc_id)""",
)
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole reports with their transformation, read again from their JSON."""
    report = as_json(analyze(_artifacts(spark, sf_dir), Options(changes=False)))
    field = lambda path, alias: F.get_json_object("report", f"$.{path}").alias(alias)
    return report.select(
        F.col("artifact_id").alias("doc_id"), field("schema_version", "schema_version"), field("artifact.kind", "kind"), field("artifact.sha256", "sha256"),
        F.array_join(F.from_json(F.get_json_object("report", "$.inspection.provenance.known_signals_detected"), "array<string>"), ",").alias("known"),
        field("inspection.provenance.confidence", "confidence"), F.get_json_object("report", "$.transformation.accepted").cast("boolean").alias("accepted"), field("transformation.output_sha256", "output_sha256"),
        F.json_array_length(F.get_json_object("report", "$.inspection.findings")).cast("long").alias("findings"),
    )


def _report_sql() -> str:
    rows = [
        f"SELECT doc_id, 'unicode' AS detector, '{c}' AS category, CASE WHEN '{c}' = 'bidi_control' AND kind = 'source_code' THEN 'warning' ELSE '{b[1]}' END AS severity, {_count_sql(c)} AS n, {_count_sql(c)} || ' {c.replace('_', ' ')} character(s) present' AS summary, '{b[2]}' AS removable FROM named"
        for c, b in BUCKETS.items()
    ]
    rows += [
        f"SELECT doc_id, 'unicode', 'byte_order_mark', 'notice', starts_with(text, {_BOM})::INT, 'File begins with a UTF-8 byte order mark', 'strip_bom' FROM named",
        "SELECT doc_id, 'unicode', 'unicode_normalization', 'info', (nfc_normalize(text) <> text)::INT, 'Text is not in Unicode NFC normalization form', 'normalize_nfc' FROM named",
        f"SELECT doc_id, 'unicode', 'mixed_line_endings', 'notice', ((crlf > 0)::INT + (lf > 0)::INT + (cr > 0)::INT > 1)::INT, 'File mixes line ending styles', 'normalize_line_endings' FROM ({_ENDINGS.replace('FROM salted', 'FROM named')})",
        f"SELECT doc_id, 'unicode', 'mixed_script_word', 'warning', len({_MIXED}), len({_MIXED}) || ' word(s) mix Latin with another script (possible homoglyphs)', NULL FROM named",
        "SELECT doc_id, 'text_markers', 'markup_comment', 'info', CASE WHEN kind = 'source_code' THEN 0 ELSE len(regexp_extract_all(text, '(?s)<!--(.*?)-->')) END, len(regexp_extract_all(text, '(?s)<!--(.*?)-->')) || ' HTML/XML comment(s) present (not rendered, but present in the source)', NULL FROM named",
    ]
    mark = " ".join(f"WHEN '{s}' THEN '{m}'" for s, m in MARKS.items())
    return f"""WITH {_S}, named AS (SELECT doc_id, text, path, {_KIND} AS kind FROM (SELECT *, {_paths_sql()} AS path FROM salted WHERE text IS NOT NULL)),
found AS (SELECT * FROM ({' UNION ALL '.join(rows)}) WHERE n > 0),
lines AS (SELECT doc_id, count(*) AS k, string_agg(CASE severity {mark} END || ' [embedded_metadata] ' || category || ': ' || summary || coalesce(chr(10) || '      removable by: ' || removable, ''), chr(10) ORDER BY detector, category) AS shown
  FROM found GROUP BY doc_id),
unknown AS (SELECT artifact_kind, string_agg(chr(10) || '   unknown signal: ' || provider || ':' || signal || ' (' || detectability || ')', '' ORDER BY ordinal) AS signals FROM ({SQL['undetectable_signals']}) GROUP BY artifact_kind)
SELECT doc_id, sha256('artifact   ' || path || chr(10) || '           kind=' || kind || chr(10) || '           sha256=' || sha256(text) || '  size=' || strlen(text) || 'B' || chr(10) || chr(10)
  || CASE WHEN k > 0 THEN 'findings (' || k || ')' || chr(10) || shown ELSE 'findings   none' END || chr(10) || chr(10) || 'provenance confidence=insufficient_evidence' || coalesce(signals, '')
  || CASE WHEN signals IS NOT NULL THEN chr(10) || '   note: ' || {_quoted(NOTE_UNKNOWN)} ELSE '' END || CASE WHEN k > 0 THEN chr(10) || '   note: ' || {_quoted(NOTE_EMBEDDED)} ELSE '' END) AS block_sha256
FROM named LEFT JOIN lines USING (doc_id) LEFT JOIN unknown ON kind = artifact_kind"""


@_query("report_text", _report_sql())
def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole reports as text."""
    shown = rendered(analyze(_artifacts(spark, sf_dir, named=True)))
    return shown.select(F.col("artifact_id").alias("doc_id"), F.sha2("block", 256).alias("block_sha256"))


_PAIRS = f"""WITH {_S}, pairs AS (SELECT doc_id, text AS a, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN text || ' addedword' WHEN 2 THEN '# ' || text ELSE chr(8203) || text END AS b FROM salted WHERE text IS NOT NULL)"""


@_query(
    "validate_pairs",
    f"""{_PAIRS} SELECT doc_id, {_skeleton_sql('a')} = {_skeleton_sql('b')} AS visible,
  len(list_filter(string_split({_skeleton_sql('b')}, ' '), lambda x: x <> '' AND NOT list_contains(string_split({_skeleton_sql('a')}, ' '), x))) = 0 AS additions,
  {_same_structure_sql().replace('s.text', 'a').replace('c.text', 'b')} AS structure FROM pairs""",
)
def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of the salted texts against changed ones: a word more, a heading mark, a hidden character."""
    from siftglass.operators.checks import validate_pairs

    text = F.col("text")
    changed = F.when(F.col("doc_id") % 4 == 0, text).when(F.col("doc_id") % 4 == 1, F.concat(text, F.lit(" addedword"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("# "), text)).otherwise(F.concat(F.lit("\u200b"), text))
    done = validate_pairs(_salted(spark, sf_dir).where("text IS NOT NULL").select("doc_id", "text", changed.alias("after")), "doc_id", "text", "after")
    passed = lambda name: F.get(F.filter("checks", lambda c: c["name"] == name), 0)["passed"]
    return done.select("doc_id", passed("visible_content_preserved").alias("visible"), passed("no_unintended_additions").alias("additions"), passed("structure_preserved").alias("structure"))


QUERIES |= containers.QUERIES
SQL |= containers.SQL
assert set(_OP_SQL) | {"remove_unused_imports"} == set(OPERATIONS)
