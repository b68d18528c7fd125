"""The registered queries of the operators, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftglass.llm.common import dealt, table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftglass.llm.quality_rules import fit, quality_rules

    documents = dealt(spark, sf_dir, "documents")
    out = quality_rules(documents, fit(documents, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftglass.llm.line_dedup import host_of, html_lines, line_dedup

    out = line_dedup(dealt(spark, sf_dir, "pages"), host_of(F.col("url")), html_lines(F.col("html")))
    return out.select("page_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP2_SQL = r"""
WITH base AS (
  SELECT page_id, lower(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1), '')) AS host,
    string_split(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), '<[^>]*>', chr(10), 'g'), chr(10)) AS lines
  FROM pages),
seen AS (
  SELECT host, line, count(*) AS n FROM (
    SELECT host, unnest(list_distinct(list_filter(list_transform(lines, lambda x: trim(x, {BLANKS})), lambda x: x <> ''))) AS line
    FROM base WHERE host IS NOT NULL)
  GROUP BY host, line),
totals AS (SELECT host, count(*) AS total FROM base WHERE host IS NOT NULL GROUP BY host),
common AS (SELECT host, list(line) AS common FROM seen JOIN totals USING (host) WHERE n::DOUBLE / total > 0.05::DOUBLE AND n >= least(5, greatest(3, total // 2 + 1)) GROUP BY host),
cut AS (
  SELECT page_id, lines, list_filter(lines, lambda x: NOT coalesce(list_contains(common, trim(x, {BLANKS})), false)) AS kept
  FROM base LEFT JOIN common USING (host))
SELECT page_id, coalesce(len(list_filter(lines, lambda x: trim(x, {BLANKS}) <> '')), 0)::BIGINT AS n_lines,
  coalesce(len(lines) - len(kept), 0)::BIGINT AS n_dropped, sha256(array_to_string(kept, chr(10))) AS kept_sha256
FROM cut
""".replace("{BLANKS}", _BLANKS)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftglass.llm.quality_knn import classify, fit

    documents = dealt(spark, sf_dir, "documents")
    return classify(documents, fit(documents, table(spark, sf_dir, "labels")))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftglass.llm.token_count import cache_of, token_counts

    return token_counts(dealt(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), cache_of(spark, sf_dir))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftglass.llm.suffix_dedup import suffix_dedup

    out = suffix_dedup(dealt(spark, sf_dir, "documents"), digest=True)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.col("kept").alias("kept_sha256"))


def op6_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftglass.llm.bpe_automaton import encode_decode

    return encode_decode(dealt(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), digests=True)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftglass.llm.chat_format import format_windows, read_back

    trap = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(trap)
    back = read_back(format_windows(conversations))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return back.select(
        "conv_id",
        "n_turns",
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftglass.llm.substring_dedup import substring_dedup

    out = substring_dedup(dealt(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM words),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS x FROM starts),
least AS (SELECT x, min(doc_id) AS first FROM windows GROUP BY x),
hits AS (SELECT doc_id, i FROM windows JOIN least USING (x) WHERE first < doc_id),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS g FROM hits GROUP BY doc_id),
cut AS (
  SELECT doc_id, w, coalesce(len(g), 0) AS n_removed,
    CASE WHEN g IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda p: NOT list_contains(g, p[2])), lambda p: p[1]) END AS kept
  FROM words LEFT JOIN gone USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM cut
"""


def fingerprint_text(fp: str = "fp") -> Column:
    """A signed 64-bit fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftglass.llm.simhash import simhash_components

    out = simhash_components(dealt(spark, sf_dir, "documents"))
    return out.select("doc_id", fingerprint_text().alias("fingerprint"), "component_id")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftglass.llm.decontaminate import decontaminate

    out = decontaminate(dealt(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


OP10_SQL = r"""
WITH low AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
docs AS (SELECT doc_id, coalesce(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM low),
items AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
cut AS (SELECT item, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 11, 2))) AS i FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM cut),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM docs),
here AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM starts CROSS JOIN (SELECT DISTINCT n FROM windows) WHERE i + n - 1 <= len(w)),
hits AS (SELECT doc_id, i, n, item FROM here JOIN windows USING (x, n)),
found AS (SELECT doc_id, len(list_distinct(flatten(list(range(i, i + n))))) AS n_hit, list_sort(list_distinct(list(item))) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN found USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name."""
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_line_dedup": op2_line_dedup,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_token_counts": op4_token_counts,
        "op5_suffix_array_dedup": op5_suffix_array_dedup,
        "op6_bpe_encode_decode": op6_bpe_encode_decode,
        "op7_chat_format": op7_chat_format,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_simhash_near_dedup": op9_simhash_near_dedup,
        "op10_benchmark_decontamination": op10_benchmark_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {"op2_line_dedup": OP2_SQL, "op8_substring_dedup": OP8_SQL, "op10_benchmark_decontamination": OP10_SQL}
