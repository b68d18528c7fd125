"""Line dedup by site-relative frequency.

Pages are grouped by host.  For every line, the pages of its host that contain it are divided by all pages
of the host; lines beyond a ratio are boilerplate and are dropped from every page of that host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftglass.llm.common import written

#: A line is boilerplate of a host if it stands in more than this share of the host's pages, ...
MAX_RATIO = 0.05
#: ... and in at least so many of them, or on a smaller host in more than half of its pages, but three at least: on few
#: pages a small share says nothing, and two pages with the same lines may be copies.
MIN_PAGES = 5
LEAST_PAGES = 3
#: What is cut off at the ends of a line before it is compared: U+0020 and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
#: Boilerplate of all hosts up to this many bytes is broadcast; more is joined to the pages by host and salt.
BROADCAST_BYTES = 8 << 20
#: Parts that a host's pages are dealt into for that join.
SALTS = 64


def host_of(url: Column) -> Column:
    """The host of a URL, lower-cased; null if it has none."""
    return F.lower(F.nullif(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1), F.lit("")))


def html_lines(html: Column) -> Column:
    """The text of a page, one line per element: scripts, styles and comments go, other tags end a line."""
    bare = F.regexp_replace(html, "(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", "")
    return F.regexp_replace(bare, "<[^>]*>", "\n")


def line_dedup(
    pages: DataFrame,
    host: Column,
    text: Column,
    id_col: str = "page_id",
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    keep: list[str] | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    copies_once: bool = False,
) -> DataFrame:
    """One row per page: ``id_col``, the columns ``keep``, ``n_lines, n_dropped, text``.

    Lines are cut at U+000A and compared without BLANKS at their ends, so that CRLF files and others agree; lines
    without other characters don't count and stay.  A line that stands several times on one page counts once for that page, and all its
    occurrences are dropped.  A page is a row: repeated rows are pages of their own.  Pages with a null host
    share no host, so none of their lines is dropped.  A null text stays null and has no lines.  An empty
    table gives an empty result.

    With ``copies_once``, rows of a host with identical texts are one page in both counts, and a text whose
    every line would go keeps them all: copies are no boilerplate, whatever share of a host they make up.

    The lines of a host beyond the ratio are at most its lines per page divided by the ratio, so the list
    that is joined to its pages stays short however many pages it has; counts are summed before the shuffle,
    and a host with a third of all pages is dealt out by the line.  All lists together are written first: if
    they are small they are broadcast and pages stay where they are, else each host's pages are dealt to SALTS
    parts, so that no host is one task.
    """
    keep = keep or []
    base = pages.select(
        F.col(f"`{id_col}`").alias("id"), host.alias("host"), text.alias("text"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    )
    lines = F.array_distinct(F.filter(F.transform(F.split("text", "\n"), _bare), lambda x: x != ""))
    hosted = base.where(F.col("host").isNotNull())
    once = hosted.select("host", "text").distinct() if copies_once else hosted
    counts = (
        once.where(F.col("text").isNotNull())
        .select("host", F.explode(lines).alias("line"))
        .groupBy("host", "line")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= min(min_pages, LEAST_PAGES))
    )
    n_pages = F.count_distinct(F.xxhash64("text"), F.xxhash64("text", F.lit(1))) if copies_once else F.count("*")
    totals = hosted.groupBy("host").agg(n_pages.alias("total"))
    enough = F.least(F.lit(min_pages), F.greatest(F.lit(LEAST_PAGES), F.floor(F.col("total") / 2) + 1))
    common = (
        counts.join(totals, "host").where((F.col("n") / F.col("total") > max_ratio) & (F.col("n") >= enough)).groupBy("host").agg(F.collect_set("line").alias("common"))
    )
    common = written(common, "boilerplate")
    size = common.select(F.sum(F.aggregate("common", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 16) + F.octet_length("host"))).first()
    if (size[0] or 0 if size else 0) <= broadcast_bytes:
        out = base.join(F.broadcast(common), "host", "left")
    else:
        salted = base.withColumn("salt", F.pmod(F.xxhash64("id", "text"), F.lit(SALTS)).cast("int"))
        out = salted.join(common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"], "left")
    empty = F.array().cast("array<string>")
    out = _held(out, "lines", F.coalesce(F.split("text", "\n"), empty))
    out = _held(out, "bare", F.transform("lines", _bare))
    #: The host's list is looked through once for a page, by hashing; lines are then compared with the few that it has.
    out = _held(out, "here", F.coalesce(F.array_intersect("bare", "common"), empty))
    stays = F.filter("lines", lambda x, k: ~F.array_contains(F.col("here"), F.get(F.col("bare"), k)))
    out = _held(out, "kept", F.when(F.size("here") > 0, stays).otherwise(F.col("lines")))
    if copies_once:
        out = _held(out.withColumnRenamed("kept", "left"), "kept", F.when(F.exists("left", lambda x: _bare(x) != ""), F.col("left")).otherwise(F.col("lines")))
    return out.select(
        F.col("id").alias(id_col),
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
        F.size(F.array_remove("bare", "")).cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.when(F.col("text").isNotNull(), F.array_join("kept", "\n")).alias("text"),
    )


def _held(df: DataFrame, name: str, array: Column) -> DataFrame:
    """``df`` with a column made once: a generator of one row keeps the optimizer from writing it into each lambda."""
    return df.select("*", F.explode(F.array(array)).alias(name))


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))
