"""Quality rules: learned decision lists over text statistics, as Spark conditional expressions.

Statistics of a text are Spark expressions alone.  Rules are learned by sequential covering: conditions
"statistic beyond threshold" are added to a conjunction while they gain information on two thirds of the
labelled statistics, the conjunction is then pruned on the other third, kept if it is precise there, and
what it covers is set aside before the next one.  The finished list is one ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftglass.llm.common import written

#: Blanks are U+0020 and U+0009 to U+000D.
BLANKS = "[ \\t-\\r]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: Labelled rows that the rules are learned from, at most: those with the smallest digests of their id.
LABELLED_ROWS = 20_000
#: Thresholds tried for each statistic: the middles between so many of its quantiles in the labelled rows.
QUANTILES = 24
MOST_RULES = 8
MOST_CONDITIONS = 4
#: A rule stays only if at least this share of what it covers in the pruning rows is bad, ...
LEAST_PRECISION = 0.95
#: ... and it covers at least so many bad rows there.
LEAST_COVER = 3


def statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the statistics of its texts added as a struct column ``stats``.

    n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_distinct, n_upper, n_marks.
    A null text has no words and no lines: all zero.
    """
    inner = [f"c{i}" for i in range(len(df.columns))]
    text = F.coalesce(F.col("text"), F.lit(""))
    out = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, inner, strict=True)], F.col(f"`{text_col}`").cast("string").alias("text"))
    out = out.withColumn("words", F.array_remove(F.split(text, BLANKS), ""))
    out = out.withColumn(
        "h",
        F.when(
            F.size("words") > 2,
            F.transform(
                F.slice("words", F.lit(3), F.greatest(F.size("words") - 2, F.lit(0))),
                lambda w, i: F.xxhash64(F.get(F.col("words"), i), F.get(F.col("words"), i + 1), w),
            ),
        ),
    )
    #: Sorted by their full digests, equal windows are neighbours, however many words a text has.
    out = out.withColumn(
        "s",
        F.when(
            F.size(F.array_distinct("h")) < F.size("h"),
            F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("digest"), i.alias("at")))),
        ),
    )

    def repeated(x: Column, k: Column) -> Column:
        before, after = F.get(F.col("s"), k - 1), F.get(F.col("s"), k + 1)
        return F.coalesce(x["digest"] == before["digest"], F.lit(False)) | F.coalesce(x["digest"] == after["digest"], F.lit(False))

    out = out.withColumn("p", F.sort_array(F.transform(F.filter("s", repeated), lambda x: x["at"])))
    covered = F.aggregate(
        "p",
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.regexp_replace(line, BLANKS, "")) > 0)
    out = out.withColumn("lines", lines)
    size = F.length(text)
    stats = F.struct(
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, BLANKS, "")).cast("long").alias("word_chars"),
        (size - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        (size - F.length(F.regexp_replace(text, "[A-Z]", ""))).cast("long").alias("n_upper"),
        (size - F.length(F.regexp_replace(text, "[!?]", ""))).cast("long").alias("n_marks"),
    )
    #: A generator of one row: a later filter on a statistic must not be pushed below it, where the
    #: optimizer would put whole arrays in place of their names inside lambdas.
    return out.select(*inner, F.explode(F.array(stats)).alias("stats")).select(
        *[F.col(n).alias(c) for c, n in zip(df.columns, inner, strict=True)], "stats"
    )


def base_failed(stats: str = "stats") -> Column:
    """Fewer than 50 words, or more than half of them in repeated windows."""
    n, r = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (n < MIN_WORDS) | (100 * r > MAX_REPEATED_PERCENT * n)


#: The statistics that rules may test, as ratios of two counts.
RATIOS = {
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "repeated_lines": ("n_dup_lines", "n_lines"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "distinct_words": ("n_distinct", "n_words"),
    "upper_per_char": ("n_upper", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "words": ("n_words", None),
}


def ratio(name: str, stats: str = "stats") -> Column:
    """A testable statistic; 0 where its divisor is."""
    over, under = RATIOS[name]
    top = F.col(f"{stats}.{over}").cast("double")
    if under is None:
        return top
    by = F.col(f"{stats}.{under}").cast("double")
    return F.when(by > 0, top / by).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    """``statistic > threshold`` or, with ``above`` false, ``statistic <= threshold``."""

    statistic: str
    above: bool
    threshold: float

    def column(self, stats: str = "stats") -> Column:
        """The condition in Spark."""
        x = ratio(self.statistic, stats)
        return x > self.threshold if self.above else x <= self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; a text that one covers is bad, any other is good."""

    rules: tuple[tuple[Condition, ...], ...]

    def column(self, stats: str = "stats") -> Column:
        """Whether a text is good: one ordered conditional expression."""
        verdict: Column | None = None
        for rule in self.rules:
            test = rule[0].column(stats)
            for c in rule[1:]:
                test = test & c.column(stats)
            verdict = F.when(test, F.lit(False)) if verdict is None else verdict.when(test, F.lit(False))
        return F.lit(True) if verdict is None else verdict.otherwise(F.lit(True))

    def number(self, stats: str = "stats") -> Column:
        """The number of the first rule that covers a text, from 1; null if none does."""
        out: Column | None = None
        for k, rule in enumerate(self.rules, 1):
            test = rule[0].column(stats)
            for c in rule[1:]:
                test = test & c.column(stats)
            out = F.when(test, F.lit(k)) if out is None else out.when(test, F.lit(k))
        return F.lit(None).cast("int") if out is None else out

    def __str__(self) -> str:
        return "\n".join("bad if " + " and ".join(map(str, r)) for r in self.rules) or "all good"


#: A cell of the labelled statistics: bin of each statistic, bad rows, good rows.
Cell = tuple[tuple[int, ...], int, int]


def _cover(cells: list[Cell], rule: list[tuple[int, bool, int]]) -> tuple[int, int]:
    bad = good = 0
    for bins, b, g in cells:
        if all((bins[f] > t) == above for f, above, t in rule):
            bad += b
            good += g
    return bad, good


def _grow(cells: list[Cell], widths: list[int]) -> list[tuple[int, bool, int]]:
    """Add the condition of the highest gain until no good row is covered or nothing gains."""
    rule: list[tuple[int, bool, int]] = []
    inside = cells
    while len(rule) < MOST_CONDITIONS:
        p, n = sum(c[1] for c in inside), sum(c[2] for c in inside)
        if not p or not n:
            break
        before, best, chosen = math.log2(p / (p + n)), 1e-9, None
        for f, width in enumerate(widths):
            bad, good = [0] * (width + 1), [0] * (width + 1)
            for bins, b, g in inside:
                bad[bins[f]] += b
                good[bins[f]] += g
            above_p, above_n = p, n
            for t in range(width):
                above_p -= bad[t]
                above_n -= good[t]
                for above, q, m in ((True, above_p, above_n), (False, p - above_p, n - above_n)):
                    if q and (gain := q * (math.log2(q / (q + m)) - before)) > best:
                        best, chosen = gain, (f, above, t)
        if chosen is None:
            break
        rule.append(chosen)
        f, above, t = chosen
        inside = [c for c in inside if (c[0][f] > t) == above]
    return rule


def _prune(cells: list[Cell], rule: list[tuple[int, bool, int]]) -> list[tuple[int, bool, int]]:
    """The beginning of the rule with the best (bad - good) / (bad + good) on the pruning rows."""

    def worth(k: int) -> tuple[float, int]:
        p, n = _cover(cells, rule[:k])
        return ((p - n) / (p + n) if p + n else -1.0, -k)

    return rule[: -max(worth(k) for k in range(1, len(rule) + 1))[1]] if rule else rule


def learn(grow: list[Cell], prune: list[Cell], thresholds: dict[str, list[float]]) -> DecisionList:
    """Sequential covering over labelled statistics."""
    names = list(thresholds)
    widths = [len(thresholds[n]) for n in names]
    rules: list[tuple[Condition, ...]] = []
    while len(rules) < MOST_RULES:
        rule = _prune(prune, _grow(grow, widths))
        if not rule:
            break
        p, n = _cover(prune, rule)
        if p < LEAST_COVER or p < LEAST_PRECISION * (p + n):
            break
        rules.append(tuple(Condition(names[f], above, thresholds[names[f]][t]) for f, above, t in rule))
        outside = lambda c, rule=rule: not all((c[0][f] > t) == above for f, above, t in rule)
        grow, prune = [c for c in grow if outside(c)], [c for c in prune if outside(c)]
    return DecisionList(tuple(rules))


def fit(
    documents: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    rows: int = LABELLED_ROWS,
) -> DecisionList:
    """Rules from at most ``rows`` labelled texts (1 good, 0 bad; rows without id or label don't count).

    Spark joins the labelled ids to their texts, finds the thresholds and counts the cells; only these
    counts, at most one for each labelled row, come to the driver.  Without labels the list is empty.
    """
    key = F.xxhash64(F.col("id"))
    chosen = (
        labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isin(0, 1))
        .orderBy(key, "id", "label")
        .limit(rows)
    )
    texts = documents.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    known = statistics(texts.join(F.broadcast(chosen), "id"), "text")
    known = known.where(~base_failed())
    values = written(known.select("id", "label", *[ratio(n).alias(n) for n in RATIOS]), "labelled")
    shares = [(i + 0.5) / QUANTILES for i in range(QUANTILES)]
    found = values.agg(*[F.percentile_approx(n, shares, 1000).alias(n) for n in RATIOS]).first()
    if found is None or found[0] is None:
        return DecisionList(())
    #: Halfway between neighbouring quantiles: a rule then keeps its distance from both sides.
    thresholds = {n: [(a + b) / 2 for a, b in pairwise(sorted(set(found[n])))] for n in RATIOS}

    def bin_of(n: str) -> Column:
        return sum((F.when(F.col(n) > t, 1).otherwise(0) for t in thresholds[n]), F.lit(0))

    counted = (
        values.select((F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(3)) == 0).alias("prune"), "label", *[bin_of(n).alias(n) for n in RATIOS])
        .groupBy("prune", *RATIOS)
        .agg(F.sum(1 - F.col("label")).alias("bad"), F.sum("label").alias("good"))
        .collect()
    )
    cells: dict[bool, list[Cell]] = {False: [], True: []}
    for r in sorted(counted):
        cells[r["prune"]].append((tuple(r[n] for n in RATIOS), r["bad"], r["good"]))
    return learn(cells[False], cells[True], thresholds)


def quality_rules(
    documents: DataFrame, rules: DecisionList, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``id_col``, the statistics, ``base_failed``, ``rule`` and ``kept``.

    ``rule`` is the number of the rule that rejects the text, null if none does; ``kept`` is false if the
    base test fails or a rule rejects.  Null and empty texts have no words, so the base test fails.
    Repeated rows and null ids stay as they are; an empty table gives an empty result.
    """
    out = statistics(documents.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "text")
    out = out.select("id", "stats", base_failed().alias("base_failed"), rules.number().alias("rule"), rules.column().alias("good"))
    return out.select(
        F.col("id").alias(id_col), "stats.*", "base_failed", "rule", (~F.col("base_failed") & F.col("good")).alias("kept")
    )


def keep_good(documents: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` that pass the base test and that no rule rejects, with their own columns.

    Null and empty texts have no words and go; repeated rows stay or go together; a null id doesn't matter; columns
    may have any names; an empty table stays empty.
    """
    inner = [f"c{i}" for i in range(len(documents.columns))]
    plain = documents.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(documents.columns, inner, strict=True)])
    text = inner[documents.columns.index(text_col)]
    out = statistics(plain, text).where(~base_failed() & rules.column())
    return out.select(*[F.col(n).alias(c) for c, n in zip(documents.columns, inner, strict=True)])
