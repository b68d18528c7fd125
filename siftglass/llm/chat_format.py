r"""Chat formatting in budgeted windows, with Spark expressions alone.

Turns cost tokens: those of a column, or their words plus a fixed number for the template.  Prefix sums of these
costs choose the windows: a window takes turns as long as they fit into the budget beside what it repeats, which
is the system turn and the last turns of the window before, as far as the history limit goes.  So windows begin
and end with turns and are as full as their turns allow.  Repeated turns are outside the loss mask.

A turn reads ``### role: text</turn>`` and a line feed.  In roles and texts ``\``, ``<`` and ``#`` become
``\b``, ``\l`` and ``\h`` (and ``:`` in roles ``\c``), so neither mark can occur inside and the way back is
unambiguous.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 512
HISTORY = 128
TURN_TOKENS = 4
OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>\n"


def escape(text: Column, role: bool = False) -> Column:
    """A text in which no mark of the template can occur."""
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


def unescape(text: Column) -> Column:
    """The text that ``escape`` was given."""
    out = F.replace(F.replace(F.replace(text, F.lit("\\c"), F.lit(":")), F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<"))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def format_windows(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    budget: int = BUDGET,
    history: int = HISTORY,
    tokens_col: str | None = None,
) -> DataFrame:
    """One row per window: ``conv_col, window`` (from 1), ``n_repeated, n_turns, n_tokens, formatted, loss_spans``.

    ``n_repeated`` of the ``n_turns`` turns, the first ones, stand in an earlier window already.
    ``loss_spans`` are (first, last + 1) code points of ``formatted``: the escaped texts of the assistant
    turns that are new in this window.  Turns are ordered by number, then role, then text; equal rows are
    turns of their own.  Null roles and texts are empty; rows with a null conversation are one conversation;
    turns with a null number come first.  The system turn is the first turn if its role is ``system``.  An empty
    table gives an empty result.

    ``n_tokens`` are the costs of a window's turns: ``tokens_col`` (null: 0) if it is given, as a tokenizer's counts;
    else words plus TURN_TOKENS.  No window is over the budget if the system turn and the largest other turn fit into it
    together.  History that doesn't fit beside the next turn isn't repeated; a turn that doesn't fit at all
    stays whole, in a window of its own over the budget.
    """
    words = F.size(F.array_remove(F.split(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), "[ \\t-\\r]+"), "")) + TURN_TOKENS
    #: A struct is never null itself, so the join below needs no other partitioning than the windows before it.
    turns = conversations.select(
        F.struct(F.col(f"`{conv_col}`").alias("id")).alias("c"),
        F.col(f"`{turn_col}`").alias("t"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        (words if tokens_col is None else F.coalesce(F.col(f"`{tokens_col}`"), F.lit(0))).cast("long").alias("tokens"),
    )
    order = Window.partitionBy("c").orderBy("t", "role", "text")
    turns = turns.withColumn("at", F.row_number().over(order)).withColumn(
        "before", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    )
    turns = turns.withColumn("system", F.first(F.when(F.col("role") == "system", F.struct("role", "text", "tokens"))).over(order))
    near = Window.partitionBy("c").orderBy("before").rangeBetween(-history, 0)
    turns = turns.withColumn("past", F.col("before") - F.min("before").over(near))

    #: Where windows start and how many tokens of history they repeat, from each conversation's costs alone.
    costs = turns.groupBy("c").agg(
        F.sort_array(F.collect_list(F.struct("at", "tokens", "before", "past"))).alias("costs"), F.coalesce(F.max("system.tokens"), F.lit(0).cast("long")).alias("held")
    )
    start = lambda at, before, repeated: F.struct(at.cast("int").alias("at"), before.cast("long").alias("before"), repeated.cast("long").alias("repeated"))

    def packed(state: Column, x: Column) -> Column:
        past = F.least(x["past"], x["before"] - state["floor"])
        past = F.when(F.col("held") + past + x["tokens"] <= budget, past).otherwise(F.lit(0).cast("long"))
        fits = (x["at"] == 1) | (state["used"] + x["tokens"] <= budget)
        return F.struct(
            F.when(fits, state["used"] + x["tokens"]).otherwise(F.col("held") + past + x["tokens"]).alias("used"),
            F.when(fits, state["floor"]).otherwise(x["before"]).alias("floor"),
            F.when(fits, state["starts"]).otherwise(F.concat(state["starts"], F.array(start(x["at"], x["before"], past)))).alias("starts"),
        )

    zero = F.lit(0).cast("long")
    first = F.struct(zero.alias("used"), F.col("held").alias("floor"), F.array(start(F.lit(1), zero, zero)).alias("starts"))
    starts = costs.select("c", F.size("costs").alias("n"), F.aggregate("costs", first, packed, lambda s: s["starts"]).alias("starts"))
    until = lambda k: F.coalesce(F.get(F.col("starts"), k + 1)["at"], F.col("n") + 1)
    starts = starts.withColumn("windows", F.flatten(F.transform("starts", lambda s, k: F.array_repeat(k + 1, until(k) - s["at"]))))
    turns = turns.join(starts, "c").withColumn("window", F.get("windows", F.col("at") - 1))
    turns = turns.withColumn("following", F.get("starts", F.col("window"))).withColumn("opens", F.get("starts", F.col("window") - 1)["at"] == F.col("at"))

    own = F.struct("window", F.col("at").cast("long").alias("seq"), F.lit(True).alias("new"), "role", "text", "tokens")
    again = F.struct(
        F.col("window"), F.lit(0).cast("long").alias("seq"), F.lit(False).alias("new"), F.col("system.role").alias("role"), F.col("system.text").alias("text"), F.col("system.tokens").alias("tokens")
    )
    repeated = F.struct(
        (F.col("window") + 1).alias("window"), F.col("at").cast("long").alias("seq"), F.lit(False).alias("new"), "role", "text", "tokens"
    )
    is_system = F.col("system").isNotNull() & (F.col("at") == 1)
    stays = F.col("before") >= F.col("following.before") - F.col("following.repeated")
    parts = F.array_compact(
        F.array(
            own,
            F.when(F.col("opens") & (F.col("window") > 1) & F.col("system").isNotNull(), again),
            F.when(F.coalesce(stays, F.lit(False)) & ~is_system, repeated),
        )
    )
    rows = turns.select("c", F.explode(parts).alias("x")).select("c", "x.*")
    head = F.concat(F.lit(OPEN), escape(F.col("role"), True), F.lit(BETWEEN))
    rows = rows.withColumn("head", head).withColumn("body", escape(F.col("text")))
    rows = rows.withColumn("turn_text", F.concat("head", "body", F.lit(CLOSE)))
    before = Window.partitionBy("c", "window").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("turn_text")).over(before), F.lit(0)) + F.length("head"))
    span = F.when(F.col("new") & (F.col("role") == "assistant"), F.array(F.col("start"), F.col("start") + F.length("body")))
    rows = rows.withColumn("span", span)
    grouped = rows.groupBy("c", "window").agg(
        F.sum(F.when(F.col("new"), 0).otherwise(1)).alias("n_repeated"),
        F.count("*").alias("n_turns"),
        F.sum("tokens").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("seq", "turn_text", "span"))).alias("parts"),
    )
    return grouped.select(
        F.col("c.id").alias(conv_col),
        F.col("window").cast("long").alias("window"),
        "n_repeated",
        "n_turns",
        "n_tokens",
        F.array_join(F.transform("parts", lambda p: p["turn_text"]), "").alias("formatted"),
        F.array_compact(F.transform("parts", lambda p: p["span"])).alias("loss_spans"),
    )


def read_back(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row per conversation from its windows: ``conv_col, n_turns, turns, loss, formatted_chars``.

    ``turns`` are the (role, text) pairs without repetitions, ``loss`` the unescaped texts under the loss
    mask, both in order.  What was null reads as empty; windows with a null conversation are one conversation;
    a conversation without windows has no row, and an empty table gives an empty result.
    """
    pieces = F.slice("cut", F.col("n_repeated").cast("int") + 1, F.greatest(F.size("cut") - 1 - F.col("n_repeated").cast("int"), F.lit(0)))

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, BETWEEN, 1)
        return F.struct(
            unescape(F.substring(role, len(OPEN) + 1, 1 << 30)).alias("role"),
            unescape(F.substring(piece, F.length(role) + len(BETWEEN) + 1, F.lit(1 << 30))).alias("text"),
        )

    parsed = windows.select(F.col(f"`{conv_col}`").alias("c"), "window", "n_repeated", "formatted", "loss_spans").withColumn(
        "cut", F.split("formatted", F.lit(CLOSE))
    )
    parsed = parsed.select(
        "c",
        F.length("formatted").cast("long").alias("size"),
        F.struct(
            "window",
            F.transform(pieces, turn).alias("turns"),
            F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s[0] + 1).cast("int"), (s[1] - s[0]).cast("int")))).alias("loss"),
        ).alias("w"),
    )
    whole = parsed.groupBy("c").agg(F.sort_array(F.collect_list("w")).alias("w"), F.sum("size").alias("formatted_chars"))
    whole = whole.select(
        "c",
        F.flatten(F.transform("w", lambda x: x["turns"])).alias("turns"),
        F.flatten(F.transform("w", lambda x: x["loss"])).alias("loss"),
        "formatted_chars",
    )
    return whole.select(F.col("c").alias(conv_col), F.size("turns").cast("long").alias("n_turns"), "turns", "loss", "formatted_chars")
