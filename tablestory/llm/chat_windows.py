"""Formatting conversations for training, in windows of a token budget.

Everything is DataFrame functions. Prefix sums of turn tokens cut a conversation into spans of
whole turns: with S = (budget - system turn - history) / 2, a turn of at most S tokens belongs to
the span its prefix sum falls in by steps of S, so a span holds at most 2 S; a longer turn is a
span of its own. A window is the system turn, whole turns before the span of at most ``history``
tokens, and the span. Repeated turns are masked: every assistant turn is a target exactly once.
A turn beyond the budget makes one window beyond the budget; nothing is cut or dropped.

    <|im_start|>role\\ntext<|im_end|>\\n

Inside texts and roles ``\\`` becomes ``\\\\`` and ``<|`` becomes ``<\\|``, so no control string
survives; a line feed in a role becomes ``<|nl|>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

START, END, FEED = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
_TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
_MARKERS = 4


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def count_tokens(text: Column) -> Column:
    """Words and single signs, plus the markers of a turn."""
    return F.regexp_count(text, F.lit(_TOKEN)) + _MARKERS


def format_windows(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                   budget: int = 1024, history: int = 192) -> DataFrame:
    """One row per window: ``conv_id, window, formatted, n_repeated, n_tokens, loss``.

    ``loss`` holds (start, length) of every target in ``formatted``, in code points from 0;
    ``n_repeated`` turns at its start were given before. Turns come in the order of ``turn``, then
    role and text; null text and role are empty, null conversation ids are one conversation.
    The first turn is retained in every window if its role is ``system``.
    """
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                        F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("tokens", count_tokens(F.col("text"))).withColumn("pos", F.row_number().over(order))
    rows = rows.withColumn("head", (F.col("pos") == 1) & (F.col("role") == "system"))
    own = F.when(F.col("head"), 0).otherwise(F.col("tokens")).cast("bigint")
    rows = rows.withColumns({
        "before": F.sum(own).over(upto) - own,
        "share": F.greatest(F.lit(1), F.floor((F.lit(budget - history) - F.first(F.when(F.col("head"), F.col("tokens")).otherwise(0)).over(upto)) / 2)),
    })
    long = (F.col("tokens") > F.col("share")) & ~F.col("head")
    rows = rows.withColumn("long", long.cast("int")).withColumn("block", 2 * F.sum("long").over(upto) - F.col("long"))
    rows = rows.withColumn("step", F.when(F.col("long") == 1, 0).otherwise(F.floor(F.col("before") / F.col("share"))))
    here, last = F.struct("block", "step"), F.lag(F.struct("block", "step")).over(order)
    first = F.coalesce(F.lag("head").over(order), F.lit(True)) | (here != last)
    rows = rows.withColumn("new", F.when(F.col("head"), 0).otherwise(first.cast("int")))
    rows = rows.withColumn("span", F.sum("new").over(upto) - 1)
    whole = Window.partitionBy("conv_id")
    rows = rows.withColumn("last", F.greatest(F.max("span").over(whole), F.lit(0)))
    rows = rows.withColumn("end", F.max(F.col("before") + own).over(Window.partitionBy("conv_id", "span")))
    again = (F.col("span") < F.col("last")) & (F.col("end") - F.col("before") <= F.least(F.lit(history), F.col("share")))
    place = lambda at, fresh: F.struct(at.cast("bigint").alias("window"), fresh.alias("fresh"))
    places = F.when(F.col("head"), F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("last")), lambda w: place(w, w == 0)))
    places = places.when(again, F.array(place(F.col("span"), F.lit(True)), place(F.col("span") + 1, F.lit(False))))
    places = places.otherwise(F.array(place(F.col("span"), F.lit(True))))
    opening = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit(FEED)), F.lit("\n"))
    pieces = rows.select("conv_id", "pos", "role", "tokens", opening.alias("opening"), escape(F.col("text")).alias("inner"),
                         F.explode(places).alias("at")).select("*", "at.window", "at.fresh")
    pieces = pieces.withColumn("piece", F.concat("opening", "inner", F.lit(END)))
    length = F.length("piece").cast("bigint")
    inside = Window.partitionBy("conv_id", "window").orderBy("pos")
    pieces = pieces.withColumn("start", F.sum(length).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - length + F.length("opening"))
    target = F.when(F.col("fresh") & (F.col("role") == "assistant"),
                    F.struct("start", F.length("inner").cast("bigint").alias("length")))
    return pieces.groupBy("conv_id", "window").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda p: p.piece), "").alias("formatted"),
        F.sum((~F.col("fresh")).cast("int")).alias("n_repeated"), F.sum("tokens").alias("n_tokens"),
        F.array_sort(F.collect_list(target)).alias("loss"))


def read_windows(windows: DataFrame) -> DataFrame:
    """Per window, what was formatted: the turns given first there, and the texts under its loss mask, unescaped."""
    parts = F.split(F.substring(F.col("formatted"), F.lit(len(START) + 1), F.length("formatted")), r"<\|im_start\|>")
    fresh = F.slice(parts, F.col("n_repeated") + 1, F.size(parts))

    def turn(part: Column) -> Column:
        head = F.substring_index(part, "\n", 1)
        inner = F.substring(part, F.length(head) + 2, F.length(part) - F.length(head) - 1 - len(END))
        return F.struct(unescape(F.replace(head, F.lit(FEED), F.lit("\n"))).alias("role"), unescape(inner).alias("text"))

    def lost(span: Column) -> Column:
        return unescape(F.substring(F.col("formatted"), (span.start + 1).cast("int"), span.length.cast("int")))

    return windows.select("conv_id", "window", "formatted", F.transform(fresh, turn).alias("turns"),
                          F.transform("loss", lost).alias("targets"))


def digest_windows(windows: DataFrame) -> DataFrame:
    """Per conversation, counts and digests of what its windows give back.

    A digest is over a whole conversation, so its text meets in one row; a window never does so.
    """
    said = lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))
    read = read_windows(windows).select(
        "conv_id", "window", F.size("turns").alias("n"), F.array_join(F.transform("turns", said), "").alias("turns"),
        F.array_join("targets", "").alias("loss"), F.length("formatted").cast("bigint").alias("chars"))
    whole = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("window", c))), lambda w: w[c]), "")
    return read.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), whole("turns").alias("turns"), whole("loss").alias("loss"), F.sum("chars").alias("formatted_chars"),
    ).select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"),
             F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
