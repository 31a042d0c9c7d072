"""Tables of proposed questions: tidy them, drop those the data already answers, and merge lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed
from .ordering import row_index
from .profile import TableProfile, column_role, inferred_type
from .scoring import _unique_labels, question_kind
from ..session import pinned


def bounded_text(c: Column, limit: int) -> Column:
    """Text with single blanks, or null when empty or too long."""
    text = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when((F.length(text) > 0) & (F.length(text) <= limit), text)


def good_bad_classes(classes: Column) -> Column:
    """Whether the two classes are "good" and "bad" plays."""
    names = F.transform(classes, lambda c: F.regexp_replace(F.lower(F.trim(c)), r" plays?$", ""))
    return (F.size(classes) == 2) & (F.sort_array(names) == F.array(F.lit("bad"), F.lit("good")))


def junk_place_classes(classes: Column) -> Column:
    """Whether the classes only name the idea of a place or an activity."""
    names = F.transform(classes, lambda c: F.lower(F.trim(c)))
    both = F.array_contains(names, "location") & F.array_contains(names, "activity")
    return (F.size(classes) >= 2) & (both | F.forall(names, lambda c: c.isin(*fixed.JUNK_PLACE_CLASSES)))


def route_chart(
    kind: Column, text: Column, classes: Column, visual: Column | None = None, places: Column | None = None
) -> Column:
    """places, series or bars. ``places`` says that the table has places and an eating column."""
    stated = F.when(visual.isin("places", "series", "bars"), visual) if visual is not None else F.lit(None).cast("string")
    on_map = text.rlike(fixed.PLACE_EATING)
    if places is not None:
        on_map = on_map | places
    quality = text.rlike(fixed.PLAY_QUALITY) | F.coalesce(good_bad_classes(classes), F.lit(False))
    routed = (
        F.when(on_map, "places")
        .when(text.rlike(fixed.WIN_LIKELIHOOD), "series")
        .when(quality & ~kind.eqNullSafe(F.lit("choice")), "series")
        .when(kind == "choice", "bars")
        .when(kind.isin("probability", "score"), "series")
        .otherwise("bars")
    )
    return F.coalesce(stated, routed)


def pack_proposals(drafts: DataFrame, key: str, order_by: list[str]) -> DataFrame:
    """Trim and bound drafts, give them a kind, a chart and a unique id; drop unusable ones.

    ``drafts`` has (key, title, question, reason, kind, classes).
    """
    bounded = drafts.select(
        key, *order_by,
        bounded_text(F.col("title"), 80).alias("title"), bounded_text(F.col("question"), 500).alias("question"),
        F.coalesce(bounded_text(F.col("reason"), 240), F.lit("A named cut from this table.")).alias("reason"),
        F.when(F.col("kind").isin("probability", "score", "choice"), F.col("kind")).alias("stated"),
        F.slice(_unique_labels(F.coalesce("classes", F.array().cast("array<string>"))), 1, 16).alias("classes"),
    ).where("title is not null and question is not null")
    worded = (
        F.when(F.col("question").rlike(fixed.PLAY_QUALITY), "score")
        .when(F.col("question").rlike(fixed.WIN_LIKELIHOOD) | F.col("question").rlike(fixed.PLACE_EATING), "probability")
        .when(F.size("classes") >= 2, question_kind(F.col("question"))).otherwise("probability")
    )
    typed = bounded.withColumn("kind", F.coalesce("stated", worded)).drop("stated")
    chart = route_chart(F.col("kind"), F.col("question"), F.col("classes"))
    chart = F.when(chart == "places", F.when(F.col("kind") == "choice", "bars").otherwise("series")).otherwise(chart)
    usable = typed.withColumn("visual", chart).where(
        ~((F.col("kind") == "choice") | (F.col("visual") == "bars")) | (F.size("classes") >= 2)
    )
    # Written out once: numbering reads it more than once, and later filters should not repeat the work above.
    usable = pinned(usable)
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 40)
    slug = F.concat_ws("-", "visual", F.when(slug == "", "insight").otherwise(slug))
    numbered = row_index(usable.withColumn("__slug", slug), order_by, "__n", [key, "__slug"])
    unique = F.when(F.col("__n") == 0, F.col("__slug")).otherwise(F.concat_ws("-", "__slug", (F.col("__n") + 1).cast("string")))
    kept = F.when((F.col("visual") == "bars") | F.col("kind").isin("score", "choice"), F.col("classes")).otherwise(
        F.array().cast("array<string>")
    )
    return numbered.select(
        key, *order_by, unique.alias("proposal_id"), "title", "question", "reason", "kind", "visual", kept.alias("classes")
    )


def restates_columns(profile: TableProfile) -> Column:
    """Whether a proposal's classes are just the values of one column."""
    lists = []
    for f in profile.fields:
        role = column_role(f, inferred_type_of(f.dtype))
        labels = ["true", "false"] if f.kind == "flag" else [label for label, _ in f.top]
        if role in ("categorical", "boolean", "place") and 2 <= len(labels) <= 16:
            lists.append(sorted({label.lower() for label in labels}))
    names = F.array_sort(F.transform("classes", lambda c: F.lower(c)))
    if not lists:
        return F.lit(False)
    values = F.array(*[F.array(*map(F.lit, labels)) for labels in lists])
    return (F.size("classes") >= 2) & F.exists(values, lambda v: v == names)


def inferred_type_of(dtype: str) -> str:
    from pyspark.sql import types as T

    return inferred_type(T._parse_datatype_string(dtype)) if "<" not in dtype else "string"


def proposal_quality(proposals: DataFrame, profile: TableProfile, key: str = "proposal_id") -> DataFrame:
    """Leave out proposals that restate the table's columns or have an empty title."""
    from ..plans.story import answered_by_columns

    words = F.concat_ws(" ", "title", "reason")
    halves = F.forall("classes", lambda c: F.lower(F.trim(c)).isin("am", "pm"))
    charted = (F.col("kind") == "choice") | (F.col("visual") == "bars")
    junk = (
        F.col("title").rlike(fixed.CLASSIFY_BY_TITLE) | F.col("title").rlike(fixed.SHIFT_TITLE)
        | F.col("reason").rlike(fixed.TABLE_LABELS_REASON) | words.rlike(fixed.JUNK_TITLE_REASON)
        | F.lower(F.trim("title")).isin(*fixed.JUNK_TITLES) | (F.col("visual") == "places")
        | (charted & (F.size("classes").between(2, 4)) & halves) | (charted & restates_columns(profile))
        | junk_place_classes(F.col("classes"))
    )
    kept = proposals.where(~junk)
    known = answered_by_columns(kept, key, "question", "kind", "classes", profile).select(key)
    return kept.join(known, key, "left_anti")


def merge_proposals(
    first: DataFrame, others: DataFrame, key: str, order_by: list[str], limit: int = fixed.MAX_PROPOSALS
) -> DataFrame:
    """The first list before the others, one row per id, at most four per table."""
    both = first.withColumn("source", F.lit(0)).unionByName(others.withColumn("source", F.lit(1)), allowMissingColumns=True)
    place = F.struct("source", *order_by)
    rest = [c for c in both.columns if c not in (key, "proposal_id")]
    single = both.groupBy(key, "proposal_id").agg(F.min_by(F.struct(*rest), place).alias("__row"))
    single = single.select(key, "proposal_id", "__row.*")
    rank = F.row_number().over(Window.partitionBy(key).orderBy("source", *order_by, "proposal_id"))
    # The limit is applied before the shuffle as well, so a busy table is cut early.
    return single.withColumn("position", rank).where(F.col("position") <= limit)
