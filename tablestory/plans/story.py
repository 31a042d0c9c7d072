"""From a table to a short, varied set of findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import fixed
from ..functions.names import capitalize, lower_first, name_stems, plural_label, question_stems, humanize_name
from ..functions.shown import format_count, format_day, format_number, format_share, half_up
from ..operators.profile import TableProfile, profile_table
from .kinds import Field, ranked_measures
from .views import ROW, Breadth, Noun, View, aggregate_name, candidate_views


# --- tiles -----------------------------------------------------------------------------------
Tile = tuple[str, str, str | None]


def _size_tile(profile: TableProfile, noun: Noun) -> Tile:
    return capitalize(noun.plural), format_count(profile.row_count), None


def _lead_tile(profile: TableProfile, noun: Noun) -> Tile | None:
    """The total of the first measure that adds up, or the mean of the first one."""
    lead = next(iter(ranked_measures(profile.fields)), None)
    if lead is None:
        return None
    total, mean, low, high = (format_number(v, lead.unit) for v in (lead.sum, lead.mean, lead.min, lead.max))
    details = {True: (total, f"{mean} per {noun.singular}"), False: (mean, f"Range {low} to {high}")}
    return aggregate_name(lead, lead.additive), *details[bool(lead.additive)]


#: (from how many days on, days in one, its name), the longest first.
_SPANS = ((730.5, 365.25, "years"), (120 + 1, 30.44, "months"), (0, 1, "days"))


def _span_tile(profile: TableProfile, noun: Noun) -> Tile | None:
    time = next((f for f in profile.of_kind("time")[:1] if f.present > 1), None)
    if time is None:
        return None
    days = half_up((time.time_max - time.time_min).total_seconds() / 86_400) + 1
    size, name = next((size, name) for least, size, name in _SPANS if days >= least)
    count = format_count(days) if size == 1 else half_up(days / size)
    return "Time span", f"{count} {name}", f"{format_day(time.time_min)} to {format_day(time.time_max)}"


def _entity_tile(profile: TableProfile, noun: Noun) -> Tile | None:
    found = [(f"Distinct {plural_label(f.label)}", format_count(f.distinct), None) for f in profile.of_kind("entity")]
    return found[0] if found else None


def _flag_tile(profile: TableProfile, noun: Noun) -> Tile | None:
    """The flag that is set most often, by share of the rows that have it."""
    most = max(profile.of_kind("flag"), key=lambda f: f.yes / f.present, default=None)
    return most and (most.label, format_share(most.yes / most.present), f"{format_count(most.yes)} of {format_count(most.present)} {noun.plural}")


def _leader_tile(profile: TableProfile, noun: Noun) -> Tile | None:
    """The first category whose first label is 15 % ahead of the second."""
    for f in profile.of_kind("category"):
        counts = [n for _, n in f.top[:2]]
        if len(counts) == 2 and counts[0] >= 1.15 * counts[1]:
            return f"Top {lower_first(f.label)}", f.top[0][0], f"{format_share(counts[0] / f.present)} of {noun.plural}"
    return None


#: Headline figures by rank.
_TILES = (_size_tile, _lead_tile, _span_tile, _entity_tile, _flag_tile, _leader_tile)


def kpis(profile: TableProfile, noun: Noun = ROW, most: int | None = 4) -> list[Tile]:
    """(label, value, detail) of the ``most`` first headline figures the table has (None: all), from its profile alone."""
    made = [tile(profile, noun) for tile in _TILES]
    return [t for t in made if t][:most]


# --- choice ----------------------------------------------------------------------------------
def pick_diverse(
    scores: list[float], kinds: list[str], fields: list[list[str]], measures: set[str], k: int = fixed.MAX_STORY_VIEWS
) -> list[int]:
    """Positions of the strongest findings, each later pick discounted for what is already there."""
    left = [i for i, s in enumerate(scores) if s >= fixed.MIN_SCORE]
    column_use: dict[str, int] = {}
    kind_use: dict[str, int] = {}
    picked: list[int] = []

    def worth(i: int) -> float:
        used = kind_use.get(kinds[i], 0)
        if used >= fixed.KIND_LIMIT.get(kinds[i], k):
            return 0.0
        value = scores[i] * 0.85 ** used
        for f in fields[i]:
            value *= (0.9 if f in measures else 0.6) ** column_use.get(f, 0)
        return value

    while left and len(picked) < k:
        best = max(left, key=worth)  # the first of equal candidates
        if worth(best) <= 0 or worth(best) < fixed.MIN_FILL:
            break
        left.remove(best)
        picked.append(best)
        kind_use[kinds[best]] = kind_use.get(kinds[best], 0) + 1
        for f in fields[best]:
            column_use[f] = column_use.get(f, 0) + 1
    return picked


def diversified_top_k(
    df: DataFrame, by: str, item: str, score: str, kind: str, fields: str, measures: str, position: str,
    k: int = fixed.MAX_STORY_VIEWS,
) -> DataFrame:
    """(by, item, pick): the diversified choice for every table of a catalogue, tables in parallel.

    A group holds the candidates of one table, a number bounded by its columns. The choice is a fold over
    the picks: what a candidate is still worth follows from the kinds and columns picked before it.
    """
    row = F.struct(F.col(position).alias("position"), F.col(item).alias("item"), F.col(score).cast("double").alias("score"),
                   F.col(kind).alias("kind"), F.col(fields).alias("fields"))
    tables = df.groupBy(by).agg(
        F.sort_array(F.collect_list(row)).alias("all"), F.array_distinct(F.flatten(F.collect_list(F.coalesce(measures, F.array().cast("array<string>"))))).alias("known"))
    limits = F.create_map(*[F.lit(x) for pair in fixed.KIND_LIMIT.items() for x in pair])
    every = F.col("all")

    def worth(i: Column, picks: Column) -> Column:
        own = F.get(every, i)
        used = F.size(F.filter(picks, lambda p: F.get(every, p)["kind"] == own["kind"]))
        seen = F.flatten(F.transform(picks, lambda p: F.get(every, p)["fields"]))
        discounted = F.aggregate(own["fields"], own["score"] * F.pow(F.lit(0.85), used), lambda value, f: value * F.pow(
            F.when(F.array_contains("known", f), 0.9).otherwise(0.6), F.size(F.filter(seen, lambda g: g == f))))
        return F.when(used >= F.coalesce(F.try_element_at(limits, own["kind"]), F.lit(k)), 0.0).otherwise(discounted)

    def step(picks: Column, _: Column) -> Column:
        left = F.filter(F.sequence(F.lit(0), F.size("all") - 1), lambda i: (F.get(every, i)["score"] >= fixed.MIN_SCORE) & ~F.array_contains(picks, i))
        # The first of equal candidates.
        best = F.array_max(F.transform(left, lambda i: F.struct(worth(i, picks).alias("worth"), (-i).alias("back"))))
        good = (best["worth"] > 0) & (best["worth"] >= fixed.MIN_FILL)
        return F.when(F.coalesce(good, F.lit(False)), F.concat(picks, F.array(-best["back"]))).otherwise(picks)

    chosen = tables.withColumn("picks", F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.array().cast("array<int>"), step))
    return chosen.select(by, "all", F.posexplode("picks").alias("at", "pick")).select(
        by, F.get(F.col("all"), F.col("pick"))["item"].alias(item), (F.col("at") + 1).cast("bigint").alias("pick"))


def select_views(views: list[View], profile: TableProfile, k: int = fixed.MAX_STORY_VIEWS, scores: list[float] | None = None) -> list[View]:
    measures = {f.name for f in profile.fields if f.kind == "measure"}
    scores = scores if scores is not None else [v.score for v in views]
    return [views[i] for i in pick_diverse(scores, [v.kind for v in views], [v.fields for v in views], measures, k)]


def arrange_views(views: list[View]) -> list[View]:
    """Wide views first, then bars, then plots; an odd last one of three or more is left out."""
    narrow = [v.view_id for v in views if not v.wide]
    single = narrow[-1:] if len(narrow) in range(3, len(narrow) + 1, 2) else []
    shown = [v for v in views if v.view_id not in single]
    return sorted(shown, key=lambda v: (not v.wide, not v.wide and v.chart != "bars"))


def arrange_catalogue(views: DataFrame, by: str, item: str, position: str, kind: str, chart: str) -> DataFrame:
    """(by, item, place): ``arrange_views`` for every catalogue of a frame; a catalogue is a handful of rows."""
    own = Window.partitionBy(by)
    place = arrange_order(F.col(kind), F.col(chart))
    ranked = views.withColumn("__order", place).withColumn("__narrow", F.count_if(F.col("__order") > 0).over(own)).withColumn(
        "__later", F.count_if(F.col("__order") > 0).over(own.orderBy(F.desc(position)).rowsBetween(Window.unboundedPreceding, -1)))
    odd = (F.col("__narrow") >= 3) & (F.col("__narrow") % 2 == 1) & (F.col("__order") > 0) & (F.col("__later") == 0)
    return ranked.where(~odd).select(by, item, F.row_number().over(own.orderBy("__order", position)).cast("bigint").alias("place"))


def arrange_order(kind: Column, chart: Column) -> Column:
    """The sort key of ``arrange_views`` for a catalogue frame."""
    return F.when(kind.isin("map", "trend", "sequence"), 0).when(chart == "bars", 1).otherwise(2)


# --- questions ---------------------------------------------------------------------------------
def column_stems(profile: TableProfile) -> list[tuple[str, int, str]]:
    """(column, position, stem) of every column name, and of the labels of small columns."""
    stems = []
    for i, f in enumerate(profile.fields):
        words = set(question_stems(f.name))
        if f.kind in ("category", "ordinal"):
            words |= {w for label, _ in f.top for w in question_stems(label)}
        stems += [(f.name, i, w) for w in sorted(words)]
    return stems


def stem_column(word: Column, past_tense: bool = True) -> Column:
    """Cut common endings of lower-case words."""
    size = F.length(word)
    cut = F.when((size > 5) & word.endswith("ing"), F.substring(word, F.lit(1), size - 3))
    cut = cut.when((size > 4) & word.endswith("ies"), F.concat(F.substring(word, F.lit(1), size - 3), F.lit("y")))
    cut = cut.when((size > 4) & word.endswith("es"), F.substring(word, F.lit(1), size - 2))
    cut = cut.when((size > 3) & word.endswith("s"), F.substring(word, F.lit(1), size - 1))
    if past_tense:
        cut = cut.when((size > 4) & word.endswith("ed"), F.substring(word, F.lit(1), size - 2))
    return cut.otherwise(word)


def _words(text: Column) -> Column:
    spaced = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda w: F.length(w) > 0)


def asked_stems(questions: DataFrame, key: str, text: str) -> DataFrame:
    """(key, stem): the words of every question that can name a column."""
    words = questions.select(F.col(key), F.explode(F.array_distinct(_words(F.col(text)))).alias("word"))
    kept = words.where((F.length("word") >= 3) & ~F.col("word").isin(sorted(fixed.STOP_WORDS)))
    return kept.select(key, stem_column(F.col("word")).alias("stem")).distinct()


def match_columns(questions: DataFrame, key: str, text: str, profile: TableProfile) -> DataFrame:
    """(key, column, position): the columns each question names, by name or by a label.

    The stems of one table are few (its columns and their top labels), so they
    are broadcast to the questions.
    """
    spark = questions.sparkSession
    stems = spark.createDataFrame(column_stems(profile) or [("", -1, "")], "column string, position int, stem string")
    asked = asked_stems(questions, key, text)
    return asked.join(F.broadcast(stems), "stem").select(key, "column", "position").distinct()


def answered_by_columns(
    questions: DataFrame, key: str, text: str, kind: str, classes: str, profile: TableProfile
) -> DataFrame:
    """(key, columns, reason): questions the table's own columns already answer."""
    have = [(f.name, humanize_name(f.name), f.kind, name_stems(f.name)) for f in profile.fields]
    listed = F.array(*[
        F.struct(F.lit(label).alias("label"), F.array(*map(F.lit, stems)).alias("stems"))
        for _, label, _, stems in have
    ])
    q = questions.select(
        key, F.coalesce(F.col(classes), F.array().cast("array<string>")).alias("classes"), F.col(kind).alias("kind"),
        F.split(F.col(text), fixed.GIVEN_CLAUSE)[0].alias("subject"),
    )

    def stems_of(c: Column) -> Column:
        return F.transform(_words(c), lambda w: stem_column(w, past_tense=False))

    # The first column whose name holds every word of a class.
    q = q.withColumn("class_stems", F.transform("classes", stems_of)).withColumn("subject_stems", stems_of(F.col("subject")))
    named = F.transform("class_stems", lambda c: F.try_element_at(F.filter(
        listed, lambda col: (F.size(c) > 0) & (F.size(F.array_except(c, col["stems"])) == 0)
    ), F.lit(1))["label"])
    by_class = (
        (F.col("kind").isNull() | ~F.col("kind").isin("probability", "score")) & (F.size("classes") >= 2)
        & F.forall("named", lambda n: n.isNotNull())
    )
    flags = [(label, stems) for _, label, k, stems in have if k == "flag" and stems]
    recorded = F.array(*[
        F.struct(F.lit(label).alias("label"), F.array(*map(F.lit, stems)).alias("stems")) for label, stems in flags
    ]) if flags else F.array().cast("array<struct<label:string,stems:array<string>>>")
    hits = F.transform(
        F.filter(recorded, lambda col: F.size(F.array_except(col["stems"], F.col("subject_stems"))) == 0),
        lambda col: col["label"],
    )
    by_flag = ((F.col("kind") == "probability") | (F.size("classes") < 2)) & (F.size("hits") > 0)
    marked = q.withColumn("named", named).withColumn("hits", hits)
    return marked.select(
        key,
        F.when(by_class, F.array_distinct("named")).when(by_flag, F.col("hits")).alias("columns"),
        F.when(by_class, "classes-name-columns").when(by_flag, "asks-for-existing-column").alias("reason"),
    ).where("reason is not null")


def matched_fields(question: str, profile: TableProfile) -> list[Field]:
    """The same match for one question, over the profile the driver already holds."""
    asked = set(question_stems(question))
    named = {column for column, _, word in column_stems(profile) if word in asked}
    return [f for f in profile.fields if f.name in named]


def focus_views(views: list[View], matched: list[Field], profile: TableProfile, k: int, most: int = 4) -> list[View]:
    """Views about the named columns first, up to ``most``; the rest of the choice follows."""
    names = {f.name for f in matched}
    shares = {v.view_id: (sum(f in names for f in v.fields), len(v.fields)) for v in views}
    named_ones = [v for v in views if shares[v.view_id][0]]
    bonus = [named_in + 0.5 * (named_in == size) for named_in, size in (shares[v.view_id] for v in named_ones)]
    chosen = select_views(named_ones, profile, min(most, k), [v.score + more for v, more in zip(named_ones, bonus)])
    others = [v for v in views if v.view_id not in {c.view_id for c in chosen}]
    return chosen + select_views(others, profile, k - len(chosen))


# --- the story -----------------------------------------------------------------------------------
@dataclass
class Story:
    kpis: list[tuple[str, str, str | None]]
    views: list[View]
    profile: TableProfile
    noun: Noun
    focus: list[str] | None = None

    def catalogue(self, spark: SparkSession) -> DataFrame:
        """One row per view, in the order it is shown."""
        return catalogue(spark, self.views)

    def result(self, view_id: str) -> DataFrame:
        return next(v.result for v in self.views if v.view_id == view_id)


def catalogue(spark: SparkSession, views: list[View]) -> DataFrame:
    rows = [
        (i + 1, v.view_id, v.kind, v.title, v.subtitle, v.footnote, list(v.fields), float(v.score), v.chart)
        for i, v in enumerate(views)
    ]
    return spark.createDataFrame(
        rows, "position int, view_id string, kind string, title string, subtitle string, footnote string, "
        "fields array<string>, score double, chart string",
    )


def story(
    df: DataFrame, noun: Noun = ROW, question: str | None = None, max_views: int = fixed.MAX_STORY_VIEWS,
    order_by: list[str] | None = None, breadth: Breadth = Breadth(), tiles: int | None = 4,
) -> Story:
    """Profile a table and pick what is worth saying about it.

    ``breadth`` says how many measures are compared, ``tiles`` how many headline figures there are; None is all.
    """
    profile = profile_table(df, order_by)
    if profile.row_count == 0:
        return Story([], [], profile, noun)
    views = candidate_views(df, profile, noun, breadth)
    matched = matched_fields(question, profile) if question else []
    if matched:
        chosen = focus_views(views, matched, profile, max_views)
    else:
        chosen = arrange_views(select_views(views, profile, max_views))
    focus = [f.label for f in matched] if question and question.strip() else None
    return Story(kpis(profile, noun, tiles), chosen, profile, noun, focus)
