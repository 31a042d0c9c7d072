"""Row scoring runs: what is left to do, what came back, and what may be reused."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import fixed
from ..functions.cells import let
from .ordering import Running, running

_PROBABILITIES = "map<string,double>"


def finite(c: Column) -> Column:
    """The number, or null when it is not finite."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _in_unit(c: Column) -> Column:
    return F.coalesce(finite(c).between(0, 1), F.lit(False))


# --- one answer ------------------------------------------------------------------------------
def map_total(probabilities: Column) -> Column:
    return F.aggregate(F.map_values(probabilities), F.lit(0.0), lambda a, x: a + x)


def rescale(probabilities: Column) -> Column:
    """Divide by the total when it is slightly off 1; null when it is far off."""
    total = map_total(probabilities)
    off = F.abs(total - 1)
    scaled = F.transform_values(probabilities, lambda k, v: v / total)
    return F.when(off > fixed.RESCALE_TOLERANCE, None).when(
        (off > fixed.UNIT_SUM_TOLERANCE) & (total > 0), scaled
    ).otherwise(probabilities)


def level_value(score: Column, levels: int | Column) -> Column:
    """A level number as a 0–1 value."""
    levels = F.lit(levels) if isinstance(levels, int) else levels
    return clamp01(score / F.greatest(F.lit(1), levels - 1))


def validate_results(
    df: DataFrame, kind: str, classes: list[str] | None = None
) -> DataFrame:
    """Check (value, selected_class, probabilities, confidence); bad rows keep a null value and an error code."""
    declared = F.array(*map(F.lit, classes)) if classes else F.array().cast("array<string>")
    bad_confidence = F.col("confidence").isNotNull() & ~_in_unit(F.col("confidence"))
    shares = F.map_values("probabilities")
    bad_shares = (
        F.col("probabilities").isNull() | (F.size(shares) < 2) | (F.size(shares) > fixed.CLASS_MAX_COUNT)
        | ~F.coalesce(F.forall(shares, _in_unit), F.lit(False))
    )
    off = F.abs(map_total(F.col("probabilities")) - 1) > fixed.UNIT_SUM_TOLERANCE
    chosen = F.col("selected_class")
    choice_error = (
        F.when(chosen.isNull() | (F.length(F.trim(chosen)) == 0), "NO_CLASS")
        .when(bad_shares, "BAD_PROBABILITIES")
        .when(off | ~F.map_contains_key("probabilities", chosen), "INCONSISTENT_PROBABILITIES")
        .when((F.size(declared) >= 2) & ~F.array_contains(declared, chosen), "UNKNOWN_CLASS")
        .when(bad_confidence, "BAD_CONFIDENCE")
    )
    error = F.when(F.col("kind") == "choice", choice_error).when(
        (F.col("kind") == "probability") & ~_in_unit(F.col("value")), "BAD_PROBABILITY"
    ).when((F.col("kind") == "score") & finite(F.col("value")).isNull(), "BAD_SCORE").when(
        (F.col("kind") == "score") & bad_confidence, "BAD_CONFIDENCE"
    )
    marked = df.withColumn("kind", F.lit(kind)).withColumn("error", error)
    value = F.when(F.col("error").isNull() & (F.col("kind") != "choice"), clamp01(F.col("value")))
    return marked.withColumn("value", value)


ANSWER_WRAPPERS = ("data", "result", "response", "body")


def parse_answers(df: DataFrame, column: str, name: str = "answer") -> DataFrame:
    """Add (model, type, value, choice, confidence, probabilities) read from the JSON a scorer returned.

    The answer may sit inside data/result/response/body and inside
    answers.classification or classification. Each layer is opened once, in
    its own step.
    """
    def opened(json: Column) -> Column:
        def inner(layer: Column) -> Column:
            found = F.coalesce(*[F.try_element_at(layer, F.lit(w)) for w in ANSWER_WRAPPERS])
            return F.nullif(F.regexp_extract(found, r"^(\{[\s\S]*)$", 1), F.lit(""))

        return F.coalesce(let(F.from_json(json, "map<string,string>"), inner), json)

    staged = df.withColumn("__envelope", opened(F.col(column)))
    staged = staged.withColumn("__envelope", opened(F.col("__envelope")))
    staged = staged.withColumn("__inside", F.coalesce(
        F.get_json_object("__envelope", "$.answers.classification"), F.get_json_object("__envelope", "$.answers[0]"),
        F.get_json_object("__envelope", "$.classification"), F.col("__envelope"),
    ))
    staged = staged.withColumn("__fields", F.from_json(opened(F.col("__inside")), "map<string,string>"))

    def get(field: str) -> Column:
        return F.try_element_at("__fields", F.lit(field))

    answer = F.struct(
        F.trim(F.get_json_object("__envelope", "$.model")).alias("model"),
        F.lower(F.trim(get("type"))).alias("type"),
        F.coalesce(get("probability"), get("score"), get("value")).try_cast("double").alias("value"),
        F.trim(get("choice")).alias("choice"),
        get("confidence").try_cast("double").alias("confidence"),
        F.from_json(get("probabilities"), _PROBABILITIES).alias("probabilities"),
    )
    return staged.select(*df.columns, answer.alias(name))


# --- a run -------------------------------------------------------------------------------------
RESULT_SCHEMA = "value double, selected_class string, probabilities map<string,double>, confidence double"


def score_rows(
    df: DataFrame, keys: list[str], scorer: Callable[[pd.DataFrame], pd.DataFrame], model: str = "scorer",
    concurrency: int | None = None,
) -> DataFrame:
    """Call a batch scorer on every row.

    The scorer gets a batch of rows and returns one row of (value,
    selected_class, probabilities, confidence) each; missing columns are null.
    A batch that fails is scored again by halves, so only the rows that fail by
    themselves get an error. A retried task calls the scorer again, so calls happen at least once;
    ``upsert_rows`` makes their results count once. ``concurrency`` is the
    number of tasks that score at the same time.
    """
    fields = T._parse_datatype_string(f"struct<{RESULT_SCHEMA.replace(' ', ':').replace(',:', ',')}>")
    schema = T.StructType(
        [df.schema[k] for k in keys] + list(fields.fields)
        + [T.StructField("model", T.StringType()), T.StructField("error", T.StringType())]
    )
    columns = [f.name for f in fields.fields]

    def scored_parts(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        out = batch[keys].reset_index(drop=True).copy()
        try:
            scored = scorer(batch.reset_index(drop=True))
            for c in columns:
                out[c] = scored[c].to_numpy() if c in scored else None
            out["error"] = None
        except Exception as failure:  # the scorer is the caller's code
            if len(batch) > 1:
                yield from scored_parts(batch.iloc[:len(batch) // 2])
                yield from scored_parts(batch.iloc[len(batch) // 2:])
                return
            for c in columns:
                out[c] = None
            out["error"] = f"SCORER_ERROR: {type(failure).__name__}"
        out["model"] = model
        yield out[[f.name for f in schema.fields]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from scored_parts(batch)

    spread = df.repartition(concurrency) if concurrency else df
    return spread.mapInPandas(run, schema)


def pending_rows(rows: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a result."""
    return rows.join(results.select(*keys), keys, "left_anti")


def upsert_rows(results: DataFrame, delta: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The latest result of every row: kept by an aggregate, so no key is sorted in one task."""
    both = results.unionByName(delta, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    newest = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("__row"))
    return newest.select(*keys, "__row.*")


def upsert_stored(store, delta: DataFrame, order: str, version: int) -> None:
    """``upsert_rows`` into a stored run (a ``KeyedStore``): only the files of buckets with keys of the delta are written anew."""
    store.replace(delta, version, lambda held, rows: upsert_rows(held, rows, [store.key], order))


def completed_prefix(results: DataFrame, row: str = "row_index") -> DataFrame:
    """(completed): how many rows from 0 on have a result without a gap.

    The first gap is the smallest r + 1 that has no result, which an anti join
    finds without ordering the rows.
    """
    done = results.select(F.col(row).cast("bigint").alias("r")).distinct()
    after = done.where("r >= 0").select((F.col("r") + 1).alias("r"))
    gap = after.join(done, "r", "left_anti").agg(F.min("r").alias("gap"))
    start = done.where("r = 0").agg(F.count(F.lit(1)).alias("has")).scalar()
    return gap.select(F.when(start > 0, F.col("gap")).otherwise(0).cast("bigint").alias("completed"))


def progress(results: DataFrame, totals: DataFrame) -> DataFrame:
    """(run_id, completed_rows, total_rows, percent) of every run."""
    done = results.groupBy("run_id").agg(F.count(F.lit(1)).alias("completed_rows"))
    both = totals.join(done, "run_id", "left").fillna(0, ["completed_rows"])
    percent = F.least(F.lit(100), F.floor(F.try_divide(F.col("completed_rows") * 100, F.col("total_rows")) + 0.5))
    finished = F.col("status") == "complete" if "status" in totals.columns else F.lit(False)
    percent = F.when(finished, 100).otherwise(F.coalesce(percent, F.lit(0))).cast("bigint")
    return both.select("run_id", "completed_rows", "total_rows", percent.alias("percent"))


def content_key(dataset: Column, question: Column, kind: Column, classes: Column) -> Column:
    """SHA-256 of a question in canonical form: blanks trimmed, class order ignored."""
    names = F.transform(F.coalesce(classes, F.array().cast("array<string>")), lambda c: F.trim(c))
    names = F.array_sort(F.filter(names, lambda c: F.length(c) > 0))
    names = F.when(kind == "probability", F.array().cast("array<string>")).otherwise(names)
    return F.sha2(F.to_json(F.struct(
        F.lit(1).alias("v"), F.trim(dataset).alias("dataset"), F.trim(question).alias("question"),
        kind.alias("kind"), names.alias("classes"),
    )), 256)


def reusable_run(runs: DataFrame, key: str = "content_key") -> DataFrame:
    """The best run of every key: complete before running before queued, then the newest."""
    rank = F.when(F.col("status") == "complete", 0).when(F.col("status") == "running", 1).when(F.col("status") == "queued", 2)
    usable = runs.withColumn("__rank", rank).where("__rank is not null")
    rest = [c for c in runs.columns if c != key]
    best = usable.groupBy(key).agg(
        F.max_by(F.struct(*rest), F.struct(-F.col("__rank"), "updated_at", "run_id")).alias("__run")
    )
    return best.select(key, "__run.*")


def stalled_runs(runs: DataFrame, now: Column, after_seconds: int = fixed.STALL_AFTER_SECONDS) -> DataFrame:
    """Queued or running, no progress for a minute, and nobody holding them."""
    age = F.timestamp_diff("SECOND", F.col("updated_at"), now)
    free = F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") <= now)
    return runs.where(F.col("status").isin("queued", "running") & (age >= after_seconds) & free)


def daily_quota(calls: DataFrame, limit: int | Column, keys: list[str], order_by: list[str]) -> DataFrame:
    """Number the calls of each key and admit the first ``limit``; a busy key is cut into ranges."""
    counted = running(calls, order_by, {"call_number": Running("count", F.lit(1))}, keys)
    return counted.withColumn("admitted", F.col("call_number") <= limit)


# --- results in row order -----------------------------------------------------------------------
def running_distribution(results: DataFrame, column: str, classes: list[str], order_by: list[str]) -> DataFrame:
    """Class counts over every prefix of the results, one column ``n_i`` per class."""
    values = {f"n_{i}": Running("sum", (F.col(column) == c).cast("bigint")) for i, c in enumerate(classes)}
    counted = running(results, order_by, values)
    return counted.fillna(0, list(values))


def series_points(results: DataFrame, total: Column | int, row: str = "row_index", value: str = "value") -> DataFrame:
    """(row_index, x, y): results on a 0–1 axis; values that are not finite are left out."""
    total = F.lit(total) if isinstance(total, int) else total
    x = clamp01(F.col(row) / F.greatest(F.lit(1), total - 1))
    return results.select(F.col(row).alias("row_index"), x.alias("x"), clamp01(finite(F.col(value).cast("double"))).alias("y")).where("y is not null")


def results_csv(results: DataFrame, kind: str, classes: list[str] = ()) -> DataFrame:
    """The download of a run: row number from 1, then the class and its shares, or the value."""
    number = (F.col("row_index") + 1).alias("row_id")
    if kind == "choice":
        shares = [F.try_element_at("probabilities", F.lit(c)).alias(c) for c in classes]
        out = results.select(number, F.col("selected_class"), *shares)
    else:
        out = results.select(number, F.col("value").alias("score" if kind == "score" else "probability"))
    return out.orderBy("row_id")


def results_preview(results: DataFrame, columns: list[str], n: int = fixed.CSV_PREVIEW_ROWS) -> DataFrame:
    """Row number, the first two input columns, the answer and its confidence."""
    def percent(c: Column) -> Column:
        return F.when(c.isNotNull(), F.concat(F.floor(clamp01(c) * 100 + 0.5).cast("string"), F.lit("%")))

    answer = F.coalesce(F.col("selected_class"), percent(F.col("value")), F.col("error"), F.lit("Pending"))
    first = results.orderBy("row_index").limit(n)
    return first.select(
        F.concat(F.lit("#"), (F.col("row_index") + 1).cast("string")).alias("row"), *columns[:2],
        answer.alias("answer"), percent(F.col("confidence")).alias("confidence"),
    )


def seek(results: DataFrame, position: int | Column, row: str = "row_index") -> DataFrame:
    """The last result at or before a row position (the first one when there is none)."""
    rest = [c for c in results.columns if c != row]
    everything = F.struct(row, *rest)
    at = F.when(F.col(row) <= position, F.col(row))
    found = results.agg(F.max_by(everything, at).alias("before"), F.min_by(everything, F.col(row)).alias("first"))
    return found.select(F.coalesce("before", "first").alias("hit")).select("hit.*")


def seek_many(
    positions: DataFrame, results: DataFrame, position: str, row: str, value: str, keys: list[str] | None = None
) -> DataFrame:
    """As-of lookup: for every position the last result at or before it.

    Both sides are put in one order and the last result is carried forward,
    range by range, so neither side is joined by inequality.
    """
    keys = list(keys or [])
    asked = positions.withColumn("__at", F.col(position)).withColumn("__side", F.lit(1))
    known = results.select(
        *keys, F.col(row).alias("__at"), F.lit(0).alias("__side"),
        F.struct(F.col(row).alias("row"), F.col(value).alias("value")).alias("__hit"),
    )
    both = asked.unionByName(known, allowMissingColumns=True)
    ids = [c for c in positions.columns if c not in keys]
    found = running(both, ["__at", "__side", *[c for c in ids if c != position]], {"__last": Running("last", F.col("__hit"))}, keys)
    return found.where("__side = 1").select(
        *positions.columns, F.col("__last.row").alias("found_row"), F.col("__last.value").alias("found_value")
    )


def win_likelihood(difference: Column, seconds_left: Column) -> Column:
    """Example scorer: a lead means more the less time is left."""
    left = F.coalesce(clamp01(finite(seconds_left.cast("double")) / 3600), F.lit(0.5))
    lead = F.coalesce(finite(difference.cast("double")), F.lit(0.0))
    odds = 1 / (1 + F.exp(-(lead / (6 + left * 14))))
    return F.greatest(F.lit(0.01), F.least(F.lit(0.99), odds))


# --- questions ------------------------------------------------------------------------------------
def question_kind(text: Column, explicit: Column | None = None) -> Column:
    """probability, score or choice: stated outright, in the question's JSON, or by its wording."""
    stated = F.when(
        F.ltrim(text).startswith("{"),
        F.coalesce(F.get_json_object(text, "$.query.type"), F.get_json_object(text, "$.type"), F.get_json_object(text, "$.questionKind")),
    )
    stated = F.when(stated.isin("probability", "score", "choice"), stated)
    wording = (
        F.when(text.rlike(fixed.WIN_LIKELIHOOD) | text.rlike(fixed.PLACE_EATING), "probability")
        .when(text.rlike(fixed.PLAY_QUALITY), "score").otherwise("choice")
    )
    return F.coalesce(*([explicit] if explicit is not None else []), stated, wording)


def _unique_labels(labels: Column) -> Column:
    """First of each label, compared without regard to case, at most 32."""
    tidy = F.filter(F.transform(labels, lambda s: F.trim(s)), lambda s: (F.length(s) > 0) & (F.length(s) <= fixed.CLASS_MAX_LENGTH))

    def first_ones(made: Column) -> Column:
        keys = F.transform(made, lambda s: F.lower(s))
        return F.filter(made, lambda s, i: F.array_position(keys, F.lower(s)) == i + 1)

    return F.slice(let(tidy, first_ones), 1, fixed.CLASS_MAX_COUNT)


def classes_from_text(text: Column) -> Column:
    """Labels a question lists after "as"/"into", after a colon, or around "vs"."""
    clause = F.regexp_extract(text, fixed.CLASS_CLAUSE, 1)
    colon = F.regexp_extract(text, fixed.CLASS_COLON, 1)
    versus = [F.regexp_extract(text, fixed.CLASS_VERSUS, i) for i in (1, 2)]
    tokens = F.concat(F.split(clause, fixed.CLASS_SPLIT), F.split(colon, fixed.CLASS_SPLIT), F.array(*versus))
    bare = F.transform(tokens, lambda t: F.trim(F.regexp_replace(t, "^['\"`]+|['\"`]+$", "")))
    labels = F.filter(bare, lambda t: t.rlike(fixed.CLASS_LABEL) & ~F.lower(t).isin(*fixed.CLASS_STOP_WORDS))
    return _unique_labels(labels)


def classes_from_label_column(df: DataFrame, order_by: list[str]) -> list[str]:
    """Values of the first column named like a label that has at least two."""
    import re

    from .grouping import unique_values

    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType) and re.search(fixed.LABEL_COLUMN_NAME, f.name, re.I):
            found = [r.value for r in unique_values(df, f.name, order_by, fixed.CLASS_MAX_COUNT).orderBy("position").collect()]
            if len(found) >= 2:
                return found
    return []


def merge_class_lists(*lists: Column) -> Column:
    return _unique_labels(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in lists]))

