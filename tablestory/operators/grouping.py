"""Group comparisons: counts, totals, means and rates per label.

All dimensions share one pre-aggregated shuffle: the table is unpivoted over
its label columns, so every measure and flag is read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed, shown
from .statistics import mean_difference, rate_difference


def group_rows(
    df: DataFrame, dims: list[str], measures: list[str] = (), flags: list[str] = ()
) -> DataFrame:
    """(dim, label, rows, then n_i/sum_i/mean_i/variance_i per measure, yes_i/known_i per flag)."""
    labels = [F.col(d).cast("string").alias(d) for d in dims]
    inputs = [F.col(m).cast("double").alias(f"__m{i}") for i, m in enumerate(measures)]
    inputs += [F.col(f).alias(f"__f{i}") for i, f in enumerate(flags)]
    ids = [f"__m{i}" for i in range(len(measures))] + [f"__f{i}" for i in range(len(flags))]
    long = df.select(*labels, *inputs).unpivot(ids, list(dims), "dim", "label").where("label is not null")
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i in range(len(measures)):
        m = F.col(f"__m{i}")
        aggregates += [
            F.count(m).alias(f"n_{i}"), F.sum(m).alias(f"sum_{i}"),
            F.avg(m).alias(f"mean_{i}"), F.var_pop(m).alias(f"variance_{i}"),
        ]
    for i in range(len(flags)):
        f = F.col(f"__f{i}")
        aggregates += [F.count_if(f).alias(f"yes_{i}"), F.count(f).alias(f"known_{i}")]
    return long.groupBy("dim", "label").agg(*aggregates)


def label_position(label: Column, rows: Column, kind: str = "category", order: list[str] | None = None) -> Column:
    """Where a group stands before any ranking: calendar order, scale order, or biggest first."""
    if order:
        return F.array_position(F.array(*map(F.lit, order)), label).cast("double")
    return label.try_cast("double") if kind == "ordinal" else -rows.cast("double")


def _numbered(bars: DataFrame, *order: Column | str) -> DataFrame:
    """Number the few rows of a chart."""
    return bars.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def _all_groups(groups: DataFrame, bars: DataFrame) -> DataFrame:
    """``bars`` as drawn, and the other groups without a position."""
    rest = groups.join(bars.select("label"), "label", "left_anti").withColumn("position", F.lit(None).cast("bigint"))
    return bars.withColumn("drawn", F.lit(True)).unionByName(rest.withColumn("drawn", F.lit(False)))


def count_bars(df: DataFrame, dim: str, kind: str = "category", order: list[str] | None = None) -> DataFrame:
    """(position, label, value, share, muted, drawn) of all groups.

    The biggest are drawn and have a position; a category also draws one muted bar that sums up the rest.
    """
    groups = group_rows(df, [dim]).select("label", F.col("rows").alias("value"))
    natural = kind == "ordinal" or order is not None
    limit = fixed.MAX_ORDERED_BARS if natural else fixed.MAX_BARS
    place = label_position(F.col("label"), F.col("value"), kind, order)
    shown_groups = groups.withColumn("place", place).orderBy("place", "label").limit(limit)
    bars = _all_groups(groups, _numbered(shown_groups, "place", "label").select("position", "label", "value"))
    bars = bars.withColumn("muted", F.lit(False))
    if kind == "category":
        rest = groups.join(shown_groups.select("label"), "label", "left_anti").agg(
            F.count(F.lit(1)).alias("hidden"), F.sum("value").alias("value")
        ).where("hidden > 0")
        name = F.concat(F.col("hidden").cast("string"), F.when(F.col("hidden") == 1, " other").otherwise(" others"))
        bars = bars.unionByName(rest.select(
            F.lit(limit + 1).cast("bigint").alias("position"), name.alias("label"), "value", F.lit(True).alias("muted"),
            F.lit(True).alias("drawn"),
        ))
    present = groups.agg(F.sum("value")).scalar()
    return bars.select("position", "label", "value", (F.col("value") / present).alias("share"), "muted", "drawn")


def measure_groups(df: DataFrame, dim: str, measure: str, additive: bool) -> DataFrame:
    """(label, rows, n, value, mean, variance) of the groups with enough values."""
    least = 1 if additive else fixed.MIN_GROUP
    groups = group_rows(df, [dim], [measure]).where(F.col("n_0") >= least)
    value = F.col("sum_0") if additive else F.col("mean_0")
    return groups.select(
        "label", "rows", F.col("n_0").alias("n"), value.alias("value"),
        F.col("mean_0").alias("mean"), F.col("variance_0").alias("variance"),
    )


def measure_bars(
    df: DataFrame, dim: str, measure: str, additive: bool, kind: str = "category", order: list[str] | None = None,
    unit: str | None = None,
) -> DataFrame:
    """(position, label, value, display, n, drawn): a measure totalled or averaged per group.

    All groups are there; the first, by value or by their own order, are drawn and have a position.
    """
    groups = measure_groups(df, dim, measure, additive)
    groups = groups.withColumn("place", label_position(F.col("label"), F.col("rows"), kind, order))
    natural = kind == "ordinal" or order is not None
    by = [F.col("place"), F.col("label")] if natural else [F.desc("value"), F.col("place"), F.col("label")]
    bars = groups.orderBy(*by).limit(fixed.MAX_ORDERED_BARS if natural else fixed.MAX_BARS)
    return _all_groups(groups, _numbered(bars, *by)).select(
        "position", "label", "value", shown.number_text(F.col("value"), unit).alias("display"), "n", "drawn"
    )


def measure_test(df: DataFrame, dim: str, measure: str) -> DataFrame:
    """Analysis of variance of a measure over the groups with at least five values."""
    return mean_difference(measure_groups(df, dim, measure, additive=False))


def rate_groups(df: DataFrame, dim: str, flag: str) -> DataFrame:
    """(label, rows, yes, total, rate) of the groups with enough known rows."""
    groups = group_rows(df, [dim], [], [flag])
    floor = groups.agg(F.greatest(F.lit(10), F.ceil(F.sum("rows") * 0.02))).scalar()
    known = groups.where(F.col("known_0") >= floor)
    return known.select(
        "label", "rows", F.col("yes_0").alias("yes"), F.col("known_0").alias("total"),
        (F.col("yes_0") / F.col("known_0")).alias("rate"),
    )


def rate_bars(df: DataFrame, dim: str, flag: str, kind: str = "category", order: list[str] | None = None) -> DataFrame:
    """(position, label, yes, total, rate, display, overall, drawn): share of yes per group; the first are drawn."""
    groups = rate_groups(df, dim, flag)
    groups = groups.withColumn("place", label_position(F.col("label"), F.col("rows"), kind, order))
    natural = kind == "ordinal" or order is not None
    by = [F.col("place"), F.col("label")] if natural else [F.desc("rate"), F.col("place"), F.col("label")]
    overall = groups.agg(F.try_divide(F.sum("yes"), F.sum("total"))).scalar()
    bars = _numbered(groups.orderBy(*by).limit(fixed.MAX_ORDERED_BARS), *by)
    return _all_groups(groups, bars).select(
        "position", "label", "yes", "total", "rate", shown.share_text(F.col("rate")).alias("display"),
        overall.alias("overall"), "drawn",
    )


def rate_test(df: DataFrame, dim: str, flag: str) -> DataFrame:
    return rate_difference(rate_groups(df, dim, flag))


def trait_bars(df: DataFrame, flags: list[str]) -> DataFrame:
    """(column, yes, present, rate): several yes/no columns side by side, from one aggregate."""
    each = [
        F.struct(F.lit(f).alias("column"), F.lit(i).alias("place"), F.count_if(F.col(f)).alias("yes"),
                 F.count(F.col(f)).alias("present"))
        for i, f in enumerate(flags)
    ]
    rated = df.agg(F.array(*each).alias("all")).select(F.inline("all"))
    rate = F.coalesce(F.try_divide(F.col("yes"), F.col("present")), F.lit(0.0))
    return rated.withColumn("rate", rate).orderBy(F.desc("rate"), "place").drop("place")


# --- other aggregates over labels -----------------------------------------------------------
def leaderboard(df: DataFrame, entity: str, amount: Column, name: str | None = None) -> DataFrame:
    """(entity[, name], total, place, tied): totals from highest, equal totals by entity.

    ``tied`` says whether the first place is shared.
    """
    extra = [F.min(name).alias("name")] if name else []
    totals = df.where(F.col(entity).isNotNull()).groupBy(F.col(entity).alias("entity")).agg(
        F.sum(F.coalesce(amount, F.lit(0))).alias("total"), *extra
    )
    best = totals.agg(F.max("total")).scalar()
    leaders = totals.where(F.col("total") == best).agg(F.count(F.lit(1))).scalar()
    return totals.select(
        "entity", *(["name"] if name else []), "total", (F.col("total") == best).alias("leads"),
        ((F.col("total") == best) & (leaders > 1)).alias("tied"),
    ).orderBy(F.desc("total"), "entity")


def class_distribution(df: DataFrame, column: str, known: list[str] = ()) -> DataFrame:
    """(name, count) per class, declared classes included even when unused."""
    counted = (
        df.select(F.btrim(F.col(column).cast("string")).alias("name")).where("name is not null and name <> ''")
        .groupBy("name").agg(F.count(F.lit(1)).alias("count"))
    )
    declared = [c for c in dict.fromkeys(known) if c.strip()]
    if declared:
        zero = df.sparkSession.createDataFrame([(c, 0) for c in declared], "name string, count bigint")
        counted = counted.unionByName(zero).groupBy("name").agg(F.sum("count").alias("count"))
    return counted.orderBy(F.desc("count"), "name")


def place_ranking(df: DataFrame, place: str, flag: Column) -> DataFrame:
    """(name, count, yes, unknown, weight): places by how often a flag is true; unknown weighs 0.35."""
    weight = F.when(flag, 1.0).when(~flag, 0.0).otherwise(0.35)
    label = place_label(F.col(place).cast("string"))
    ranked = (
        df.select(label.alias("name"), flag.alias("flag"), weight.alias("w")).where("name <> ''").groupBy("name").agg(
            F.count(F.lit(1)).alias("count"), F.count_if("flag").alias("yes"),
            F.count_if(F.col("flag").isNull()).alias("unknown"), F.sum("w").alias("weight"),
        )
    )
    return ranked.orderBy(F.desc("yes"), F.desc("weight"), F.desc("count"), "name")


def place_label(c: Column) -> Column:
    """Plain words for place jargon."""
    text = F.btrim(c)
    known = F.create_map(*[F.lit(x) for pair in fixed.PLACE_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(text)), text)


def value_bands(df: DataFrame, value: str, names: tuple[str, str, str] = ("Likely yes", "Unsure", "Likely no")) -> DataFrame:
    """(position, name, count) of the upper, middle and lower third of a 0–1 value."""
    v = F.col(value).cast("double")
    v = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))
    band = F.when(v >= 2 / 3, 0).when(v > 1 / 3, 1).when(v.isNotNull(), 2)
    counted = df.select(band.alias("band")).agg(*[F.count_if(F.col("band") == i).alias(str(i)) for i in range(3)])
    bands = F.array(*[
        F.struct(F.lit(i + 1).cast("bigint").alias("position"), F.lit(names[i]).alias("name"),
                 F.col(str(i)).alias("count"))
        for i in range(3)
    ])
    return counted.select(F.inline(bands))


def latest_per_key(df: DataFrame, keys: list[str], order_by: list[str], columns: list[str]) -> DataFrame:
    """The last row of every key, kept by an aggregate: no key is ever sorted in one task."""
    last = F.max_by(F.struct(*columns), F.struct(*order_by))
    return df.groupBy(*keys).agg(last.alias("__last")).select(*keys, "__last.*")


def status_label(status: Column, source: Column, state: Column) -> Column:
    """The label an entity shows for its latest record."""
    stale = (source == "stale") | (state == "STALE")
    return (
        F.when(status.isNull(), "STALE")
        .when(status == "error", F.when(F.coalesce(stale, F.lit(False)), "STALE").otherwise("ERROR"))
        .when(status == "limited", "LIMITED")
        .when((source == "live") & (status == "success") & (state == "LIVE"), "LIVE")
        .when((source == "replay") | (state == "REPLAY"), "REPLAY")
        .when(source == "mock", "MOCK")
        .otherwise("STALE")
    )


def unique_values(df: DataFrame, column: str, order_by: list[str], limit: int = 16) -> DataFrame:
    """(position, value): the first different values in row order, compared without regard to case."""
    text = F.btrim(F.col(column).cast("string"))
    first = (
        df.select(text.alias("value"), F.struct(*order_by).alias("row")).where("value is not null and value <> ''")
        .groupBy(F.lower("value").alias("key")).agg(F.min_by("value", "row").alias("value"), F.min("row").alias("row"))
    )
    few = first.orderBy("row", "key").limit(limit)
    return _numbered(few, "row", "key").select("position", "value")


def dominant_code(df: DataFrame, column: str) -> DataFrame:
    """(code): the one short code all rows of a column share, or null when they differ."""
    text = F.btrim(F.col(column).cast("string"))
    code = F.when(text.rlike("^[A-Za-z]{2,4}$"), F.upper(text)).otherwise(shown.team_code(text))
    codes = df.where(F.length(text) > 0).agg(F.min(code).alias("low"), F.max(code).alias("high"))
    return codes.select(F.when(F.col("low") == F.col("high"), F.col("low")).alias("code"))
