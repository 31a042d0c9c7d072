"""Queries over aggregates, statistics, views and stories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, shown
from ..operators import grouping as G, profile as P, series as Z, statistics as ST
from ..plans import story as S, views as V
from .common import Tables, pick, r6, rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _money(c: str) -> str:
    return f"CAST(sum(CAST({c} AS DECIMAL(18,2))) AS DOUBLE)"


# --- aggregates -------------------------------------------------------------------------------
def _group_sql(dim: str) -> str:
    return f"""SELECT '{dim}' AS dim, CAST({dim} AS VARCHAR) AS label, count(*) AS rows, count(l_quantity) AS n_0, {_money('l_quantity')} AS sum_0,
      round(avg(l_quantity), 6) AS mean_0, round(var_pop(l_quantity), 6) AS variance_0,
      count(*) FILTER (WHERE l_discount > 0.05) AS yes_0, count(l_discount) AS known_0 FROM lineitem GROUP BY 2"""


@query(" UNION ALL ".join(map(_group_sql, ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"])))
def group_rows(t):
    flagged = t.lineitem.withColumn("cheap", F.col("l_discount") > 0.05)
    groups = G.group_rows(flagged, ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"], ["l_quantity"], ["cheap"])
    return groups.withColumns({"sum_0": F.round("sum_0", 2), "mean_0": r6("mean_0"), "variance_0": r6("variance_0")})


_COUNT_SQL = """WITH g AS (SELECT {d} AS label, count(*) AS value FROM {t} GROUP BY 1),
  r AS (SELECT *, row_number() OVER (ORDER BY value DESC, label) AS position, sum(value) OVER () AS present FROM g)
  SELECT CASE WHEN position <= 8 THEN position END AS position, label, value, round(value / present, 6) AS share, false AS muted, position <= 8 AS drawn FROM r {rest}"""


@query(_COUNT_SQL.format(d="source", t="documents", rest="""UNION ALL
  SELECT 9, count(*) || CASE WHEN count(*) = 1 THEN ' other' ELSE ' others' END, CAST(sum(value) AS BIGINT), round(sum(value) / max(present), 6), true, true
  FROM r WHERE position > 8 HAVING count(*) > 0"""))
def count_ranking(t):
    return rounded(G.count_bars(t.documents, "source", "category"), "share")


@query(_COUNT_SQL.format(d="p_brand", t="part", rest=""))
def count_ranking_entity(t):
    return rounded(G.count_bars(t.part, "p_brand", "entity"), "share")


@query("""WITH g AS (SELECT CAST(l_linenumber AS VARCHAR) AS label, count(*) AS value FROM lineitem GROUP BY 1)
  SELECT row_number() OVER (ORDER BY CAST(label AS DOUBLE)) AS position, label, value, round(value / sum(value) OVER (), 6) AS share, false AS muted, true AS drawn FROM g""")
def count_ranking_ordinal(t):
    return rounded(G.count_bars(t.lineitem, "l_linenumber", "ordinal"), "share")


@query("""WITH g AS (SELECT o_orderpriority AS label, count(*) AS n, avg(o_totalprice) AS v FROM orders GROUP BY 1 HAVING count(o_totalprice) >= 5)
  SELECT row_number() OVER (ORDER BY v DESC, -n, label) AS position, label, round(v, 4) AS value, n, true AS drawn FROM g""")
def measure_ranking(t):
    bars = G.measure_bars(t.orders, "o_orderpriority", "o_totalprice", additive=False)
    return bars.withColumn("value", F.round("value", 4)).drop("display")


@query(f"""WITH g AS (SELECT CAST(l_suppkey AS VARCHAR) AS label, count(*) AS n, {_money('l_extendedprice')} AS v FROM lineitem GROUP BY 1)
  SELECT CASE WHEN p <= 8 THEN p END AS position, label, round(v, 2) AS value, n, p <= 8 AS drawn FROM (SELECT *, row_number() OVER (ORDER BY v DESC, -n, label) AS p FROM g)""")
def measure_ranking_total(t):
    bars = G.measure_bars(t.lineitem, "l_suppkey", "l_extendedprice", additive=True, kind="entity")
    return bars.withColumn("value", F.round("value", 2)).drop("display")


_RATE_SQL = """WITH g AS (SELECT {d} AS label, count(*) AS rows, count(*) FILTER (WHERE l_discount > 0.05) AS yes, count(l_discount) AS total FROM lineitem GROUP BY 1),
  k AS (SELECT *, yes / total AS rate FROM g WHERE total >= (SELECT greatest(10, ceil(sum(rows) * 0.02)) FROM g))"""


@query(_RATE_SQL.format(d="l_returnflag || l_linestatus") + """SELECT row_number() OVER (ORDER BY rate DESC, rows DESC, label) AS position, label, yes, total, round(rate, 6) AS rate,
  round(sum(yes) OVER () / sum(total) OVER (), 6) AS overall, true AS drawn FROM k""")
def rate_by_group(t):
    flagged = t.lineitem.select(
        F.concat("l_returnflag", "l_linestatus").alias("state"), (F.col("l_discount") > 0.05).alias("cheap")
    )
    return rounded(G.rate_bars(flagged, "state", "cheap"), "rate", "overall").drop("display")


@query(" UNION ALL ".join(
    f"""SELECT '{n}' AS "column", count(*) FILTER (WHERE {e}) AS yes, count({e}) AS present, round(count(*) FILTER (WHERE {e}) / count({e}), 6) AS rate FROM lineitem"""
    for n, e in [("cheap", "l_discount > 0.05"), ("taxed", "l_tax > 0.04"), ("large", "l_quantity > 25"), ("filled", "l_linestatus = 'F'")]))
def trait_rates(t):
    flags = t.lineitem.select(
        (F.col("l_discount") > 0.05).alias("cheap"), (F.col("l_tax") > 0.04).alias("taxed"),
        (F.col("l_quantity") > 25).alias("large"), (F.col("l_linestatus") == "F").alias("filled"),
    )
    return rounded(G.trait_bars(flags, ["cheap", "taxed", "large", "filled"]), "rate")


@query(f"""WITH g AS (SELECT l_suppkey AS entity, min(s_name) AS name, {_money("CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END")} AS total FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1), m AS (SELECT max(total) AS best FROM g)
  SELECT entity, name, total, total = best AS leads, total = best AND (SELECT count(*) FROM g, m WHERE total = best) > 1 AS tied FROM g, m""")
def leaderboard(t):
    totals = G.leaderboard(t.lineitem, "l_suppkey", F.when(F.col("l_returnflag") != "R", F.col("l_quantity")))
    names = t.supplier.select(F.col("s_suppkey").alias("entity"), F.col("s_name").alias("name"))
    return totals.join(names, "entity")


@query("""SELECT name, count FROM (SELECT lang AS name, count(*) AS count FROM documents GROUP BY 1 UNION ALL SELECT 'it', 0)""")
def class_distribution(t):
    return G.class_distribution(t.documents, "lang", ["en", "it"])


@query("""SELECT source AS name, count(*) AS count, count(*) FILTER (WHERE quality = 1) AS yes, count(*) FILTER (WHERE quality IS NULL) AS unknown,
  round(CAST(sum(CASE WHEN quality = 1 THEN 1.0 WHEN quality = 0 THEN 0.0 ELSE 0.35 END) AS DOUBLE), 6) AS weight FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def place_ranking(t):
    marked = t.documents.select("doc_id", "source").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return rounded(G.place_ranking(marked, "source", F.col("quality") == 1), "weight")


@query("""SELECT CAST(p AS BIGINT) AS position, n AS name, count(v) FILTER (WHERE CASE WHEN v >= 2/3 THEN 1 WHEN v > 1/3 THEN 2 ELSE 3 END = p) AS count
  FROM (SELECT least(1.0, value / 100) AS v FROM events), (VALUES (1, 'Likely yes'), (2, 'Unsure'), (3, 'Likely no')) AS b(p, n) GROUP BY 1, 2""")
def value_bands(t):
    return G.value_bands(t.events.select((F.col("value") / 100).alias("value")), "value")


@query("""SELECT user_id, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'LIMITED' WHEN 'purchase' THEN 'LIVE' WHEN 'view' THEN 'REPLAY' ELSE 'MOCK' END AS label
  FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def latest_status(t):
    last = G.latest_per_key(t.events, ["user_id"], ["ts", "event_id"], ["event_type"])
    kind = F.col("event_type")
    status = F.when(kind == "error", "error").when(kind == "signup", "limited").otherwise("success")
    source = F.when(kind == "purchase", "live").when(kind == "view", "replay").otherwise("mock")
    return last.select("user_id", G.status_label(status, source, F.when(kind == "purchase", "LIVE")).alias("label"))


@query("""WITH f AS (SELECT source AS value, min(doc_id) AS d FROM documents GROUP BY 1)
  SELECT position, value FROM (SELECT value, row_number() OVER (ORDER BY d) AS position FROM f) WHERE position <= 16""")
def unique_values(t):
    mixed = t.documents.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(F.concat(F.lit(" "), F.col("source"))).alias("source"))
    return G.unique_values(mixed, "source", ["doc_id"])


@query("""SELECT 'en' AS lang, 'EN' AS code WHERE (SELECT count(*) FROM documents WHERE lang = 'en') > 0 UNION ALL SELECT 'all', NULL""")
def dominant_code(t):
    one = G.dominant_code(t.documents.where("lang = 'en'"), "lang").select(F.lit("en").alias("lang"), "code")
    return one.unionByName(G.dominant_code(t.documents, "lang").select(F.lit("all").alias("lang"), "code"))


# --- statistics ---------------------------------------------------------------------------------
@query(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(quantile_cont({c}, 0.02), 6) AS p02, round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS median,
    round(quantile_cont({c}, 0.75), 6) AS q3, round(quantile_cont({c}, 0.98), 6) AS p98 FROM {t}"""
    for c, t in [("l_extendedprice", "lineitem"), ("p_retailprice", "part"), ("value", "events")]))
def quantiles(t):
    rows = [
        (c, *ST.quantiles(df, c, [0.02, 0.25, 0.5, 0.75, 0.98]))
        for c, df in (("l_extendedprice", t.lineitem), ("p_retailprice", t.part), ("value", t.events))
    ]
    made = t.spark.createDataFrame(rows, "column string, p02 double, q1 double, median double, q3 double, p98 double")
    return rounded(made, "p02", "q1", "median", "q3", "p98")


@query(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(quantile_cont({c}, 0.001), 6) AS p001, round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.999), 6) AS p999 FROM {t}"""
    for c, t in [("l_extendedprice", "lineitem"), ("p_retailprice", "part"), ("value", "events")]))
def quantiles_large(t):
    """The way taken beyond the limit on different values, on columns with infinite and missing values added."""
    rows = []
    for c, df in (("l_extendedprice", t.lineitem), ("p_retailprice", t.part), ("value", t.events)):
        own = df.select(F.col(c).cast("double").alias(c))
        for odd in ("Infinity", "-Infinity", "NaN", None):
            own = own.unionByName(df.select(F.lit(odd).cast("double").alias(c)))
        rows.append((c, *ST.quantiles(own, c, [0.001, 0.5, 0.999], exact_limit=0, collect_limit=500)))
    made = t.spark.createDataFrame(rows, "column string, p001 double, median double, p999 double")
    return rounded(made, "p001", "median", "p999")


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PAIRS = [(a, b) for i, a in enumerate(_MEASURES) for b in _MEASURES[i + 1:]]


@query(" UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, count(*) AS pairs, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in _PAIRS))
def pearson_pairs(t):
    return rounded(ST.pearson_pairs(t.lineitem, _PAIRS), "r")


_LAG = """SELECT '{c}' AS "column", count(v) AS points, round(corr(v, p), 6) AS r FROM (SELECT CAST({c} AS DOUBLE) AS v, lag(CAST({c} AS DOUBLE)) OVER (ORDER BY {o}) AS p FROM {t})"""


@query(_LAG.format(c="value", o="event_id", t="events") + " UNION ALL " + _LAG.format(c="user_id", o="event_id", t="events")
       + " UNION ALL " + _LAG.format(c="p_retailprice", o="p_partkey", t="part"))
def lag1_corr(t):
    events = ST.lag1_corr(t.events, ["value", "user_id"], ["event_id"])
    return rounded(events.unionByName(ST.lag1_corr(t.part, ["p_retailprice"], ["p_partkey"])), "r")


@query("""SELECT k, stat > 0 AND (cbrt(stat / df) - (1 - 2 / (9 * df))) / sqrt(2 / (9 * df)) > 2.326 AS significant FROM (
  SELECT l_suppkey AS k, CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) * 7 / count(*) * (l_suppkey % 90) AS stat, CAST(l_suppkey % 12 + 1 AS DOUBLE) AS df FROM lineitem GROUP BY 1)""")
def chi_square(t):
    grid = t.lineitem.groupBy(F.col("l_suppkey").alias("k")).agg(
        (F.round(F.sum("l_discount"), 2) * 7 / F.count(F.lit(1))).alias("mean")
    ).withColumn("stat", F.col("mean") * (F.col("k") % 90))
    return grid.select("k", ST.chi_square_significant(F.col("stat"), F.col("k") % 12 + 1).alias("significant"))


_SIGNIFICANT = "(cbrt({s} / ({k} - 1)) - (1 - 2 / (9.0 * ({k} - 1)))) / sqrt(2 / (9.0 * ({k} - 1))) > 2.326"


@query(_RATE_SQL.format(d="CAST(l_linenumber AS VARCHAR)") + f""", o AS (SELECT sum(yes) / sum(total) AS p, sum(total) AS n, sum(yes) AS y, count(*) AS k FROM k),
  s AS (SELECT sum(power(yes - total * p, 2) / (total * p) + power(total - yes - total * (1 - p), 2) / (total * (1 - p))) AS stat FROM k, o)
  SELECT o.k AS k, CAST(y AS BIGINT) AS yes, CAST(n AS BIGINT) AS total, round(p, 6) AS overall, round(stat, 6) AS statistic,
  stat > 0 AND {_SIGNIFICANT.format(s='stat', k='o.k')} AS significant, round(sqrt(stat / n), 6) AS cramers_v FROM o, s""")
def rate_difference(t):
    flagged = t.lineitem.select("l_linenumber", (F.col("l_discount") > 0.05).alias("cheap"))
    return rounded(G.rate_test(flagged, "l_linenumber", "cheap"), "overall", "statistic", "cramers_v")


def _anova_sql(dim: str, measure: str, table: str) -> str:
    return f"""SELECT '{measure}' AS measure, k, n, round(b, 2) AS between, round(f, 6) AS f, {_SIGNIFICANT.format(s='((k - 1) * f)', k='k')} AS significant, round(b / (b + w), 6) AS eta_squared
      FROM (SELECT *, (b / (k - 1)) / (w / (n - k)) AS f FROM (
        SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(n * power(m - g, 2)) AS b, sum(n * v) AS w FROM (
          SELECT count({measure}) AS n, avg({measure}) AS m, var_pop({measure}) AS v,
            (SELECT sum(c * a) / sum(c) FROM (SELECT count({measure}) AS c, avg({measure}) AS a FROM {table} GROUP BY {dim} HAVING count({measure}) >= 5)) AS g
          FROM {table} GROUP BY {dim} HAVING count({measure}) >= 5)))"""


@query(_anova_sql("l_returnflag", "l_quantity", "lineitem") + " UNION ALL " + _anova_sql("p_brand", "p_retailprice", "part"))
def anova(t):
    def one(df, dim, measure):
        return G.measure_test(df, dim, measure).withColumn("measure", F.lit(measure)).drop("within")

    both = one(t.lineitem, "l_returnflag", "l_quantity").unionByName(one(t.part, "p_brand", "p_retailprice"))
    return rounded(both, "f", "eta_squared").withColumn("between", F.round("between", 2))


@query("""SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem""")
def least_squares(t):
    slope, intercept = ST.least_squares(F.col("l_quantity"), F.col("l_extendedprice"))
    return t.lineitem.agg(F.round(slope, 4).alias("slope"), F.round(intercept, 4).alias("intercept"))


_MONTHLY = "(SELECT date_trunc('month', o_orderdate) AS b, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY 1)"


@query(f"SELECT round(stddev_pop(v) / avg(v), 6) AS variation, stddev_pop(v) / avg(v) >= 0.12 AS is_trend FROM {_MONTHLY}")
def count_variation(t):
    months = Z.time_buckets(t.orders, "o_orderdate", "month")
    v = ST.variation(F.col("rows").cast("double"))
    return months.agg(F.round(v, 6).alias("variation"), (v >= 0.12).alias("is_trend"))


@query(f"""SELECT round(early, 6) AS early, round(late, 6) AS late, round((late - early) / abs(early), 6) AS change FROM (
  SELECT avg(v) FILTER (WHERE rn <= greatest(1, n // 3)) AS early, avg(v) FILTER (WHERE rn > n - greatest(1, n // 3)) AS late
  FROM (SELECT v, row_number() OVER (ORDER BY b) AS rn, count(*) OVER () AS n FROM {_MONTHLY}))""")
def thirds_change(t):
    months = Z.time_buckets(t.orders, "o_orderdate", "month")
    return rounded(ST.thirds_change(months, "bucket", "rows"), "early", "late", "change")


@query("""SELECT k, round(CASE WHEN f <= 1 THEN 1 WHEN f <= 2 THEN 2 WHEN f <= 5 THEN 5 ELSE 10 END * p, 6) AS step FROM (
  SELECT k, power(10, floor(log10(r))) AS p, r / power(10, floor(log10(r))) AS f FROM (
    SELECT l_suppkey AS k, (max(l_extendedprice) - min(l_extendedprice)) / (l_suppkey + 3) AS r FROM lineitem GROUP BY 1))""")
def nice_step(t):
    spread = t.lineitem.groupBy(F.col("l_suppkey").alias("k")).agg(
        (F.max("l_extendedprice") - F.min("l_extendedprice")).alias("spread")
    )
    return spread.select("k", F.round(shown.nice_step_column(F.col("spread") / (F.col("k") + 3)), 6).alias("step"))


# --- time ---------------------------------------------------------------------------------------
def _grains_sql(table: str, c: str, grains: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{table}' AS name, '{g}' AS grain, count(DISTINCT date_trunc('{g}', {c})) AS buckets FROM {table}" for g in grains)


@query(_grains_sql("orders", "o_orderdate", ["day", "week", "month", "quarter", "year"]) + " UNION ALL "
       + _grains_sql("events", "ts", ["hour", "day", "week", "month", "quarter", "year"]))
def grain_counts(t):
    orders = Z.grain_counts(t.orders, "o_orderdate", hourly=False).withColumn("name", F.lit("orders"))
    return orders.unionByName(Z.grain_counts(t.events, "ts", hourly=True).withColumn("name", F.lit("events")))


def _chosen_sql(table: str, c: str, hours: bool) -> str:
    sizes = "(1, 'day', 86400), (2, 'week', 604800), (3, 'month', 2630016), (4, 'quarter', 7888320), (5, 'year', 31557600)"
    return f"""SELECT '{table}' AS name, coalesce((SELECT g FROM (SELECT g, i, n / b AS per, coalesce(lead(b) OVER (ORDER BY i), 0) AS nb FROM (
        SELECT i, g, count(DISTINCT CASE g WHEN 'day' THEN date_trunc('day', {c}) WHEN 'week' THEN date_trunc('week', {c}) WHEN 'month' THEN date_trunc('month', {c})
          WHEN 'quarter' THEN date_trunc('quarter', {c}) ELSE date_trunc('year', {c}) END) AS b, count(*) AS n
        FROM {table}, (VALUES {sizes}) AS s(i, g, z) WHERE (SELECT epoch(max({c})) - epoch(min({c})) FROM {table}) / z <= 160 GROUP BY 1, 2))
      WHERE per <= 1.5 OR per >= 12 OR nb < 6 ORDER BY i LIMIT 1), 'year') AS grain"""


@query(_chosen_sql("orders", "o_orderdate", False) + " UNION ALL " + _chosen_sql("events", "ts", False))
def choose_grain(t):
    rows = []
    for name, df, c, clock in (("orders", t.orders, "o_orderdate", False), ("events", t.events, "ts", True)):
        ends = df.agg(F.min(c), F.max(c), F.count(c)).first()
        hourly = Z.hours_usable(ends[0], ends[1], clock)
        counts = {r.grain: r.buckets for r in Z.grain_counts(df, c, hourly).collect()}
        rows.append((name, Z.choose_grain(counts, ends[2], ends[0], ends[1], clock, "day")))
    return t.spark.createDataFrame(rows, "name string, grain string")


_TREND = """WITH b AS (SELECT date_trunc('{g}', o_orderdate) AS bucket, {v} AS value FROM orders GROUP BY 1),
  f AS (SELECT CAST(s.bucket AS TIMESTAMP) AS bucket, coalesce(b.value, 0) AS value, b.bucket IS NULL AS gap FROM (SELECT unnest(generate_series((SELECT min(bucket) FROM b), (SELECT max(bucket) FROM b), {step})) AS bucket) s LEFT JOIN b ON s.bucket = b.bucket),
  k AS (SELECT bucket, value FROM f WHERE NOT gap OR (SELECT count(*) FILTER (WHERE gap) / count(*) FROM f) <= 0.2),
  e AS (SELECT epoch(min(o_orderdate)) AS low, epoch(max(o_orderdate)) + 86400 AS high FROM orders)
  SELECT bucket, value FROM k, e WHERE (SELECT count(*) FROM k) < 8 OR NOT (
    (bucket = (SELECT min(bucket) FROM k) AND (epoch(bucket + {step}) - low) / (epoch(bucket + {step}) - epoch(bucket)) < 0.75) OR
    (bucket = (SELECT max(bucket) FROM k) AND (high - epoch(bucket)) / (epoch(bucket + {step}) - epoch(bucket)) < 0.75))"""


@query(_TREND.format(g="month", step="INTERVAL 1 MONTH", v="round(" + _money("o_totalprice") + ", 2)"))
def time_trend(t):
    return Z.trend_series(t.orders, "o_orderdate", "month", "o_totalprice", additive=True).withColumn("value", F.round("value", 2))


@query(_TREND.format(g="quarter", step="INTERVAL 3 MONTH", v="CAST(count(*) AS DOUBLE)"))
def trim_edges(t):
    return Z.trend_series(t.orders, "o_orderdate", "quarter")


@query("""SELECT bucket, round((epoch(bucket) - min(epoch(bucket)) OVER ()) / (max(epoch(bucket)) OVER () - min(epoch(bucket)) OVER ()), 6) AS x, strftime(bucket, '%b') || ' ' || year(bucket) AS label, round(value, 4) AS value
  FROM (SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS bucket, avg(o_totalprice) AS value FROM orders GROUP BY 1)""")
def time_trend_mean(t):
    points = Z.series_points(Z.trend_series(t.orders, "o_orderdate", "month", "o_totalprice"), "month")
    return points.select("bucket", r6("x").alias("x"), "label", F.round("value", 4).alias("value"))


@query("""WITH b AS (SELECT date_trunc('hour', ts) AS bucket, count(*) AS rows FROM events GROUP BY 1),
  f AS (SELECT CAST(s.bucket AS TIMESTAMP) AS bucket, coalesce(rows, 0) AS rows, b.bucket IS NULL AS gap FROM (SELECT unnest(generate_series((SELECT min(bucket) FROM b), (SELECT max(bucket) FROM b), INTERVAL 1 HOUR)) AS bucket) s LEFT JOIN b ON s.bucket = b.bucket)
  SELECT bucket, rows, (SELECT count(*) FILTER (WHERE gap) FROM f) AS gaps FROM f WHERE NOT gap OR (SELECT count(*) FILTER (WHERE gap) / count(*) FROM f) <= 0.2""")
def gap_fill(t):
    return Z.gap_fill(Z.time_buckets(t.events, "ts", "hour"), "hour")


# --- row order, spread, relation, map --------------------------------------------------------------
@query("""SELECT position, round((position - 1) / (count(*) OVER () - 1), 6) AS x, CAST(step AS DOUBLE) AS step, value FROM (
  SELECT row_number() OVER (ORDER BY event_id) AS position, event_id AS step, value FROM events)""")
def sequence_line(t):
    return rounded(Z.sequence_points(t.events.withColumn("event_id", F.col("event_id").cast("double")), "event_id", "value"), "x")


@query("""SELECT 'value' AS name, count(value) AS points, round(corr(value, p), 6) AS smooth, round(corr(value, i), 6) AS clock FROM
   (SELECT value, lag(value) OVER (ORDER BY event_id) AS p, row_number() OVER (ORDER BY event_id) AS i FROM events) UNION ALL
  SELECT 'climb', count(v), round(corr(v, p), 6), round(corr(v, i), 6) FROM
   (SELECT v, i, lag(v) OVER (ORDER BY i) AS p FROM (SELECT event_id * 2.0 + value AS v, row_number() OVER (ORDER BY event_id) AS i FROM events))""")
def independent_measures(t):
    from ..plans.kinds import Field

    typed = t.events.select(
        F.col("event_id").cast("double").alias("event_id"), "value", (F.col("event_id") * 2.0 + F.col("value")).alias("climb")
    )
    facts = V.order_facts(typed, Field("event_id", "double"), [Field("value", "double"), Field("climb", "double")])
    rows = [(r["name"], r.points, r.smooth, r.clock) for r in facts.values()]
    return rounded(t.spark.createDataFrame(rows, "name string, points bigint, smooth double, clock double"), "smooth", "clock")


def _histogram(t, df, column: str, integer: bool):
    p02, q1, _, q3, p98 = ST.quantiles(df, column, [0.02, 0.25, 0.5, 0.75, 0.98])
    ends = df.agg(F.count(column).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).first()
    plan = Z.bin_plan(ends.n, float(ends.low), float(ends.high), q1, q3, p02, p98, integer)
    return Z.histogram_bins(df, column, plan)


_HISTOGRAM = """WITH q AS (SELECT count({c}) AS n, CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3,
   quantile_cont({c}, 0.02) AS p02, quantile_cont({c}, 0.98) AS p98 FROM {t}),
  e AS (SELECT *, CASE WHEN q3 > q1 AND hi > q3 + 4 * (q3 - q1) THEN p98 ELSE hi END AS h, CASE WHEN q3 > q1 AND lo < q1 - 4 * (q3 - q1) THEN p02 ELSE lo END AS l FROM q),
  r AS (SELECT *, (h - l) / greatest(6, least(14, floor(sqrt(n) + 0.5))) AS rough FROM e),
  s AS (SELECT *, {step} AS step FROM (SELECT *, power(10, floor(log10(rough))) AS p, rough / power(10, floor(log10(rough))) AS f FROM r)),
  w AS (SELECT *, floor(l / step) * step AS first, greatest(1, CAST(ceil((h - floor(l / step) * step) / step + 1e-9) AS BIGINT)) AS bins FROM s)
  SELECT i AS bin, round(first + i * step, 6) AS low, round(first + (i + 1) * step, 6) AS high, coalesce(n_rows, 0) AS count
  FROM (SELECT unnest(range(bins)) AS i, first, step FROM w) b LEFT JOIN (
    SELECT CAST(greatest(0, least(bins - 1, floor(({c} - first) / step))) AS BIGINT) AS i, count(*) AS n_rows FROM {t}, w WHERE {c} IS NOT NULL GROUP BY 1) USING (i)"""
_STEP = "(CASE WHEN f <= 1 THEN 1 WHEN f <= 2 THEN 2 WHEN f <= 5 THEN 5 ELSE 10 END) * p"


@query(_HISTOGRAM.format(c="value", t="events", step=_STEP))
def histogram(t):
    return rounded(_histogram(t, t.events, "value", False), "low", "high")


@query(_HISTOGRAM.format(c="n_chars", t="documents", step=f"greatest(1, floor({_STEP} + 0.5))"))
def histogram_integer(t):
    return rounded(_histogram(t, t.documents, "n_chars", True), "low", "high")


@query("""SELECT CAST(user_id AS DOUBLE) AS x, value AS y FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS i, (count(*) OVER () + 1499) // 1500 AS stride FROM events) WHERE i % stride = 0""")
def scatter_points(t):
    pairs = t.events.select("event_id", F.col("user_id").cast("double").alias("user_id"), "value")
    n = pairs.count()
    return Z.scatter_points(pairs, "user_id", "value", -(-n // fixed.MAX_SCATTER_POINTS), ["event_id"])


_LOCATED = "(SELECT c_custkey, c_nationkey * 3.0 - 30 + c_acctbal / 1e4 AS lat, c_custkey % 97 * 1.5 - 60 AS lng FROM customer)"


def _located(t):
    return t.customer.select(
        "c_custkey", (F.col("c_nationkey") * 3.0 - 30 + F.col("c_acctbal") / 1e4).alias("lat"),
        (F.col("c_custkey") % 97 * 1.5 - 60).cast("double").alias("lng"),
    )


@query(f"""SELECT c_custkey, round((lng - min(lng) OVER ()) / (max(lng) OVER () - min(lng) OVER ()), 6) AS x,
  round(1 - (lat - min(lat) OVER ()) / (max(lat) OVER () - min(lat) OVER ()), 6) AS y FROM {_LOCATED}""")
def place_map(t):
    return rounded(Z.place_points(_located(t), "lat", "lng", ["c_custkey"]), "x", "y")


@query(f"""SELECT count(*) AS located, round(greatest(0.25, least(4, (max(lng) - min(lng)) * cos(radians((min(lat) + max(lat)) / 2)) / (max(lat) - min(lat)))), 6) AS aspect FROM {_LOCATED}""")
def place_bounds(t):
    return rounded(Z.place_bounds(_located(t), "lat", "lng"), "aspect").select("located", "aspect")


@query(f"""SELECT c_custkey, round(0.08 + (lng - min(lng) OVER ()) / greatest(max(lng) OVER () - min(lng) OVER (), 1e-6) * 0.84, 6) AS px,
  round(0.08 + (1 - (lat - min(lat) OVER ()) / greatest(max(lat) OVER () - min(lat) OVER (), 1e-6)) * 0.84, 6) AS py FROM {_LOCATED}""")
def normalize_points(t):
    return rounded(Z.normalize_points(_located(t), "lng", "lat", ["c_custkey"]), "px", "py")


# --- stories -------------------------------------------------------------------------------------
@query()
def story(t):
    told = S.story(t.orders, V.Noun("order", "orders"))
    return told.catalogue(t.spark)


@query()
def story_lineitem(t):
    return S.story(t.lineitem, V.Noun("line", "lines")).catalogue(t.spark)


@query()
def story_question(t):
    asked = S.story(t.lineitem, question="which return flag has the highest discount", order_by=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    return asked.catalogue(t.spark)


@query()
def candidate_views(t):
    profile = P.profile_table(t.events, ["event_id"])
    return S.catalogue(t.spark, V.candidate_views(t.events, profile))


_SHOWN = """CASE WHEN v >= 1e6 THEN rtrim(rtrim(printf('%.2f', round(v / 1e6, 2)), '0'), '.') || 'M' WHEN v >= 1e5 THEN printf('%.0f', round(v / 1e3, 0)) || 'K'
   WHEN v >= 1e4 THEN regexp_replace(printf('%.1f', round(v / 1e3, 1)), '\\.0$', '') || 'K' ELSE format('{:,}', CAST(floor(v + 0.5) AS BIGINT)) END"""


@query(f"""SELECT 'Rows' AS label, format('{{:,}}', count(*)) AS value, NULL AS detail FROM documents UNION ALL
  SELECT 'Average n chars', {_SHOWN.replace('v >=', 'a >=').replace('round(v', 'round(a').replace('floor(v', 'floor(a')}, 'Range ' || {_SHOWN.replace('v >=', 'l >=').replace('round(v', 'round(l').replace('floor(v', 'floor(l')} || ' to '
    || {_SHOWN.replace('v >=', 'h >=').replace('round(v', 'round(h').replace('floor(v', 'floor(h')} FROM (SELECT avg(n_chars) AS a, min(n_chars)::DOUBLE AS l, max(n_chars)::DOUBLE AS h FROM documents) UNION ALL
  SELECT * FROM (SELECT 'Top lang', lang, floor(100.0 * count(*) / (SELECT count(*) FROM documents) + 0.5)::INT || '% of rows' FROM documents GROUP BY lang ORDER BY count(*) DESC LIMIT 1)""")
def kpis(t):
    tiles = S.kpis(P.profile_table(t.documents))
    return t.spark.createDataFrame(tiles, "label string, value string, detail string")


@query("""WITH RECURSIVE made AS (SELECT p_brand, p_type, avg(p_size) / 100 + 0.2 AS score, min(p_partkey) AS position FROM part GROUP BY 1, 2),
  tables AS (SELECT p_brand, list({'item': p_type, 'score': score, 'kind': ['ranking', 'rate', 'trend', 'histogram', 'scatter', 'map'][position % 6 + 1], 'fields': [['size', 'price'][position % 2 + 1], p_type]} ORDER BY position) AS c FROM made GROUP BY 1),
  picked AS (SELECT p_brand, c, []::BIGINT[] AS picks, 0 AS step, NULL::STRUCT(w DOUBLE, i BIGINT) AS best FROM tables UNION ALL
    SELECT p_brand, c, list_append(picks, -best.i), step + 1, best FROM (SELECT p_brand, c, picks, step, list_sort(list_transform(
        list_filter(range(1, len(c) + 1), lambda i: c[i].score >= 0.3 AND NOT list_contains(picks, i)), lambda i: {'w': CASE
          WHEN len(list_filter(picks, lambda p: c[p].kind = c[i].kind)) >= CASE c[i].kind WHEN 'map' THEN 1 WHEN 'trend' THEN 2 WHEN 'ranking' THEN 3 WHEN 'rate' THEN 2 ELSE 1 END THEN 0.0
          ELSE c[i].score * pow(0.85, len(list_filter(picks, lambda p: c[p].kind = c[i].kind)))
            * pow(CASE WHEN c[i].fields[1] = 'price' THEN 0.9 ELSE 0.6 END, len(list_filter(picks, lambda p: list_contains(c[p].fields, c[i].fields[1]))))
            * pow(0.6, len(list_filter(picks, lambda p: list_contains(c[p].fields, c[i].fields[2])))) END, 'i': -i}), 'DESC')[1] AS best
      FROM picked WHERE step < 3) WHERE best.w > 0 AND best.w >= 0.24)
  SELECT p_brand, c[-best.i].item AS p_type, step::BIGINT AS pick FROM picked WHERE step > 0""")
def diversified_top_k(t):
    kinds = ["ranking", "rate", "trend", "histogram", "scatter", "map"]
    made = t.part.groupBy("p_brand", "p_type").agg(
        (F.avg("p_size") / 100 + 0.2).alias("score"), F.min("p_partkey").alias("position"),
    ).select(
        "p_brand", "p_type", "score", "position", pick(F.col("position"), *kinds).alias("kind"),
        F.array(pick(F.col("position"), "size", "price"), F.col("p_type")).alias("fields"), F.array(F.lit("price")).alias("measures"),
    )
    return S.diversified_top_k(made, "p_brand", "p_type", "score", "kind", "fields", "measures", "position", 3)


_STEM = """CASE WHEN length(w) > 5 AND w LIKE '%ing' THEN w[:-4] WHEN length(w) > 4 AND w LIKE '%ies' THEN w[:-4] || 'y' WHEN length(w) > 4 AND w LIKE '%es' THEN w[:-3]
  WHEN length(w) > 3 AND w LIKE '%s' THEN w[:-2] WHEN length(w) > 4 AND w LIKE '%ed' THEN w[:-3] ELSE w END"""


@query(f"""WITH q AS (SELECT p_partkey AS k, unnest(regexp_split_to_array(lower('Which brands sell most ' || p_name || ' of ' || p_type || ' sizes'), '[^a-z0-9]+')) AS w FROM part),
  a AS (SELECT DISTINCT k, {_STEM} AS s FROM q WHERE length(w) >= 3 AND w NOT IN ('which', 'most', 'the', 'with')),
  c AS (SELECT 'p_name' AS "column", 1 AS position, 'name' AS s UNION ALL SELECT 'p_brand', 2, 'brand' UNION ALL SELECT 'p_type', 3, 'type' UNION ALL SELECT 'p_size', 4, 'size' UNION ALL
    SELECT DISTINCT 'p_type', 3, {_STEM} FROM (SELECT lower(p_type) AS w FROM part))
  SELECT DISTINCT k, "column", position FROM a JOIN c ON a.s = c.s OR (a.s = 'siz' AND c.s = 'size' AND false)""")
def match_columns(t):
    questions = t.part.select(F.col("p_partkey").alias("k"), F.concat(
        F.lit("Which brands sell most "), F.col("p_name"), F.lit(" of "), F.col("p_type"), F.lit(" sizes")).alias("text"))
    return S.match_columns(questions, "k", "text", P.profile_table(t.part))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ['Quality', 'Toxic'] ELSE ['Toxic'] END AS columns,
  CASE WHEN doc_id % 3 = 0 THEN 'classes-name-columns' ELSE 'asks-for-existing-column' END AS reason FROM documents WHERE doc_id % 3 < 2""")
def answered_by_columns(t):
    questions = t.documents.select(
        "doc_id", pick(F.col("doc_id"), "Sort this text", F.concat(F.lit("Is this "), F.col("lang"), F.lit(" text toxic given its source?")),
                       "How long is it, given a toxic label?").alias("text"),
        pick(F.col("doc_id"), "choice", "probability", "probability").alias("kind"),
        F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("Quality"), F.lit("toxics"))).otherwise(F.array().cast("array<string>")).alias("classes"),
    )
    return S.answered_by_columns(questions, "doc_id", "text", "kind", "classes", P.profile_table(t.labels))


@query("""WITH v AS (SELECT p_partkey, p_partkey // 7 AS story, CASE WHEN p_size % 4 = 0 THEN 0 WHEN p_size % 4 = 1 THEN 1 ELSE 2 END AS o FROM part),
  n AS (SELECT *, count(*) FILTER (WHERE o > 0) OVER (PARTITION BY story) AS narrow, max(p_partkey) FILTER (WHERE o > 0) OVER (PARTITION BY story) AS last FROM v)
  SELECT story, p_partkey, row_number() OVER (PARTITION BY story ORDER BY o, p_partkey) AS place FROM n WHERE NOT (narrow >= 3 AND narrow % 2 = 1 AND p_partkey = last AND o > 0)""")
def arrange_views(t):
    kind = pick(F.col("p_size"), "trend", "ranking", "histogram", "scatter")
    chart = pick(F.col("p_size"), "line", "bars", "histogram", "scatter")
    views = t.part.select("p_partkey", F.floor(F.col("p_partkey") / 7).alias("story"), kind.alias("kind"), chart.alias("chart"))
    return S.arrange_catalogue(views, "story", "p_partkey", "p_partkey", "kind", "chart")


# --- formats ---------------------------------------------------------------------------------------
@query("""SELECT o_orderkey, CASE WHEN v >= 1e6 THEN rtrim(rtrim(printf('%.2f', round(v / 1e6, 2)), '0'), '.') || 'M' WHEN v >= 1e5 THEN printf('%.0f', round(v / 1e3, 0)) || 'K'
   WHEN v >= 1e4 THEN regexp_replace(printf('%.1f', round(v / 1e3, 1)), '\\.0$', '') || 'K' ELSE format('{:,}', CAST(round(v, 0) AS BIGINT)) END AS number,
  CASE WHEN s > 0 AND s < 1 THEN '<1%' WHEN s > 99 AND s < 100 THEN '>99%' WHEN s < 10 AND s <> floor(s) THEN regexp_replace(printf('%.1f', round(s, 1)), '\\.0$', '') || '%' ELSE CAST(floor(s + 0.5) AS BIGINT) || '%' END AS share,
  format('{:,}', o_orderkey * 977) AS count,
  CASE WHEN r >= 10 THEN CAST(floor(r + 0.5) AS BIGINT) || '×' ELSE regexp_replace(printf('%.1f', round(r, 1)), '\\.0$', '') || '×' END AS ratio
  FROM (SELECT o_orderkey, floor(o_totalprice) AS v, CAST(o_custkey % 1000 AS DOUBLE) / 8.0 / 100 * 100 AS s, (o_orderkey % 160) / 8.0 AS r FROM orders)""")
def format_numbers(t):
    v, s, r = F.floor("o_totalprice"), F.col("o_custkey") % 1000 / 8.0, (F.col("o_orderkey") % 160) / 8.0
    return t.orders.select(
        "o_orderkey", shown.number_text(v).alias("number"), shown.share_text(s / 100).alias("share"),
        shown.count_text(F.col("o_orderkey") * 977).alias("count"), shown.ratio_text(r).alias("ratio"),
    )


_DAY = "strftime(o_orderdate, '%b') || ' ' || day(o_orderdate)"


@query(f"""SELECT o_orderkey, {_DAY} || ', ' || year(o_orderdate) AS day, 'Week of ' || {_DAY} AS week, strftime(o_orderdate, '%b') || ' ' || year(o_orderdate) AS month,
  'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) AS quarter, CAST(year(o_orderdate) AS VARCHAR) AS year, {_DAY} || ', 12 AM' AS hour FROM orders""")
def format_times(t):
    d = F.col("o_orderdate")
    return t.orders.select(
        "o_orderkey", shown.day_text(d).alias("day"), shown.time_bucket_text(d, "week", False).alias("week"),
        *[shown.time_bucket_text(d, g, False).alias(g) for g in ("month", "quarter", "year", "hour")],
    )


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name[1:2]) || p_name[3:] ELSE lower(p_name[1:1]) || p_name[2:] END AS lowered,
  upper(p_name[1:1] || split_part(p_name, ' ', 2)[1:1]) AS code, upper(p_type[1:3]) AS short FROM part""")
def format_names(t):
    name = F.col("p_name")
    cell = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.upper(F.substring(name, 1, 2)), F.substring(name, 3, 100))).otherwise(F.initcap(name))
    cell = F.when(F.col("p_partkey") % 2 == 0, cell).otherwise(F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 100)))
    return t.part.select(
        "p_partkey", shown.lower_first_text(cell).alias("lowered"), shown.team_code(name).alias("code"),
        shown.team_code(F.col("p_type")).alias("short"),
    )
