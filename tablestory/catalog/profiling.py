"""Queries over reading, typing and profiling tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import cells, fixed
from ..operators import profile as P
from ..sources import tables as S, text_tables as C
from .common import Tables, pick, r6, rounded, scratch

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _as_text(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def _type_sql(table: str, columns: list[str]) -> str:
    parts = []
    for c in columns:
        t = f"nullif(trim(CAST({c} AS VARCHAR)), '')"
        parts.append(f"""SELECT '{c}' AS "column", CASE WHEN count({t}) = 0 THEN 'empty'
          WHEN count({t}) = count(*) FILTER (WHERE lower({t}) IN ('true','false','yes','no')) THEN 'boolean'
          WHEN count({t}) = count(*) FILTER (WHERE regexp_matches({t}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$')) THEN 'number'
          ELSE 'string' END AS type FROM {table}""")
    return " UNION ALL ".join(parts)


_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query(_type_sql("customer", _CUSTOMER) + " UNION ALL "
       + _type_sql("(SELECT 'yes' AS told, NULL AS nothing FROM part)", ["told", "nothing"]))
def infer_types(t):
    told = t.part.select(F.lit("yes").alias("told"), F.lit(None).cast("string").alias("nothing"))
    return C.infer_types(_as_text(t.customer)).unionByName(C.infer_types(told))


_COERCED = """SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, c_name, CAST(c_nationkey AS DOUBLE) AS c_nationkey,
    round(c_acctbal, 6) AS c_acctbal, c_mktsegment{} FROM customer"""


@query(_COERCED.format(", c_nationkey > 12 AS wide"))
def coerce(t):
    raw = _as_text(t.customer.withColumn("wide", F.when(F.col("c_nationkey") > 12, "Yes").otherwise("no")))
    types = {"c_custkey": "number", "c_name": "string", "c_nationkey": "number", "c_acctbal": "number",
             "c_mktsegment": "string", "wide": "boolean"}
    return rounded(C.coerce(raw, types), "c_acctbal")


@query(_COERCED.format(""))
def csv_round_trip(t):
    path = scratch(t.spark)
    C.write_csv(t.customer, path)
    return rounded(C.load_table(t.spark, path, sep=","), "c_acctbal")


@query("""SELECT CAST(doc_id AS VARCHAR) AS doc_id, length(text) AS chars, sha256(replace(text, chr(13), '')) AS text_hash, lang, source FROM documents""")
def csv_quoted_large(t):
    path = scratch(t.spark)
    C.write_csv(t.documents.select("doc_id", "text", "lang", "source"), path)
    read = C.read_csv(t.spark, path)
    return read.select("doc_id", F.length("text").cast("bigint").alias("chars"), F.sha2("text", 256).alias("text_hash"), "lang", "source")


@query("""SELECT CASE WHEN commas >= greatest(tabs, semis, bars) AND commas > 0 THEN ',' WHEN tabs >= greatest(semis, bars) AND tabs > 0 THEN '\t'
  WHEN semis >= bars AND semis > 0 THEN ';' WHEN bars > 0 THEN '|' ELSE ',' END AS delimiter
  FROM (SELECT length(v) - length(replace(v, ',', '')) AS commas, length(v) - length(replace(v, chr(9), '')) AS tabs,
   length(v) - length(replace(v, ';', '')) AS semis, length(v) - length(replace(v, '|', '')) AS bars
   FROM (SELECT c_name || '|' || c_mktsegment || '|' || c_nationkey AS v FROM customer ORDER BY c_custkey LIMIT 1))""")
def sniff_delimiter(t):
    lines = t.customer.orderBy("c_custkey").limit(1).select(
        F.concat_ws("|", "c_name", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("value")
    )
    return C.sniff_delimiter(lines)


@query("""SELECT * FROM (
  SELECT 'rows' AS rule, count(*) AS found, CAST(500 AS BIGINT) AS allowed FROM documents UNION ALL
  SELECT 'columns', CAST(5 AS BIGINT), CAST(100 AS BIGINT) UNION ALL
  SELECT 'cell', max(greatest(length(CAST(doc_id AS VARCHAR)), length(text), length(lang), length(source), length(CAST(n_chars AS VARCHAR)))), CAST(8192 AS BIGINT) FROM documents
  ) WHERE found > allowed""")
def check_bounds(t):
    return C.check_bounds(t.documents, max_rows=500)


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts, event_id LIMIT 8")
def preview(t):
    return S.preview(t.events.select("event_id", "ts", "user_id", "event_type"), ["ts", "event_id"]).drop("ts")


_ROW_JSON = """'{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '","o_totalprice":' || o_totalprice
  || ',"o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') || '","o_orderpriority":"' || o_orderpriority || '"}'"""
_HASHED = f"(SELECT sha256({_ROW_JSON}) AS h FROM orders)"
_SUMS = " || '|' || ".join(
    f"CAST(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS UBIGINT)) AS VARCHAR)" for i in range(8)
)


@query(f"SELECT o_orderkey, sha256({_ROW_JSON}) AS row_hash FROM orders")
def row_hash(t):
    return t.orders.select("o_orderkey", S.row_hash(t.orders).alias("row_hash"))


@query(f"SELECT count(*) AS rows, sha256(CAST(count(*) AS VARCHAR) || '|' || {_SUMS}) AS content_hash FROM {_HASHED}")
def content_hash(t):
    return S.content_hash(t.orders)


@query(f"SELECT count(*) AS rows, sha256(CAST(count(*) AS VARCHAR) || '|' || {_SUMS}) AS content_hash FROM {_HASHED}")
def content_hash_appended(t):
    path = scratch(t.spark)
    for k in range(3):
        S.append_rows(t.orders.where(F.col("o_orderkey") % 3 == k), path, "orders", ["o_orderdate", "o_orderkey"])
    return S.stored_hash(t.spark, path, "orders")


@query(f"""SELECT 'orders' AS dataset_id, 'upload' AS source_type, 'Orders' AS display_name,
  sha256(CAST(count(*) AS VARCHAR) || '|' || {_SUMS}) AS content_hash, 6 AS column_count,
  count(*) AS accepted_row_count, CAST(1700000000000 AS BIGINT) AS created_at FROM {_HASHED}""")
def table_metadata(t):
    made = S.table_metadata(t.orders, "orders", "Orders", created_at=1_700_000_000_000)
    return made.withColumn("column_count", F.size("columns")).drop("columns")


@query("""SELECT 'customers' AS dataset_id, row_number() OVER (ORDER BY c_name, c_custkey) - 1 AS row_index, c_custkey, c_name
  FROM customer""")
def stored_table(t):
    path = scratch(t.spark)
    S.write_table(t.customer.select("c_custkey", "c_name"), path, "customers", ["c_name", "c_custkey"])
    S.write_table(t.supplier.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name")), path,
                  "suppliers", ["c_name", "c_custkey"])
    return S.read_table(t.spark, path, "customers").select("dataset_id", "row_index", "c_custkey", "c_name")


@query("""SELECT 'people' AS dataset_id, row_number() OVER (ORDER BY part, name, k) - 1 AS row_index, k, name
  FROM (SELECT 1 AS part, c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT 2, s_suppkey, s_name FROM supplier)""")
def stored_table_appended(t):
    path = scratch(t.spark)
    suppliers = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    S.append_rows(t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), path, "people", ["name", "k"])
    S.append_rows(suppliers, path, "people", ["name", "k"])
    return S.read_table(t.spark, path, "people").select("dataset_id", "row_index", "k", "name")


@query("""SELECT 'suppliers' AS dataset_id, row_number() OVER (ORDER BY s_name, s_suppkey) - 1 AS row_index, s_suppkey AS k, s_name AS name
  FROM supplier""")
def stored_table_replaced_empty(t):
    path = scratch(t.spark)
    customers = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    suppliers = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    S.write_table(customers, path, "customers", ["name", "k"])
    S.write_table(suppliers, path, "suppliers", ["name", "k"])
    S.write_table(customers.where("k IS NULL"), path, "customers", ["name", "k"])
    left = S.read_table(t.spark, path, "customers").unionByName(S.read_table(t.spark, path, "suppliers"))
    return left.select("dataset_id", "row_index", "k", "name")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS dataset_id, c_name AS display_name, 'upload' AS source_type,
  CAST(c_nationkey AS BIGINT) AS accepted_row_count, CAST(c_acctbal * 100 AS BIGINT) AS created_at
  FROM customer ORDER BY created_at, dataset_id LIMIT 48""")
def list_tables(t):
    return S.list_tables(t.customer.select(
        F.col("c_custkey").cast("string").alias("dataset_id"), F.col("c_name").alias("display_name"),
        F.lit("upload").alias("source_type"), F.col("c_nationkey").cast("bigint").alias("accepted_row_count"),
        F.round(F.col("c_acctbal") * 100).cast("bigint").alias("created_at"),
    ))


@query("""SELECT CAST(conv_id AS VARCHAR) || '-' || turn AS run_id, CAST(conv_id AS VARCHAR) AS dataset_id, substr(text, 1, 80) AS title,
  role AS status, turn AS completed_rows, turn + 1 AS total_rows, conv_id AS created_at
  FROM conversations ORDER BY created_at, run_id LIMIT 48""")
def list_runs(t):
    return S.list_runs(t.conversations.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("run_id"),
        F.col("conv_id").cast("string").alias("dataset_id"), F.col("text").alias("query"), F.col("role").alias("status"),
        F.col("turn").alias("completed_rows"), (F.col("turn") + 1).alias("total_rows"), F.col("conv_id").alias("created_at"),
    ))


_MARKS = ["=", "+", "-", "@", "\t", ""]


@query("""SELECT p_partkey, CASE WHEN p_partkey % 6 < 5 THEN '''' ELSE '' END ||
  CASE p_partkey % 6 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@' WHEN 4 THEN chr(9) ELSE '' END || p_name AS cell FROM part""")
def escape_formulas(t):
    cell = F.concat(pick(F.col("p_partkey"), *_MARKS), F.col("p_name"))
    return C.escape_formulas(t.part.select("p_partkey", cell.alias("cell")), ["cell"])


@query("""SELECT o_orderkey, '[' || o_orderkey || ',' || o_custkey || ']' AS keys,
  '{"status":"' || o_orderstatus || '","priority":"' || o_orderpriority || '"}' AS facts FROM orders""")
def flatten_values(t):
    return C.flatten_values(t.orders.select(
        "o_orderkey", F.array("o_orderkey", "o_custkey").alias("keys"),
        F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).alias("facts"),
    ))


# --- cells ----------------------------------------------------------------------------------------
_BLANKS = ["NA", " n/a ", "", "?", None, "--", " Null\t"]


@query("""SELECT o_orderpriority, count(*) AS rows, count(*) FILTER (WHERE o_orderkey % 8 < 7) AS missing FROM orders GROUP BY 1""")
def is_missing(t):
    raw = t.orders.select("o_orderpriority", pick(F.col("o_orderkey"), *_BLANKS, F.col("o_orderpriority")).alias("cell"))
    return raw.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(cells.is_missing(F.col("cell"))).alias("missing")
    )


def _distinct_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS present, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS "distinct" FROM {table}"""
        for c in columns
    )


_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
         "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query(_distinct_sql("lineitem", _LINE))
def distinct_profile(t):
    return P.distinct_profile(t.lineitem)


@query(_distinct_sql("documents", ["doc_id", "text", "lang", "source", "n_chars"]))
def distinct_texts(t):
    return P.distinct_profile(t.documents)


@query("""SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false
  WHEN 4 THEN true WHEN 5 THEN NULL ELSE false END AS flag FROM orders""")
def as_flag(t):
    cell = pick(F.col("o_orderkey"), "Yes", " n ", "TRUE", "0", "1", "maybe", "F")
    return t.orders.select("o_orderkey", cells.as_flag(cell).alias("flag"))


@query("""SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN o_custkey + 1000.5 WHEN 1 THEN -CAST(o_custkey AS DOUBLE) WHEN 2 THEN CAST(o_custkey AS DOUBLE)
   WHEN 3 THEN o_custkey * 1000.0 WHEN 4 THEN NULL WHEN 5 THEN CAST(o_custkey AS DOUBLE) WHEN 6 THEN CAST(o_custkey + 1000000 AS DOUBLE) ELSE NULL END AS number,
  CASE o_orderkey % 8 WHEN 0 THEN '$' WHEN 2 THEN '%' WHEN 5 THEN '€' END AS unit FROM orders""")
def as_number(t):
    key = F.col("o_custkey")
    whole = key.cast("string")
    cell = pick(
        F.col("o_orderkey"), F.concat(F.lit("$"), F.format_number(key + 1000.5, 2)), F.concat(F.lit("("), whole, F.lit(")")),
        F.concat(whole, F.lit("%")), F.concat(whole, F.lit("e3")), F.concat(F.lit("a"), whole), F.concat(whole, F.lit("€")),
        F.format_number(key + 1000000, 0), F.concat(F.lit("1$"), whole),
    )
    number = cells.as_number(cell)
    return t.orders.select(
        "o_orderkey", number.alias("number"), F.when(number.isNotNull(), cells.number_unit(cell)).alias("unit")
    )


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 8 THEN NULL WHEN o_orderkey % 9 IN (4, 6) THEN CAST(date_trunc('month', o_orderdate) AS TIMESTAMP)
  WHEN o_orderkey % 9 = 1 THEN o_orderdate + INTERVAL 5 HOUR + INTERVAL 7 MINUTE ELSE o_orderdate END AS moment FROM orders""")
def as_time(t):
    d = F.col("o_orderdate")
    cell = pick(
        F.col("o_orderkey"), F.date_format(d, "yyyy-MM-dd"), F.concat(F.date_format(d, "yyyy/M/d"), F.lit(" 05:07")),
        F.date_format(d, "M/d/yyyy"), F.date_format(d, "MM-dd-yy"), F.date_format(d, "yyyy-MM"),
        F.date_format(d, "MMM d, yyyy"), F.date_format(d, "MMMM yyyy"), F.date_format(d, "d MMMM yyyy"),
        F.concat(F.date_format(d, "yyyy"), F.lit("-02-31")),
    )
    return t.orders.select("o_orderkey", cells.as_time(cell).alias("moment"))


@query("""SELECT 'month first' AS spelling, max(month(o_orderdate)) > 12 AS day_first FROM orders UNION ALL
  SELECT 'day first', max(day(o_orderdate)) > 12 FROM orders""")
def date_order(t):
    spelled = t.orders.select(
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("m"), F.date_format("o_orderdate", "dd.MM.yyyy").alias("d")
    )
    return P.date_order(spelled, "m").select(F.lit("month first").alias("spelling"), "day_first").unionByName(
        P.date_order(spelled, "d").select(F.lit("day first").alias("spelling"), "day_first")
    )


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN o_orderdate END AS moment FROM orders")
def compact_date(t):
    d = F.col("o_orderdate")
    cell = pick(F.col("o_orderkey"), F.date_format(d, "yyyyMMdd"), F.date_format(d, "MMddyyyy"), "99999999")
    return t.orders.select("o_orderkey", cells.compact_date(cell.cast("bigint")).alias("moment"))


def _stats_sql(columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(CAST(sum(CAST({c} AS DECIMAL(18,2))) AS DOUBLE), 2) AS sum,
        round(avg({c}), 6) AS mean, bool_and({c} = floor({c})) AS integer FROM lineitem""" for c in columns
    )


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query(_stats_sql(_NUMBERS))
def numeric_stats(t):
    return P.numeric_stats(t.lineitem, _NUMBERS).withColumns({"sum": F.round("sum", 2), "mean": r6("mean")})


def _steps_sql(columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(v) AS present, count(*) FILTER (WHERE p IS NOT NULL) AS steps, count(*) FILTER (WHERE v > p) AS rising,
      count(*) FILTER (WHERE v >= p) AS not_falling, round(count(*) FILTER (WHERE v > p) / count(p), 6) AS share,
      count(v) >= 3 AND count(*) FILTER (WHERE v >= p) / count(p) >= 0.85 AS monotonic
      FROM (SELECT CAST({c} AS DOUBLE) AS v, lag(CAST({c} AS DOUBLE)) OVER (ORDER BY ts, event_id) AS p FROM events)""" for c in columns
    )


@query(_steps_sql(["event_id", "user_id", "value"]))
def monotonic_share(t):
    shares = P.monotonic_share(t.events, ["event_id", "user_id", "value"], ["ts", "event_id"])
    monotonic = (F.col("present") >= 3) & (F.col("not_falling") / F.col("steps") >= 0.85)
    return rounded(shares, "share").withColumn("monotonic", monotonic)


@query("SELECT p_name AS value, count(*) AS n FROM part GROUP BY 1")
def top_labels(t):
    return P.top_labels(t.part, "p_name")


@query("SELECT monthname(o_orderdate) AS label, month(o_orderdate) AS position, count(*) AS n FROM orders GROUP BY 1, 2")
def calendar_order(t):
    labels = t.orders.groupBy(F.date_format("o_orderdate", "MMMM").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return labels.withColumn("position", cells.calendar_position(F.col("label"), fixed.MONTHS)).orderBy("position")


@query("""SELECT 'hours' AS "column", count(*) AS pairs, round(corr(epoch(ts) / 3600.0, event_id), 6) AS r, abs(corr(epoch(ts) / 3600.0, event_id)) > 0.97 AS clock FROM events UNION ALL
  SELECT 'value', count(*), round(corr(value, event_id), 6), abs(corr(value, event_id)) > 0.97 FROM events""")
def drop_clocks(t):
    hours = F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9
    typed = t.events.select(F.col("event_id").cast("double").alias("event_id"), hours.alias("hours"), "value")
    return rounded(P.clock_scores(typed, "event_id", ["hours", "value"]), "r")


_RESOLUTION = """SELECT '{n}' AS name, CASE WHEN bool_and(month(m) = 1 AND day(m) = 1) THEN 'year' WHEN bool_and(day(m) = 1) THEN 'month' ELSE 'day' END AS resolution
  FROM (SELECT {e} AS m FROM {t})"""


@query(" UNION ALL ".join(_RESOLUTION.format(n=n, e=e, t=t) for n, e, t in [
    ("order day", "o_orderdate", "orders"), ("order month", "date_trunc('month', o_orderdate)", "orders"),
    ("order year", "date_trunc('year', o_orderdate)", "orders"), ("event", "ts", "events")]))
def time_resolution(t):
    def one(df, name, moment):
        return df.select(moment.alias("m")).agg(P.resolution(F.col("m")).alias("resolution")).select(
            F.lit(name).alias("name"), "resolution")

    day = F.col("o_orderdate")
    return (
        one(t.orders, "order day", day).unionByName(one(t.orders, "order month", F.date_trunc("month", day)))
        .unionByName(one(t.orders, "order year", F.date_trunc("year", day))).unionByName(one(t.events, "event", F.col("ts")))
    )


_PAIR_SQL = """SELECT '{a}' AS first, '{b}' AS second, CAST(sum(n) AS BIGINT) AS paired, count(*) = count(DISTINCT x) AND count(*) = count(DISTINCT y) AS bijective
  FROM (SELECT {ea} AS x, {eb} AS y, count(*) AS n FROM {t} WHERE {ea} IS NOT NULL AND {eb} IS NOT NULL GROUP BY 1, 2)"""


@query(" UNION ALL ".join(_PAIR_SQL.format(a=a, b=b, ea=ea, eb=eb, t="lineitem") for a, b, ea, eb in [
    ("flag", "word", "l_returnflag", "lower(l_returnflag) || '!'"), ("flag", "status", "l_returnflag", "l_linestatus"),
    ("part", "supplier", "CAST(l_partkey AS VARCHAR)", "CAST(l_suppkey AS VARCHAR)")]))
def restatement_pairs(t):
    named = t.lineitem.select(
        F.col("l_returnflag").alias("flag"), F.concat(F.lower("l_returnflag"), F.lit("!")).alias("word"),
        F.col("l_linestatus").alias("status"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"),
    )
    return P.restatements(named, [("flag", "word"), ("flag", "status"), ("part", "supplier")])


@query(_PAIR_SQL.format(a="n_nationkey", b="n_name", ea="n_nationkey", eb="n_name", t="nation"))
def restatement_nation(t):
    return P.restatements(t.nation, [("n_nationkey", "n_name")])


def _number_kind(c: str, table: str) -> str:
    return f"""SELECT '{c}' AS "column", CASE WHEN count(DISTINCT {c}) < 2 THEN 'constant' WHEN bool_and({c} IN (0, 1)) THEN 'flag'
      WHEN bool_and({c} = floor({c})) AND count(DISTINCT {c}) <= 12 AND max({c}) - min({c}) < 12 THEN 'ordinal' ELSE 'measure' END AS kind,
      count({c}) AS present, count(DISTINCT {c}) AS "distinct", round(CAST(min({c}) AS DOUBLE), 6) AS min, round(CAST(max({c}) AS DOUBLE), 6) AS max FROM {table}"""


def _text_kind(c: str, table: str) -> str:
    d, n = f"count(DISTINCT {c})", f"count({c})"
    return f"""SELECT '{c}' AS "column", CASE WHEN {d} <= 20 AND ({d} <= 0.5 * {n} OR {n} <= 20) AND {d} < {n} THEN 'category' WHEN {d} <= 0.5 * {n} THEN 'entity'
      WHEN {d} > 0.9 * {n} THEN 'id' ELSE 'text' END, {n}, {d}, NULL, NULL FROM {table}"""


@query(" UNION ALL ".join(
    [_number_kind(c, "lineitem") for c in ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey", "l_orderkey")]
    + [_text_kind(c, "lineitem") for c in ("l_returnflag", "l_linestatus")]
    + ["""SELECT 'l_shipdate', 'time', count(l_shipdate), count(DISTINCT l_shipdate), NULL, NULL FROM lineitem"""]))
def column_kinds(t):
    return rounded(P.profile(t.lineitem), "min", "max").select("column", "kind", "present", "distinct", "min", "max")


@query(" UNION ALL ".join(
    [_number_kind(c, "part") for c in ("p_partkey", "p_size", "p_retailprice")]
    + [_text_kind(c, "part") for c in ("p_name", "p_brand", "p_type")]))
def column_kinds_part(t):
    return rounded(P.profile(t.part), "min", "max").select("column", "kind", "present", "distinct", "min", "max")


@query()
def profile(t):
    return P.profile(t.events, ["event_id"])


@query("""SELECT 'doc_id' AS "column", 'number' AS type, 'id' AS role, count(DISTINCT doc_id) AS cardinality, 1.0::DOUBLE AS unique_ratio FROM labels UNION ALL
  SELECT 'quality', 'number', 'boolean', count(DISTINCT quality), round(count(DISTINCT quality) / count(*), 6) FROM labels UNION ALL
  SELECT 'toxic', 'number', 'boolean', count(DISTINCT toxic), round(count(DISTINCT toxic) / count(*), 6) FROM labels""")
def table_shape(t):
    return rounded(P.table_shape(t.labels), "unique_ratio")


@query("""SELECT count(*) || ' × 3' AS part FROM labels UNION ALL SELECT 'Numbers 3'""")
def schema_summary(t):
    parts = P.schema_summary(t.labels)
    return t.spark.createDataFrame([(p,) for p in parts], "part string")


@query("SELECT 'events' AS name, true AS has_row_order UNION ALL SELECT 'part', false")
def has_row_order(t):
    rows = [("events", P.profile_table(t.events).has_row_order()), ("part", P.profile_table(t.part).has_row_order())]
    return t.spark.createDataFrame(rows, "name string, has_row_order boolean")


@query("""SELECT count(*) AS rows, 7 AS columns, 'lat' AS latitude, 'lng' AS longitude, ['city'] AS places, ['event_id', 'ts'] AS times, ['large'] AS booleans,
  (SELECT avg(CASE WHEN event_id >= p THEN 1.0 ELSE 0 END) >= 0.85 FROM (SELECT event_id, lag(event_id) OVER (ORDER BY ts, event_id) AS p FROM events) WHERE p IS NOT NULL) AS sequential FROM events""")
def shape_facts(t):
    table = t.events.select(
        "event_id", "ts", "value", (F.col("value") > 50).alias("large"), F.concat(F.lit("c"), (F.col("user_id") % 9).cast("string")).alias("city"),
        (F.col("value") / 10).alias("lat"), (F.col("value") / 7 - 30).alias("lng"),
    )
    return P.shape_facts(table, ["ts", "event_id"])
