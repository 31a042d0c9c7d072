"""Queries over live feeds, stored records and preparation jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grouping as G, jobs as J
from ..streaming import feed as L, records as K
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


def _seconds(c):
    return F.unix_micros(c.cast("timestamp"))


# --- states -------------------------------------------------------------------------------------
def _feed(t):
    """A nested feed record per event."""
    team = F.concat(F.lit('"team":{"displayName":"'), F.col("event_type"), F.lit('"}'))
    home = F.concat(F.lit('{"homeAway":"home","id":"1","score":"'), (F.col("user_id") % 40).cast("string"), F.lit('",'), team, F.lit("}"))
    away = F.when(F.col("event_id") % 5 == 0, '{"homeAway":"away","id":"2","score":"3"}').otherwise(
        '{"homeAway":"away","id":"2","score":"7","team":{"id":"2","abbreviation":"AWY"}}')
    date = F.concat(F.lit('"date":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('Z"'))
    state = F.when(F.col("event_id") % 3 == 0, "post").otherwise("in")
    return t.events.select(F.col("event_id").alias("row"), F.concat(
        F.lit('{"id":"'), F.col("user_id").cast("string"), F.lit('",'), date, F.lit(',"status":{"period":'), (F.col("event_id") % 4 + 1).cast("string"),
        F.lit(',"displayClock":"10:00","type":{"state":"'), state, F.lit('"}},"competitors":['), home, F.lit(","), away,
        F.lit('],"situation":{"possession":"2","down":3},"lastPlay":{"id":"'), F.col("event_id").cast("string"), F.lit('","sequenceNumber":"'),
        F.col("event_id").cast("string"), F.lit('"}}'),
    ).alias("json"))


@query("""SELECT event_id, CAST(user_id AS VARCHAR) AS id, event_id AS sequence_number, event_type AS home_team, CASE WHEN event_id % 5 <> 0 THEN 'AWY' END AS away_team,
  CAST(user_id % 40 AS INTEGER) AS home_score, 'Q' || (event_id % 4 + 1) AS quarter, CASE WHEN event_id % 3 = 0 THEN 'final' ELSE 'quarter' END AS status, 'away' AS possession,
  CAST(date_trunc('second', ts) AS TIMESTAMP) AS timestamp, CASE WHEN event_id % 5 = 0 THEN 'no team' END AS reject FROM events""")
def normalize_state(t):
    flat = L.normalize_state(_feed(t), "json")
    return flat.select(F.col("row").alias("event_id"), "id", "sequence_number", "home_team", "away_team", "home_score", "quarter", "status", "possession", "timestamp", "reject")


@query("""SELECT min(event_id) AS event_id, 'live' AS pick FROM events WHERE event_type IN ('click', 'view') UNION ALL SELECT event_id, 'preferred' FROM events WHERE event_id = 77""")
def pick_entity(t):
    state = F.when(F.col("event_type") == "click", "in").when(F.col("event_type") == "view", "halftime").otherwise("pre")
    live = L.pick_entity(t.events, "event_id", state, ["event_id"]).withColumn("pick", F.lit("live"))
    return live.unionByName(L.pick_entity(t.events, "event_id", state, ["event_id"], "77").withColumn("pick", F.lit("preferred")))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1""")
def dedupe_events(t):
    return L.dedupe_events(t.events.select("user_id", "event_id", "event_type", "ts"), "user_id", ["event_id"], ["ts"]).drop("ts")


_VERSIONS = "(SELECT event_id, user_id, CAST(floor(value) AS BIGINT) AS version FROM events)"


def _versions(t):
    return t.events.select("event_id", "user_id", F.floor("value").cast("bigint").alias("version"))


_VERDICT = f"""SELECT event_id, CASE WHEN b IS NULL OR version > b THEN 'LIVE' WHEN version = b THEN 'SAME' ELSE 'STALE' END AS verdict FROM (
  SELECT *, max(version) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM {_VERSIONS})"""


@query(_VERDICT)
def version_verdicts(t):
    return L.flag_versions(_versions(t), "user_id", "version", ["event_id"]).select("event_id", "verdict")


@query(f"""SELECT user_id, event_id, version FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY version DESC, event_id) AS n FROM {_VERSIONS}) WHERE n = 1""")
def latest_state(t):
    return L.latest_state(_versions(t), "user_id", "version", ["event_id"])


@query("""SELECT event_id, round((epoch_us(TIMESTAMP '2024-01-15 12:00:00') - epoch_us(ts)) / 1e6, 6) AS age_seconds,
  CASE WHEN epoch(TIMESTAMP '2024-01-15 12:00:00') - epoch(ts) > 180 THEN 'STALE' ELSE 'LIVE' END AS source_status FROM events""")
def stale_state(t):
    aged = L.staleness(t.events.select("event_id", "ts"), "ts", F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"))
    return rounded(aged, "age_seconds").drop("ts")


@query("""SELECT event_id, value FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events) WHERE i = least(300, n - 1) OR (i = n - 1)""")
def state_at(t):
    states = t.events.select("event_id", "ts", "value")
    both = L.state_at(states, 300, ["ts", "event_id"]).unionByName(L.state_at(states, 10**9, ["ts", "event_id"]))
    return both.select("event_id", "value")


# --- streams, run to their end and read back ---------------------------------------------------------
def _stream(t):
    schema = t.events.schema
    reader = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1)
    return reader.parquet(t.folder)


def _finish(t, stream, name: str):
    path = scratch(t.spark)
    sink = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-{name}")
    sink.trigger(availableNow=True).outputMode("append").start().awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(path)


@query("SELECT event_id, user_id FROM events")
def dedupe_stream(t):
    twice = _stream(t).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    single = L.dedupe_stream(twice, "event_id", "ts").select("event_id", "user_id")
    return _finish(t, single, "dedupe")


def _arrive(t, rows, part, write, parts: int = 5) -> None:
    """Hand a table to a ``foreachBatch`` function in parts, one micro-batch each, with a restart after each.

    A part is as many files as tasks wrote; what is new at a restart is one micro-batch.
    """
    path, cut = scratch(t.spark), rows.withColumn("__part", part)
    for k in range(parts):
        cut.where(F.col("__part") == k).drop("__part").write.mode("append").parquet(path)
        stream = t.spark.readStream.schema(rows.schema).parquet(path)
        sink = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}-progress")
        sink.trigger(availableNow=True).start().awaitTermination()


_FIFTH = "event_id * 5 // (SELECT max(event_id) + 1 FROM events)"


def _fifth(t):
    return F.floor(F.col("event_id") * 5 / (t.events.agg(F.max("event_id")).scalar() + 1))


@query(_VERDICT)
def version_verdicts_stream(t):
    rows, path = _versions(t), scratch(t.spark)
    _arrive(t, rows, _fifth(t), L.flag_versions_batches(path, "user_id", "version", ["event_id"]))
    return K.read_batches(t.spark, path, "user_id", "event_id bigint, verdict string")


_STEPS_SQL = "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, count(*) AS rows FROM events GROUP BY 1"


def _steps(t, stream):
    path = scratch(t.spark)
    sink = stream.writeStream.foreachBatch(L.trend_batches(path, "ts", "1 day")).option("checkpointLocation", f"{path}-progress")
    sink.trigger(availableNow=True).start().awaitTermination()
    steps = K.read_stored(t.spark, path, "bucket", "bucket timestamp, rows bigint", latest=True)
    return steps.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query(_STEPS_SQL)
def trend_stream(t):
    return _steps(t, _stream(t))


@query(_STEPS_SQL)
def trend_stream_all(t):
    path = scratch(t.spark)
    for k in range(4):  # four micro-batches, times in no order
        t.events.where(F.col("event_id") % 4 == k).coalesce(1).write.mode("append").parquet(path)
    return _steps(t, t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 1).parquet(path))


@query(f"""WITH parts AS (SELECT event_id, ts, least(4, {_FIFTH} + CASE WHEN event_id % 20 = 0 THEN 1 ELSE 0 END) AS part FROM events),
  tops AS (SELECT part, max(max(ts)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM parts GROUP BY part)
  SELECT event_id, ts FROM parts JOIN tops USING (part) WHERE ts < seen - INTERVAL 10 MINUTE""")
def late_rows_stream(t):
    path = scratch(t.spark)
    behind = F.least(F.lit(4), _fifth(t) + F.when(F.col("event_id") % 20 == 0, 1).otherwise(0))  # every twentieth comes a batch late
    _arrive(t, t.events.select("event_id", "ts"), behind, L.late_batches(path, "ts"))
    return K.read_batches(t.spark, path, "__all", "event_id bigint, ts timestamp_ntz")


# --- keys and stored records ---------------------------------------------------------------------------
@query("""SELECT event_id, length(CAST(user_id AS VARCHAR)) || ':' || user_id || '|' || length(event_type) || ':' || event_type || '|' || CASE WHEN event_id % 4 = 0 THEN '5:event' ELSE length(CAST(event_id AS VARCHAR)) || ':' || event_id END
  || '|64:' || sha256('{"event_type":"' || event_type || '","props":' || to_json(props) || '}') AS key FROM events""")
def idempotency_key(t):
    play = F.when(F.col("event_id") % 4 != 0, F.col("event_id").cast("string"))
    key = K.idempotency_key(F.col("user_id").cast("string"), F.concat(F.lit(" "), F.col("event_type")), play, K.state_hash("event_type", "props"))
    return t.events.select("event_id", key.alias("key"))


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'click' THEN 0 ELSE 1 END, event_id) AS n FROM events) WHERE n = 1""")
def put_if_absent(t):
    clicks = t.events.where("event_type = 'click'").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return K.put_if_absent(clicks, t.events.where("event_type <> 'click'").select("user_id", "event_id"), "user_id", ["event_id"])


@query(f"""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {_FIFTH}, ts, event_id) AS n FROM events) WHERE n = 1""")
def put_if_absent_stream(t):
    path = scratch(t.spark)
    _arrive(t, t.events.select("user_id", "event_id", "event_type", "ts"), _fifth(t), K.append_new(path, "user_id", ["ts", "event_id"]))
    return K.read_stored(t.spark, path, "user_id", "user_id bigint, event_id bigint, event_type string")


def _records(t):
    """A forecast record per event; a few do not add up."""
    home = F.round(F.col("value") / 1000, 3)
    away = F.round(0.5 - home / 2, 4)
    tie = F.when(F.col("event_id") % 6 == 0, 0.9).otherwise(1 - home - away)
    return t.events.select(
        "event_id", "user_id", "ts", F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
        F.when(F.col("event_id") % 9 != 0, "home").alias("choice"), F.struct(home.alias("home"), away.alias("away"), tie.alias("tie")).alias("probabilities"),
        F.lit(0.5).alias("confidence"),
    )


_RECORDS = """(SELECT event_id, user_id, ts, event_type, round(value / 1000, 3) AS home, round(0.5 - round(value / 1000, 3) / 2, 4) AS away FROM events
  WHERE event_type <> 'error' AND event_id % 9 <> 0 AND event_id % 6 <> 0)"""


@query(f"""SELECT user_id, event_id, CAST(floor((epoch_us(ts) - first_value(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 + 0.5) AS BIGINT) AS elapsed_seconds,
  round(floor(home * 10000 + 0.5) / 100, 4) AS home_probability, 50.0::DOUBLE AS confidence FROM {_RECORDS}""")
def records_to_points(t):
    points = K.records_to_points(_records(t), "user_id", "ts", ["ts", "event_id"])
    return points.select("user_id", "event_id", "elapsed_seconds", F.round("home_probability", 4).alias("home_probability"), "confidence")


@query("""SELECT event_id, event_type FROM events WHERE user_id = 7 ORDER BY ts, event_id LIMIT 64""")
def list_by_key(t):
    return K.list_by_key(t.events.select("event_id", "event_type", "user_id", "ts"), "user_id", 7, ["ts", "event_id"]).select("event_id", "event_type")


@query("""SELECT e.event_id, CASE WHEN e.event_id % 2 = 0 AND e.event_id % 9 <> 0 THEN 'home' END AS choice, NOT (e.event_id % 2 = 0 AND e.event_id % 9 <> 0) AS missed FROM events e""")
def replay(t):
    stored = _records(t).where("event_id % 2 = 0").select("event_id", "choice", "probabilities", "confidence")
    return K.replay(t.events.select("event_id"), stored, "event_id").select("event_id", "choice", "missed")


@query("""WITH p AS (SELECT user_id, event_id, ts, event_id % 50 AS elapsed, 60.0 + event_id % 3 AS a, 40.0 AS b FROM events),
  l AS (SELECT *, lag(ts) OVER w AS pt, lag(elapsed) OVER w AS pe FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
  SELECT 'time_order' AS rule, count(*) FILTER (WHERE ts <= pt) AS broken FROM l UNION ALL SELECT 'elapsed_order', count(*) FILTER (WHERE elapsed <= pe) FROM l UNION ALL
  SELECT 'total', count(*) FILTER (WHERE abs(a + b - 100) > 1e-9) FROM l UNION ALL SELECT 'duplicate_ids', 0""")
def check_series(t):
    points = t.events.select("user_id", "event_id", "ts", (F.col("event_id") % 50).alias("elapsed"),
                             (60.0 + F.col("event_id") % 3).alias("a"), F.lit(40.0).alias("b"))
    return K.check_series(points, "user_id", ["event_id"], "ts", "elapsed", ["a", "b"])


@query("""SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'state hash' WHEN value < 1 THEN 'latency' WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'live source' WHEN event_type <> 'error' AND event_id % 9 = 0 THEN 'choice'
  WHEN event_type <> 'error' AND event_id % 6 = 0 THEN 'distribution' END AS invalid FROM events""")
def validate_records(t):
    extra = t.events.select(
        "event_id", F.when(F.col("event_id") % 13 != 0, F.sha2("props", 256)).alias("state_hash"), F.col("event_type").alias("model"),
        (F.col("value") - 1).alias("latency_ms"), F.col("ts").alias("requested_at"), F.col("ts").alias("completed_at"),
        F.when(F.col("event_type") == "view", "live").otherwise("mock").alias("source"),
        F.when(F.col("event_id") % 2 == 0, "STALE").otherwise("LIVE").alias("source_status"),
    )
    return K.validate_records(_records(t).drop("ts").join(extra, "event_id")).select("event_id", "invalid")


@query("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'TIMEOUT' WHEN 1 THEN 'PROVIDER_429' WHEN 2 THEN 'PROVIDER_529' WHEN 3 THEN 'PROVIDER_404' WHEN 4 THEN 'CONNECTION' WHEN 5 THEN 'MALFORMED_RESPONSE' ELSE 'PROVIDER_ERROR' END AS code,
  event_id % 7 IN (0, 1, 2, 4) AS retryable FROM events""")
def error_class(t):
    status = pick(F.col("event_id"), F.lit(None).cast("int"), F.lit(429), F.lit(529), F.lit(404), F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(None).cast("int"))
    kind = pick(F.col("event_id"), "timeout", None, None, None, "connection", "malformed", None)
    failure = K.error_class(status, kind)
    return t.events.select("event_id", failure["code"].alias("code"), failure["retryable"].alias("retryable"))


# --- budgets -----------------------------------------------------------------------------------------------
def _requests(t):
    return t.events.select("event_id", "event_type", (_seconds(F.col("ts")) / 1000).cast("bigint").alias("at_ms"),
                           pick(F.col("event_id"), "consumed", "released", "consumed").alias("outcome"))


_ADMITTED = """WITH RECURSIVE r AS (SELECT event_id, event_type, epoch_us(ts) // 1000 AS m, CASE event_id % 3 WHEN 1 THEN 'released' ELSE 'consumed' END AS outcome,
    row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
  a AS (SELECT event_type, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::VARCHAR AS verdict, NULL::BIGINT AS last, 0::BIGINT AS consumed, []::BIGINT[] AS recent FROM r GROUP BY 1 UNION ALL
    SELECT event_type, n, event_id, verdict, CASE WHEN verdict = 'ADMITTED' THEN m ELSE last END, CASE WHEN verdict = 'ADMITTED' AND outcome = 'consumed' THEN consumed + 1 ELSE consumed END,
      CASE WHEN verdict = 'ADMITTED' AND outcome = 'consumed' THEN list_append(recent, m) ELSE recent END
    FROM (SELECT r.event_type, r.n, r.event_id, r.m, r.outcome, a.last, a.consumed, list_filter(a.recent, lambda x: x >= r.m - 600000) AS recent,
        CASE WHEN r.m - a.last < 90000 THEN 'CADENCE_LIMIT' WHEN a.consumed >= 5000 THEN 'REQUEST_LIMIT' WHEN len(list_filter(a.recent, lambda x: x >= r.m - 600000)) >= 2 THEN 'RATE_LIMIT'
          WHEN a.consumed + 1 > 5000 THEN 'SPEND_LIMIT' ELSE 'ADMITTED' END AS verdict
      FROM a JOIN r ON r.event_type = a.event_type AND r.n = a.n + 1))
  SELECT event_id, event_type, verdict FROM a WHERE n > 0"""
_LIMITS = {"max_requests_per_window": 2, "rate_window_ms": 600_000, "max_requests": 5_000, "max_spend_cents": 5_000}


@query(_ADMITTED)
def admit(t):
    return K.admit(_requests(t), "event_type", "at_ms", ["event_id"], _LIMITS, "outcome").select("event_id", "event_type", "verdict")


@query(_ADMITTED)
def admit_stream(t):
    path = scratch(t.spark)
    days = F.least(F.floor((F.col("at_ms") - F.unix_millis(F.lit("2024-01-01").cast("timestamp"))) / (6 * 86_400_000)), F.lit(4))
    _arrive(t, _requests(t), F.greatest(days, F.lit(0)), K.admit_batches(path, "event_type", "at_ms", ["event_id"], _LIMITS, "outcome"))
    return K.read_batches(t.spark, path, "event_type", "event_id bigint, event_type string, verdict string")


@query("""SELECT event_id, CASE WHEN n <= 25 THEN 'ADMITTED' ELSE 'SPEND_LIMIT' END AS verdict FROM (
  SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events)""")
def admit_spend(t):
    limits = {"cadence_ms": 0, "max_requests_per_window": 10**6, "max_requests": 10**6, "max_spend_cents": 50, "cost_cents": 2}
    return K.admit(_requests(t).drop("outcome"), "event_type", "at_ms", ["event_id"], limits).select("event_id", "verdict")


@query("""WITH RECURSIVE r AS (SELECT event_type, epoch_us(ts) // 1000 AS m FROM events),
  a AS (SELECT event_type, min(m) AS m FROM r GROUP BY 1 UNION ALL
    SELECT a.event_type, (SELECT min(r.m) FROM r WHERE r.event_type = a.event_type AND r.m >= a.m + 43200000) FROM a WHERE a.m IS NOT NULL)
  SELECT event_type, count(m) AS admitted FROM a GROUP BY 1""")
def admit_cadence(t):
    limits = {"cadence_ms": 43_200_000, "max_requests_per_window": 10**6, "max_requests": 10**6, "max_spend_cents": 10**6}
    verdicts = K.admit(_requests(t).drop("outcome"), "event_type", "at_ms", ["event_id"], limits)
    return verdicts.groupBy("event_type").agg(F.count_if(F.col("verdict") == "ADMITTED").alias("admitted"))


@query("""SELECT event_type AS scope, count(*) FILTER (WHERE o = 0) AS requests, CAST(2 * count(*) FILTER (WHERE o = 0) AS BIGINT) AS spend_cents, count(*) FILTER (WHERE o = 2) AS active, CAST(2 * count(*) FILTER (WHERE o = 2) AS BIGINT) AS active_cents
  FROM (SELECT event_type, event_id % 3 AS o FROM events) GROUP BY 1""")
def settle(t):
    reservations = t.events.select(F.col("event_id").alias("reservation_id"), F.col("event_type").alias("scope"), F.lit(2).alias("cost_cents"))
    outcomes = t.events.where("event_id % 3 < 2").select(
        F.col("event_id").alias("reservation_id"), F.when(F.col("event_id") % 3 == 0, "consumed").otherwise("released").alias("outcome"), F.col("ts").alias("settled_at"))
    return K.settle(reservations, outcomes)


@query("""SELECT event_type AS scope, max(user_id) AS cadence_ms, max(event_id) AS rate_window_ms, min(user_id) AS max_requests_per_window, min(event_id) AS max_requests, min(value) AS max_spend_cents, max(value) AS cost_cents FROM events GROUP BY 1""")
def stricter_limits(t):
    return K.stricter_limits(t.events.select(
        F.col("event_type").alias("scope"), F.col("user_id").alias("cadence_ms"), F.col("event_id").alias("rate_window_ms"),
        F.col("user_id").alias("max_requests_per_window"), F.col("event_id").alias("max_requests"), F.col("value").alias("max_spend_cents"), F.col("value").alias("cost_cents"),
    ), "scope")


# --- preparation jobs -----------------------------------------------------------------------------------------
@query("SELECT event_id, user_id, value FROM events WHERE event_type IN ('click', 'view') AND user_id < 100 AND value > 20")
def cut_slice(t):
    kept = J.cut_slice(t.events, [F.col("event_type").isin("click", "view"), F.col("user_id") < 100, F.col("value") > 20], ["event_id"])
    return kept.select("event_id", "user_id", "value")


_CREDIT = """CASE WHEN l_linestatus = 'O' THEN NULL WHEN l_returnflag = 'R' THEN {r} WHEN l_returnflag = 'A' AND l_discount > 0.02 THEN {a} END"""


def _credited(t):
    return J.credit(t.lineitem, [
        (F.col("l_returnflag") == "R", "l_suppkey", "supplier"), ((F.col("l_returnflag") == "A") & (F.col("l_discount") > 0.02), "l_partkey", "part"),
    ], F.col("l_linestatus") == "O")


@query(f"""SELECT credited_by, count(*) AS rows, count(DISTINCT credited_to) AS entities FROM (SELECT {_CREDIT.format(r="'supplier'", a="'part'")} AS credited_by,
  {_CREDIT.format(r='l_suppkey', a='l_partkey')} AS credited_to FROM lineitem) WHERE credited_by IS NOT NULL GROUP BY 1""")
def credit(t):
    return _credited(t).where("credited_by is not null").groupBy("credited_by").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("credited_to").alias("entities"))


@query("""SELECT 'o_orderkey' AS split, count(*) FILTER (WHERE o_orderdate < DATE '1998-01-01') AS first_rows, count(*) FILTER (WHERE o_orderdate >= DATE '1998-01-01') AS second_rows,
  max(o_orderkey) FILTER (WHERE o_orderdate < DATE '1998-01-01') >= min(o_orderkey) FILTER (WHERE o_orderdate >= DATE '1998-01-01') AS crossed FROM orders UNION ALL
  SELECT 'o_orderdate', count(*) FILTER (WHERE o_orderdate < DATE '1998-01-01'), count(*) FILTER (WHERE o_orderdate >= DATE '1998-01-01'), false FROM orders""")
def temporal_split(t):
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    by_key = J.temporal_split(t.orders, early, "o_orderkey")[2].withColumn("split", F.lit("o_orderkey"))
    return by_key.unionByName(J.temporal_split(t.orders, early, "o_orderdate")[2].withColumn("split", F.lit("o_orderdate")))


@query("SELECT l_quantity, l_discount, l_returnflag FROM lineitem")
def project_allowed(t):
    return J.project_allowed(t.lineitem, ["l_quantity", "l_discount", "l_returnflag"], {"l_extendedprice", "l_linestatus"})


@query("""WITH g AS (SELECT l_suppkey AS k, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' GROUP BY 1)
  SELECT CASE WHEN count(*) = 1 THEN min(s_name) ELSE 'Other/Tie' END AS label FROM g JOIN supplier ON s_suppkey = k WHERE q = (SELECT max(q) FROM g)""")
def label_winner(t):
    credited = _credited(t).where("credited_by = 'supplier'")
    totals = G.leaderboard(credited, "credited_to", F.col("l_quantity"))
    return J.label_winner(totals, t.supplier.select(F.col("s_suppkey").alias("entity"), F.col("s_name").alias("label")))


@query("""SELECT c_custkey, 'c_nationkey' AS field, CAST(c_nationkey AS VARCHAR) AS expected, CAST((c_nationkey + 1) % 25 AS VARCHAR) AS found FROM customer WHERE c_custkey % 10 = 3 UNION ALL
  SELECT c_custkey, '*', 'a record', NULL FROM customer WHERE c_custkey % 10 = 4""")
def lookup_identity(t):
    changed = F.when(F.col("c_custkey") % 10 == 3, (F.col("c_nationkey") + 1) % 25).otherwise(F.col("c_nationkey"))
    dim = t.customer.where("c_custkey % 10 <> 4").withColumn("c_nationkey", changed)
    return J.lookup_identity(t.customer, dim, "c_custkey", ["c_name", "c_nationkey"])


@query("""SELECT o_orderkey AS row, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS priority, round(floor(o_custkey * 1.2345678912 * 1e6 + 0.5) / 1e6, 6) AS longitude,
  strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderstatus = 'F' AS filled FROM orders""")
def clean_export(t):
    raw = t.orders.select(
        F.col("o_orderkey").alias("Row"), F.when(F.col("o_orderkey") % 4 == 0, " ? ").otherwise(F.concat(F.lit(" "), F.col("o_orderpriority"))).alias("Priority"),
        (F.col("o_custkey") * 1.2345678912).cast("string").alias("X"), F.date_format("o_orderdate", "MMddyyyy").alias("Date"),
        F.when(F.col("o_orderstatus") == "F", "TRUE").otherwise("").alias("Filled"),
    )
    spec = [("Row", "row", "text"), ("Priority", "priority", "text"), ("X", "longitude", "coordinate"), ("Date", "date", "date"), ("Filled", "filled", "flag")]
    return rounded(J.clean_export(raw, spec, ["date", "row"]), "longitude").withColumn("row", F.col("row").cast("bigint"))


@query("""SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS play, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice > 100000 END AS large FROM orders""")
def derive_rows(t):
    return J.derive_rows(t.orders.select("o_orderdate", "o_orderkey", "o_orderstatus", "o_totalprice"), ["o_orderdate", "o_orderkey"], {
        "o_orderkey": F.col("o_orderkey"), "large": F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") > 100_000),
    })


@query("""SELECT rule, broken, broken = 0 AS ok FROM (SELECT 'quantity' AS rule, count(*) FILTER (WHERE NOT l_quantity BETWEEN 1 AND 50) AS broken FROM lineitem UNION ALL
  SELECT 'discount', count(*) FILTER (WHERE l_discount > 0.08) FROM lineitem UNION ALL SELECT 'flag', 0 UNION ALL SELECT 'pinned', abs(count(*) FILTER (WHERE l_linestatus = 'F') - 30000) FROM lineitem)""")
def constraint_report(t):
    return J.constraint_report(t.lineitem, {
        "quantity": F.col("l_quantity").between(1, 50), "discount": F.col("l_discount") <= 0.08, "flag": F.col("l_returnflag").isin("A", "N", "R"),
    }, {"pinned": (F.col("l_linestatus") == "F", 30_000)})


@query("""SELECT 'ts' AS "column", count(*) FILTER (WHERE ts <= p) AS not_rising FROM (SELECT ts, lag(ts) OVER (ORDER BY event_id) AS p FROM events) UNION ALL
  SELECT 'user_id', count(*) FILTER (WHERE user_id <= p) FROM (SELECT user_id, lag(user_id) OVER (ORDER BY event_id) AS p FROM events)""")
def order_report(t):
    return J.order_report(t.events.select("event_id", "ts", "user_id"), ["event_id"], ["ts", "user_id"])


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'On the ground' WHEN 1 THEN 'In the trees' WHEN 2 THEN 'On the ground' ELSE source END AS label FROM documents""")
def place_label(t):
    cell = pick(F.col("doc_id"), " Ground Plane", "above_ground ", "ground", F.col("source"))
    return t.documents.select("doc_id", G.place_label(cell).alias("label"))


@query("""SELECT c_custkey, CASE WHEN abs(c_acctbal / 50) <= 90 THEN round(c_acctbal / 50, 6) END AS latitude, CASE WHEN abs(c_acctbal / 50) <= 90 THEN CAST(c_nationkey AS DOUBLE) END AS longitude FROM customer""")
def coords_of(t):
    located = t.customer.select("c_custkey", (F.col("c_acctbal") / 50).alias("lat"), F.col("c_nationkey").cast("string").alias("lng"))
    found = J.coords_of(located)
    return found.select("c_custkey", r6("latitude").alias("latitude"), "longitude")
