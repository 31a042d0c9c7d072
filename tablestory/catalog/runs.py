"""Queries over scoring runs, their results and the questions behind them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions.cells import normalize_text as normalized
from ..operators import grouping as G, profile as P, proposals as Q, scoring as R
from ..streaming.stored import KeyedStore
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


# --- scoring and checking answers ---------------------------------------------------------------
_ODDS = "greatest(0.01, least(0.99, 1 / (1 + exp(-({d} / (6 + 14 * greatest(0, least(1, {s} / 3600.0))))))))"


@query(f"SELECT event_id, round({_ODDS.format(d='(value - 50)', s='(user_id * 31 % 4000)')}, 6) AS odds FROM events")
def win_likelihood(t):
    odds = R.win_likelihood(F.col("value") - 50, F.col("user_id") * 31 % 4000)
    return t.events.select("event_id", r6(odds).alias("odds"))


@query(f"SELECT event_id, 'example' AS model, round({_ODDS.format(d='(value - 50)', s='1800')}, 6) AS value FROM events WHERE event_type <> 'error' UNION ALL SELECT event_id, 'example', NULL FROM events WHERE event_type = 'error'")
def score_rows(t):
    def scorer(batch: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        value = 1 / (1 + np.exp(-((batch["value"] - 50) / 13)))
        return pd.DataFrame({"value": value.clip(0.01, 0.99).where(batch["event_type"] != "error")})

    scored = R.score_rows(t.events.select("event_id", "event_type", "value"), ["event_id"], scorer, "example", 8)
    return rounded(scored, "value").select("event_id", "model", "value")


def _answers(t):
    """Answers of two classes derived from events; some do not add up or name an unknown class."""
    share = F.round(F.col("value") / 500, 4)
    rest = F.when(F.col("event_id") % 5 == 0, 1.2 - share).otherwise(1 - share)
    return t.events.select(
        "event_id", F.lit(None).cast("double").alias("value"),
        F.when(F.col("event_id") % 7 == 0, "maybe").when(share >= 0.5, "yes").otherwise("no").alias("selected_class"),
        F.create_map(F.lit("yes"), share, F.lit("no"), rest).alias("probabilities"),
        F.when(F.col("event_id") % 11 == 0, 1.5).otherwise(share).alias("confidence"),
    )


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN CASE WHEN 1.2 - round(value / 500, 4) > 1 THEN 'BAD_PROBABILITIES' ELSE 'INCONSISTENT_PROBABILITIES' END
  WHEN event_id % 7 = 0 THEN 'INCONSISTENT_PROBABILITIES' WHEN event_id % 11 = 0 THEN 'BAD_CONFIDENCE' END AS error FROM events""")
def validate_distribution(t):
    return R.validate_results(_answers(t), "choice", ["yes", "no"]).select("event_id", "error")


@query("""SELECT event_id, CASE WHEN v < 0 THEN NULL ELSE least(1.0, v) END AS score, CASE WHEN v > 1 OR v < 0 THEN NULL ELSE v END AS probability,
  CASE WHEN v > 1 OR v < 0 THEN 'BAD_PROBABILITY' END AS error FROM (SELECT event_id, round(value / 100, 4) AS v FROM events)""")
def validate_values(t):
    values = t.events.select(
        "event_id", F.round(F.col("value") / 100, 4).alias("value"), F.lit(None).cast("string").alias("selected_class"),
        F.lit(None).cast("map<string,double>").alias("probabilities"), F.lit(None).cast("double").alias("confidence"),
    )
    score = R.validate_results(values, "score").select("event_id", F.col("value").alias("score"))
    probability = R.validate_results(values, "probability").select("event_id", F.col("value").alias("probability"), "error")
    return score.join(probability, "event_id")


@query("""SELECT event_id, round(CASE WHEN abs(k) > 0.001 THEN NULL ELSE a / (a + b) END, 6) AS yes FROM (
  SELECT event_id, value / 500 AS a, 1 - value / 500 + (event_id % 5) * 0.0004 AS b, (event_id % 5) * 0.0004 AS k FROM events)""")
def rescale(t):
    a = F.col("value") / 500
    shares = F.create_map(F.lit("yes"), a, F.lit("no"), 1 - a + (F.col("event_id") % 5) * 0.0004)
    return t.events.select("event_id", r6(F.try_element_at(R.rescale(shares), F.lit("yes"))).alias("yes"))


@query("""SELECT event_id, round(greatest(0, least(1, CAST(props->>'k' AS DOUBLE) / 3)), 6) AS value FROM events""")
def level_value(t):
    level = F.get_json_object("props", "$.k").cast("double")
    return t.events.select("event_id", r6(R.level_value(level, 4)).alias("value"))


@query("""SELECT event_id, 'model-' || event_type AS model, CASE WHEN event_id % 3 = 2 THEN NULL ELSE CAST(props->>'k' AS DOUBLE) / 100 END AS value,
  CASE WHEN event_id % 3 = 2 THEN event_type END AS choice FROM events""")
def parse_answer(t):
    k = F.get_json_object("props", "$.k").cast("double") / 100
    model = F.concat(F.lit('"model":"model-'), F.col("event_type"), F.lit('"'))
    plain = F.concat(F.lit("{"), model, F.lit(',"answers":{"classification":{"type":"probability","probability":'), k.cast("string"), F.lit("}}}"))
    wrapped = F.concat(F.lit('{"data":{"result":{'), model, F.lit(',"classification":{"type":"score","score":"'), k.cast("string"), F.lit('"}}}}'))
    choice = F.concat(F.lit('{"body":{'), model, F.lit(',"choice":" '), F.col("event_type"), F.lit(' ","probabilities":{"a":0.5,"b":0.5}}}'))
    texts = t.events.select("event_id", pick(F.col("event_id"), plain, wrapped, choice).alias("text"))
    return R.parse_answers(texts, "text").select("event_id", "answer.model", "answer.value", "answer.choice")


# --- the state of runs ---------------------------------------------------------------------------
@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_rows(t):
    return R.pending_rows(t.documents.select("doc_id", "lang"), t.labels, ["doc_id"])


@query("""SELECT count(*) AS completed FROM (SELECT r, row_number() OVER (ORDER BY r) - 1 AS n FROM (SELECT DISTINCT doc_id AS r FROM labels)) WHERE r = n""")
def completed_prefix(t):
    return R.completed_prefix(t.labels.select(F.col("doc_id").alias("row_index")))


@query("""SELECT lang AS run_id, count(quality) AS completed_rows, count(*) AS total_rows, CAST(floor(count(quality) * 100 / count(*) + 0.5) AS BIGINT) AS percent
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def run_progress(t):
    totals = t.documents.groupBy(F.col("lang").alias("run_id")).agg(F.count(F.lit(1)).alias("total_rows"))
    done = t.labels.join(t.documents.select("doc_id", F.col("lang").alias("run_id")), "doc_id")
    return R.progress(done, totals)


@query("""SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1""")
def upsert_latest(t):
    columns = ["user_id", "event_id", "event_type", "value"]
    old, new = t.events.where("event_id % 2 = 0").select(*columns), t.events.where("event_id % 2 = 1").select(*columns)
    return R.upsert_rows(old, new, ["user_id"], "event_id").select(*columns)


@query("""SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1""")
def upsert_stored(t):
    store = KeyedStore(t.spark, scratch(t.spark), "user_id")
    for k in range(3):
        delta = t.events.where(F.col("event_id") % 3 == k).select("user_id", "event_id", "event_type", "value")
        R.upsert_stored(store, delta, "event_id", k)
    return store.read(delta.schema, latest=True)


@query("""SELECT o_orderkey, sha256('{"v":1,"dataset":"' || o_orderstatus || '","question":"Is it ' || lower(o_orderpriority) || '?","kind":"' || CASE WHEN o_orderkey % 2 = 0 THEN 'choice","classes":["High","Low","Mid"]}' ELSE 'probability","classes":[]}' END) AS content_key FROM orders""")
def content_key(t):
    shuffled = pick(F.col("o_orderkey"), F.array(F.lit("Mid "), F.lit("High"), F.lit("Low")), F.array(F.lit("b"), F.lit("a")),
                    F.array(F.lit("Low"), F.lit(""), F.lit(" High"), F.lit("Mid")), F.array(F.lit("x")))
    kind = F.when(F.col("o_orderkey") % 2 == 0, "choice").otherwise("probability")
    question = F.concat(F.lit("  Is it "), F.lower("o_orderpriority"), F.lit("? "))
    return t.orders.select("o_orderkey", R.content_key(F.col("o_orderstatus"), question, kind, shuffled).alias("content_key"))


def _runs(t):
    """One run per event: the user is the question, the kind of event is the status."""
    status = F.when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "click", "running").when(
        F.col("event_type") == "view", "queued").otherwise("error")
    return t.events.select(
        F.col("event_id").alias("run_id"), F.col("user_id").alias("content_key"), status.alias("status"),
        F.col("ts").alias("updated_at"),
        F.when(F.col("event_id") % 3 == 0, (F.col("ts") + F.expr("INTERVAL 5 MINUTE")).cast("timestamp_ntz")).alias("lease_expires_at"),
    )


_RUNS = """(SELECT event_id AS run_id, user_id AS content_key, CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'click' THEN 'running' WHEN 'view' THEN 'queued' ELSE 'error' END AS status,
  ts AS updated_at, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 5 MINUTE END AS lease_expires_at FROM events)"""


@query(f"""SELECT content_key, run_id, status, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY content_key ORDER BY CASE status WHEN 'complete' THEN 0 WHEN 'running' THEN 1 ELSE 2 END, updated_at DESC, run_id DESC) AS n
  FROM {_RUNS} WHERE status <> 'error') WHERE n = 1""")
def reusable_run(t):
    return R.reusable_run(_runs(t)).drop("lease_expires_at")


@query(f"""SELECT run_id FROM {_RUNS} WHERE status IN ('queued', 'running') AND epoch(TIMESTAMP '2024-01-15 12:00:00') - epoch(updated_at) >= 60
  AND (lease_expires_at IS NULL OR lease_expires_at <= TIMESTAMP '2024-01-15 12:00:00')""")
def stalled_runs(t):
    now = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    return R.stalled_runs(_runs(t), now).select("run_id")


@query("""SELECT event_id, call_number, call_number <= 40 AS admitted FROM (
  SELECT event_id, row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS call_number FROM events)""")
def daily_quota(t):
    calls = t.events.select("event_id", "ts", F.col("event_type").alias("provider"), F.to_date("ts").alias("day"))
    return R.daily_quota(calls, 40, ["provider", "day"], ["ts", "event_id"]).select("event_id", "call_number", "admitted")


# --- results in row order ----------------------------------------------------------------------------
@query("SELECT name, count(*) AS count FROM (SELECT role AS name FROM conversations) GROUP BY 1 UNION ALL SELECT 'tool', 0")
def result_classes(t):
    return G.class_distribution(t.conversations, "role", ["user", "assistant", "tool"])


@query("""SELECT event_id, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS n_0, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS n_1
  FROM events WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def running_distribution(t):
    return R.running_distribution(t.events.select("event_id", "event_type"), "event_type", ["click", "view"], ["event_id"]).drop("event_type")


@query("SELECT event_id AS row_index, round(least(1, event_id / (SELECT count(*) - 1 FROM events)), 6) AS x, round(least(1, value / 100), 6) AS y FROM events")
def series_points(t):
    total = t.events.agg(F.count(F.lit(1))).scalar()
    scored = t.events.select("event_id", (F.col("value") / 100).alias("value"))
    return rounded(R.series_points(scored, total, "event_id"), "x", "y")


@query("""SELECT event_id + 1 AS row_id, CASE WHEN event_id % 7 = 0 THEN 'maybe' WHEN round(value / 500, 4) >= 0.5 THEN 'yes' ELSE 'no' END AS selected_class,
  round(value / 500, 4) AS yes, round(CASE WHEN event_id % 5 = 0 THEN 1.2 - round(value / 500, 4) ELSE 1 - round(value / 500, 4) END, 6) AS no FROM events""")
def results_csv(t):
    answers = _answers(t).withColumnRenamed("event_id", "row_index")
    return rounded(R.results_csv(answers, "choice", ["yes", "no"]), "yes", "no")


@query("""SELECT '#' || (event_id + 1) AS row, event_id AS user_row, event_type, CAST(floor(least(1, value / 100) * 100 + 0.5) AS BIGINT) || '%' AS answer, CAST(NULL AS VARCHAR) AS confidence
  FROM events ORDER BY event_id LIMIT 8""")
def results_preview(t):
    results = t.events.select(
        F.col("event_id").alias("row_index"), F.col("event_id").alias("user_row"), "event_type",
        (F.col("value") / 100).alias("value"), F.lit(None).cast("string").alias("selected_class"),
        F.lit(None).cast("string").alias("error"), F.lit(None).cast("double").alias("confidence"),
    )
    return R.results_preview(results, ["user_row", "event_type", "value"])


@query("""SELECT e.event_id, l.doc_id AS found_row, CAST(l.quality AS BIGINT) AS found_value FROM events e ASOF LEFT JOIN labels l ON e.event_id >= l.doc_id""")
def asof_seek(t):
    found = R.seek_many(t.events.select("event_id"), t.labels, "event_id", "doc_id", "quality")
    return found.withColumn("found_value", F.col("found_value").cast("bigint"))


@query("SELECT doc_id, quality FROM labels WHERE doc_id <= 100 ORDER BY doc_id DESC LIMIT 1")
def seek(t):
    return R.seek(t.labels.select("doc_id", "quality"), 100, "doc_id")


# --- questions -----------------------------------------------------------------------------------------
@query("SELECT conv_id, turn, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS task FROM conversations")
def normalize_text(t):
    return t.conversations.select("conv_id", "turn", normalized(F.col("text")).alias("task"))


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'probability' WHEN 1 THEN 'score' WHEN 2 THEN 'choice' WHEN 3 THEN 'score' WHEN 4 THEN 'choice' ELSE 'probability' END AS kind FROM documents""")
def question_kind(t):
    text = pick(
        F.col("doc_id"), F.concat(F.lit("How the game went for "), F.col("source")), F.concat(F.lit("Rate the quality of each play in "), F.col("source")),
        F.concat(F.lit("Sort "), F.col("source"), F.lit(" into groups")), '{"type":"score","instructions":"x"}',
        F.concat(F.lit('{"type":"choice","instructions":"win likelihood in '), F.col("lang"), F.lit('"}')), "Where are they eating?",
    )
    return t.documents.select("doc_id", R.question_kind(text).alias("kind"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN [lang, source, 'Other'] WHEN 1 THEN ['good', 'bad'] WHEN 2 THEN [source, lang] ELSE [] END AS classes FROM documents""")
def classes_from_text(t):
    text = pick(
        F.col("doc_id"), F.concat(F.lit("Classify each row as "), F.col("lang"), F.lit(", "), F.col("source"), F.lit(" or Other using the text")),
        "good vs bad", F.concat(F.lit("Pick one: "), F.col("source"), F.lit(", '"), F.col("lang"), F.lit("', rows, "), F.upper("lang")),
        "What is this about?",
    )
    return t.documents.select("doc_id", R.classes_from_text(text).alias("classes"))


@query("""SELECT position, value FROM (SELECT source AS value, row_number() OVER (ORDER BY min(doc_id)) AS position FROM documents GROUP BY 1) WHERE position <= 32""")
def classes_from_label_column(t):
    labelled = t.documents.select("doc_id", "lang", F.col("source").alias("source_label"))
    found = R.classes_from_label_column(labelled, ["doc_id"])
    return t.spark.createDataFrame([(i + 1, v) for i, v in enumerate(found)], "position bigint, value string")


@query("""SELECT doc_id, [lang, source, 'Other'] AS classes FROM documents""")
def merge_class_lists(t):
    return t.documents.select("doc_id", R.merge_class_lists(
        F.array("lang", F.concat(F.lit(" "), F.upper("lang"))), F.array("source", F.lit("Other"), F.lit("")),
    ).alias("classes"))


def _drafts(t):
    """One list of drafts per source, derived from documents."""
    return t.documents.select(
        "source", "doc_id",
        pick(F.col("doc_id"), F.concat(F.lit("How  toxic in "), F.col("lang")), "Classify by lang", F.concat(F.lit("Topic of "), F.col("lang")), "", "Tone").alias("title"),
        pick(F.col("doc_id"), "Is this spam?", "Which language?", "Which topic fits?", "Nothing", "Which tone?").alias("question"),
        F.lit(None).cast("string").alias("reason"),
        pick(F.col("doc_id"), "probability", "choice", "choice", "probability", "choice").alias("kind"),
        pick(F.col("doc_id"), F.array().cast("array<string>"), F.array(F.lit("en"), F.lit("de"), F.lit("fr"), F.lit("es")), F.array(F.lit("News"), F.lit("Sport")),
             F.array().cast("array<string>"), F.array(F.lit("Calm"))).alias("classes"),
    )


_PACKED = """(SELECT source, doc_id, base || CASE WHEN n = 1 THEN '' ELSE '-' || n END AS proposal_id, title, kind, visual FROM (
  SELECT *, row_number() OVER (PARTITION BY source, base ORDER BY doc_id) AS n FROM (
    SELECT source, doc_id, CASE doc_id % 5 WHEN 0 THEN 'How toxic in ' || lang WHEN 1 THEN 'Classify by lang' ELSE 'Topic of ' || lang END AS title,
      CASE doc_id % 5 WHEN 0 THEN 'probability' ELSE 'choice' END AS kind, CASE doc_id % 5 WHEN 0 THEN 'series' ELSE 'bars' END AS visual,
      CASE doc_id % 5 WHEN 0 THEN 'series-how-toxic-in-' || lang WHEN 1 THEN 'bars-classify-by-lang' ELSE 'bars-topic-of-' || lang END AS base
    FROM documents WHERE doc_id % 5 < 3)))"""


@query(f"SELECT source, doc_id, proposal_id, title, kind, visual FROM {_PACKED}")
def pack_proposals(t):
    return Q.pack_proposals(_drafts(t), "source", ["doc_id"]).drop("question", "reason", "classes")


@query(f"SELECT source, doc_id, proposal_id FROM {_PACKED} WHERE doc_id % 5 <> 1")
def proposal_quality(t):
    packed = Q.pack_proposals(_drafts(t), "source", ["doc_id"])
    return Q.proposal_quality(packed, P.profile_table(t.documents), "doc_id").select("source", "doc_id", "proposal_id")


@query("""SELECT source, proposal_id, position FROM (SELECT source, proposal_id, CAST(row_number() OVER (PARTITION BY source ORDER BY s, doc_id, proposal_id) AS INTEGER) AS position FROM (
  SELECT source, lang AS proposal_id, min(CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END) AS s, min_by(doc_id, (CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1000000 END) + doc_id) AS doc_id FROM documents GROUP BY 1, 2)) WHERE position <= 4""")
def merge_proposals(t):
    named = t.documents.select(F.col("source").alias("shop"), F.col("lang").alias("proposal_id"), "doc_id")
    merged = Q.merge_proposals(named.where("doc_id % 2 = 0"), named.where("doc_id % 2 = 1"), "shop", ["doc_id"])
    return merged.select(F.col("shop").alias("source"), "proposal_id", "position")


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'places' WHEN 1 THEN 'series' WHEN 2 THEN 'series' WHEN 3 THEN 'bars' WHEN 4 THEN 'series' ELSE 'bars' END AS visual FROM documents""")
def route_chart(t):
    text = pick(F.col("doc_id"), "Where are they eating?", F.concat(F.lit("How the game went, "), F.col("lang")), "x", "x", "x", "x")
    kind = pick(F.col("doc_id"), "choice", "choice", "score", "choice", "probability", None)
    classes = F.array().cast("array<string>")
    return t.documents.select("doc_id", Q.route_chart(kind, text, classes).alias("visual"))
