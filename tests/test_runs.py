"""Scoring runs, feeds and budgets, checked against plain Python."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablestory.operators import proposals as Q, scoring as R
from tablestory.streaming import budgets, feed as L, records as K
from tablestory.streaming.stored import KeyedStore


def test_a_run_resumes_where_it_stopped(spark):
    rows = spark.range(20).select(F.col("id").alias("row_index"), (F.col("id") / 20.0).alias("x"))
    calls = spark.sparkContext.accumulator(0)

    def scorer(batch: pd.DataFrame) -> pd.DataFrame:
        calls.add(len(batch))
        return pd.DataFrame({"value": batch["x"]})

    first = R.validate_results(R.score_rows(rows.where("row_index < 7 or row_index = 12"), ["row_index"], scorer), "probability").cache()
    assert first.count() == 8 and R.completed_prefix(first).first().completed == 7
    left = R.pending_rows(rows, first, ["row_index"])
    assert left.count() == 12
    second = R.validate_results(R.score_rows(left, ["row_index"], scorer), "probability").cache()
    done = R.upsert_rows(first.withColumn("v", F.lit(1)), second.withColumn("v", F.lit(2)), ["row_index"], "v")
    assert done.count() == 20 and R.completed_prefix(done).first().completed == 20
    assert calls.value == 20 and done.where("error is not null").count() == 0


def test_a_failing_batch_is_an_error_row(spark):
    def scorer(batch):
        raise RuntimeError("no")

    out = R.score_rows(spark.range(3).withColumnRenamed("id", "row_index"), ["row_index"], scorer).collect()
    assert [r.error for r in out] == ["SCORER_ERROR: RuntimeError"] * 3


def test_prefix_edges(spark):
    make = lambda *v: spark.createDataFrame([(x,) for x in v], "row_index int")
    assert [R.completed_prefix(make(*v)).first().completed for v in ([], [1, 2], [0], [2, 0, 1, 1, 4])] == [0, 0, 1, 3]


def test_content_key_ignores_class_order(spark):
    df = spark.createDataFrame([(" d", "q ", "choice", ["b", "a "]), ("d", "q", "choice", ["a", "b"]), ("d", "q", "choice", ["a", "c"])],
                               "d string, q string, k string, c array<string>")
    keys = [r.x for r in df.select(R.content_key(F.col("d"), F.col("q"), F.col("k"), F.col("c")).alias("x")).collect()]
    assert keys[0] == keys[1] != keys[2]


@pytest.mark.parametrize("text, classes", [
    ("Classify rows as spam, ham or other using the text", ["spam", "ham", "other"]), ("cats vs dogs", ["cats", "dogs"]),
    ("Tone: calm, Calm, angry.", ["calm", "angry"]), ("What is it?", []),
])
def test_classes_in_questions(spark, text, classes):
    df = spark.createDataFrame([(text,)], "t string")
    assert list(df.select(R.classes_from_text(F.col("t")).alias("c")).first().c) == classes


def test_seek(spark):
    results = spark.createDataFrame([(2, "a"), (5, "b"), (9, "c")], "row_index int, v string")
    assert [R.seek(results, p).first().v for p in (0, 2, 4, 5, 100)] == ["a", "a", "a", "b", "c"]


def test_probability_tables(spark):
    df = spark.createDataFrame([({"a": 0.6, "b": 0.4004},), ({"a": 0.6, "b": 0.6},), ({"a": 0.5, "b": 0.5},)], "p map<string,double>")
    found = [r.s for r in df.select(R.rescale(F.col("p")).alias("s")).collect()]
    assert sum(found[0].values()) == pytest.approx(1.0) and found[1] is None and found[2] == {"a": 0.5, "b": 0.5}


def test_proposal_ids_and_charts(spark):
    drafts = spark.createDataFrame([
        ("t", 1, "Topic fit!", "Which topic?", None, "choice", ["A", "B"]), ("t", 2, "Topic  fit", "Which one?", None, "choice", ["A", "a"]),
        ("t", 3, "topic fit", "Which kind?", "r", "choice", ["x", "y"]), ("t", 4, "Odds", "How likely?", None, None, None)],
        "d string, n int, title string, question string, reason string, kind string, classes array<string>")
    packed = Q.pack_proposals(drafts, "d", ["n"]).orderBy("n").collect()
    assert [(r.n, r.proposal_id, r.visual) for r in packed] == [
        (1, "bars-topic-fit", "bars"), (3, "bars-topic-fit-2", "bars"), (4, "series-odds", "series")]


# --- feeds -------------------------------------------------------------------------------------
def test_versions_batch_and_stream_agree(spark, tmp_path):
    r = random.Random(2)
    made = [(i, "hot" if r.random() < 0.5 else f"g{r.randint(0, 5)}", r.randint(0, 30)) for i in range(400)]
    df = spark.createDataFrame(made, "n int, game string, version bigint")
    newest, wanted = {}, {}
    for n, game, version in made:
        best = newest.get(game)
        wanted[n] = "LIVE" if best is None or version > best else "SAME" if version == best else "STALE"
        newest[game] = max(version, best if best is not None else version)
    assert {x.n: x.verdict for x in L.flag_versions(df, "game", "version", ["n"]).collect()} == wanted
    latest = {x.game: x.version for x in L.latest_state(df, "game", "version", ["n"]).collect()}
    assert latest == newest
    for i in range(4):  # four batches in arrival order
        df.where(f"n div 100 = {i}").coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    reader = spark.readStream.schema("n int, game string, version bigint").option("maxFilesPerTrigger", 1)
    stream = reader.option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    write = L.flag_versions_batches(str(tmp_path / "out"), "game", "version", ["n"])
    stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    for i in range(400, 500):  # a restart, with one more batch
        best = newest["hot"]
        wanted[i] = "LIVE" if i % 50 > best else "SAME" if i % 50 == best else "STALE"
        newest["hot"] = max(best, i % 50)
    spark.range(400, 500).selectExpr("int(id) AS n", "'hot' AS game", "id % 50 AS version").coalesce(1).write.parquet(str(tmp_path / "in" / "part=9"))
    stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert {x.n: x.verdict for x in K.read_batches(spark, str(tmp_path / "out"), "game", "n int, verdict string").collect()} == wanted


def test_latest_state_takes_arrivals_of_any_type(spark):
    df = spark.createDataFrame([("a", 2, "b", "x"), ("a", 2, "a", "y"), ("a", 1, "0", "z"), ("b", 0, "q", "w")], "k string, v int, at string, what string")
    got = {r.k: r.what for r in L.latest_state(df.withColumn("stamp", F.lit("2024-01-01").cast("timestamp")), "k", "v", ["stamp", "at"]).collect()}
    assert got == {"a": "y", "b": "w"}


def test_a_listing_has_as_many_records_as_asked_for(spark):
    df = spark.range(300).selectExpr("id", "1 AS key")
    assert K.list_by_key(df, "key", 1, ["id"], 200).count() == 200 and K.list_by_key(df, "key", 1, ["id"]).count() == 64
    with pytest.raises(ValueError):
        K.list_by_key(df, "key", 1, ["id"], 0)


def test_first_write_wins_across_batches(spark, tmp_path):
    path = str(tmp_path / "records")
    write = K.append_new(path, "key", ["at"])
    batch = lambda *v: spark.createDataFrame(v, "key string, at int, v string")
    write(batch(("a", 2, "late"), ("a", 1, "first"), ("b", 1, "b")), 0)
    write(batch(("a", 0, "again"), ("c", 5, "c")), 1)
    stored = lambda: sorted((r.key, r.v) for r in K.read_stored(spark, path, "key", "key string, v string").collect())
    assert stored() == [("a", "first"), ("b", "b"), ("c", "c")]
    files = sorted(p.name for p in tmp_path.rglob("*.parquet"))
    write(batch(("d", 0, "played again"), ("c", 5, "c")), 1)
    assert stored() == [("a", "first"), ("b", "b"), ("c", "c")] and files == sorted(p.name for p in tmp_path.rglob("*.parquet"))
    # What a failed attempt left behind does not count, and the next one replaces it.
    batch(("e", 1, "half")).withColumns({"__b": F.lit(3), "__v": F.lit(2)}).write.partitionBy("__b", "__v").mode("append").parquet(f"{path}/rows")
    assert stored() == [("a", "first"), ("b", "b"), ("c", "c")]
    write(batch(("e", 1, "whole")), 2)
    assert stored() == [("a", "first"), ("b", "b"), ("c", "c"), ("e", "whole")]


def test_an_upsert_leaves_other_buckets_alone(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path), "id", 16)
    R.upsert_stored(store, spark.range(100).selectExpr("id", "0 AS at", "'old' AS v"), "at", 0)
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    R.upsert_stored(store, spark.createDataFrame([(5, 1, "new"), (7, -1, "older"), (500, 1, "more")], "id bigint, at int, v string"), "at", 1)
    after = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    assert all(after[p] == t for p, t in before.items()) and 1 <= len(after) - len(before) <= 3
    got = {r.id: r.v for r in store.read("id bigint, at int, v string", latest=True).collect()}
    assert got == {**{k: "old" for k in range(100)}, 5: "new", 500: "more"}


@pytest.mark.parametrize("buckets", [1, 7, 64, 300])
def test_the_log_names_its_buckets(spark, tmp_path, buckets):
    store = KeyedStore(spark, str(tmp_path), "id", buckets)
    store.put(spark.range(1000), 3, ["id"])
    wanted = {r[0] for r in spark.range(1000).select(store.bucket()).collect()}
    assert set(store.log()[3]) == wanted and store.read("id bigint").count() == 1000


LIMITS = {"cadence_ms": 50, "rate_window_ms": 400, "max_requests_per_window": 3, "max_requests": 25, "max_spend_cents": 40, "cost_cents": 2}


def plain_budget(requests, limits):
    """One decision at a time, as the rules say."""
    last, consumed, active, recent, out = None, 0, 0, [], []
    for at, outcome in requests:
        recent = [t for t in recent if t >= at - limits["rate_window_ms"]]
        if last is not None and at - last < limits["cadence_ms"]:
            out.append("CADENCE_LIMIT")
        elif consumed + active >= limits["max_requests"]:
            out.append("REQUEST_LIMIT")
        elif len(recent) + active >= limits["max_requests_per_window"]:
            out.append("RATE_LIMIT")
        elif (consumed + active) * limits["cost_cents"] + limits["cost_cents"] > limits["max_spend_cents"]:
            out.append("SPEND_LIMIT")
        else:
            out.append("ADMITTED")
            last = at
            if outcome == "consumed":
                consumed, recent = consumed + 1, recent + [at]
            elif outcome != "released":
                active += 1
    return out


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("change", [{}, {"max_requests": 5}, {"cadence_ms": 0, "max_requests_per_window": 10**6, "max_requests": 10**6}, {"max_requests_per_window": 1}])
def test_budget_runs_match_single_decisions(seed, change):
    r = random.Random(seed)
    limits = {**LIMITS, **change}
    times = sorted(r.randint(0, 6000) for _ in range(500))
    ends = [r.choice(["consumed", "consumed", "released"] + ([None] if seed == 3 else [])) for _ in times]
    made = K.Budget(limits).decide(np.array(times), ends)
    assert list(made) == plain_budget(list(zip(times, ends)), limits)


def test_admit_over_scopes_and_batches(spark):
    r = random.Random(8)
    made = [(i, "hot" if r.random() < 0.5 else f"s{r.randint(0, 4)}", r.randint(0, 9000), r.choice(["consumed", "released"])) for i in range(2000)]
    df = spark.createDataFrame(made, "id int, scope string, at bigint, outcome string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        found = {x.id: x.verdict for x in K.admit(df, "scope", "at", ["id"], LIMITS, "outcome").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for scope in {m[1] for m in made}:
        own = sorted((m for m in made if m[1] == scope), key=lambda m: (m[2], m[0]))
        assert [found[m[0]] for m in own] == plain_budget([(m[2], m[3]) for m in own], LIMITS)


@pytest.mark.parametrize("change", [
    {}, {"cadence_ms": 400, "max_requests": 10**6, "max_spend_cents": 10**6}, {"max_requests": 10**6, "max_spend_cents": 10**6},
    {"cadence_ms": 300, "rate_window_ms": 300, "max_requests_per_window": 1, "max_requests": 17}, {"cadence_ms": 0, "max_spend_cents": 10**6, "max_requests": 10**6},
])
@pytest.mark.parametrize("open_share", [0.0, 0.02])
def test_admit_over_ranges_of_one_scope(spark, change, open_share):
    r = random.Random(len(change) + int(open_share * 100))
    limits = {**LIMITS, **change}
    made = [(i, None if r.random() < 0.2 else "hot" if r.random() < 0.8 else f"s{i % 90}", r.randint(0, 8000),
             None if r.random() < open_share else r.choice(["consumed", "released"])) for i in range(1500)]
    df = spark.createDataFrame(made, "id int, scope string, at bigint, outcome string").repartition(3)
    found = {x.id: x.verdict for x in K.admit(df, "scope", "at", ["id"], limits, "outcome", ranges=12).collect()}
    assert len(found) == len(made)
    for scope in {m[1] for m in made}:
        own = sorted((m for m in made if m[1] == scope), key=lambda m: (m[2], m[0]))
        assert [found[m[0]] for m in own] == plain_budget([(m[2], m[3]) for m in own], limits)


def test_dense_requests_need_few_rounds(monkeypatch):
    """A request every millisecond: admissions keep the phase they began with, and every range follows from its summary."""
    limits = {**LIMITS, "cadence_ms": 70, "rate_window_ms": 60, "max_requests": 10**6, "max_spend_cents": 10**6}
    scopes, times = {"x": [budgets.Unit(k, 1000 * k) for k in range(50)]}, {k: np.arange(1000 * k, 1000 * k + 1000) for k in range(50)}
    rounds = []

    def run(asked):
        rounds.append(len(asked))
        for (k, scope), state in asked.items():
            made = K.Budget(limits, (*state[:3], list(state[3])))
            made.decide(times[k], ["consumed"] * 1000)
            ended = made.used()
            yield k, scope, state, (*ended[:3], tuple(ended[3])), budgets.Steps.of(times[k], np.ones(1000, bool), budgets.waits(limits))

    entered = budgets._entered(scopes, limits, run)
    assert rounds == [50]
    whole = K.Budget(limits)
    for k in range(50):
        last, consumed, active, _ = entered[k, "x"]
        assert (last, consumed, active) == ((whole.last if whole.last is not None and 1000 * k - whole.last < 70 else None), whole.consumed, 0)
        whole.decide(times[k], ["consumed"] * 1000)


def test_admit_of_an_empty_table(spark):
    assert K.admit(spark.createDataFrame([], "id int, scope string, at bigint"), "scope", "at", ["id"]).count() == 0


def test_keys_do_not_collide(spark):
    df = spark.createDataFrame([("a|1", "b", None), ("a", "1|b", None), ("a", "b", "")], "g string, e string, p string")
    keys = [r.k for r in df.select(K.idempotency_key(F.col("g"), F.col("e"), F.col("p"), F.lit("s")).alias("k")).collect()]
    assert len(set(keys)) == 3 and keys[2] == "1:a|1:b|5:event|1:s"


def test_admit_stream_matches_batch(spark, tmp_path):
    r = random.Random(4)
    made = sorted((r.randint(0, 5000), i, f"s{r.randint(0, 2)}") for i in range(300))
    df = spark.createDataFrame([(i, s, at, r.choice(["consumed", "released"])) for at, i, s in made], "id int, scope string, at bigint, outcome string")
    for part, (low, high) in enumerate([(0, 700), (700, 2000), (2000, 2100), (2100, 5001)]):
        df.where((F.col("at") >= low) & (F.col("at") < high)).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    reader = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
    for outcome in (None, "outcome"):
        write = K.admit_batches(str(tmp_path / f"out-{outcome}"), "scope", "at", ["id"], LIMITS, outcome)
        stream = reader.parquet(str(tmp_path / "in")).writeStream.foreachBatch(write)
        stream.option("checkpointLocation", str(tmp_path / f"cp-{outcome}")).trigger(availableNow=True).start().awaitTermination()
        batch = {x.id: x.verdict for x in K.admit(df, "scope", "at", ["id"], LIMITS, outcome).collect()}
        assert {x.id: x.verdict for x in K.read_batches(spark, str(tmp_path / f"out-{outcome}"), "scope", "id int, verdict string").collect()} == batch


def test_a_batch_of_one_file_is_read_once_and_in_parts(spark, tmp_path):
    from tablestory.streaming.stored import Batches

    read, parts = spark.sparkContext.accumulator(0), []

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    batch = spark.range(4000).selectExpr("id % 7 AS k", "id").coalesce(1).mapInArrow(counted, "k bigint, id bigint")

    def rows(b, held):
        parts.append(b.count() and b.rdd.getNumPartitions())
        return b.where(F.col("id") < b.agg(F.max("id")).scalar())

    store = Batches(spark, str(tmp_path / "out"), "k")
    store.write(batch, 0, "k bigint, n bigint", rows, lambda held, made: made.groupBy("k").agg(F.count("id").alias("n")))
    assert read.value == 4000 and parts[0] > 1
    assert store.read("k bigint, id bigint").count() == 3999
    assert store.states.read("k bigint, n bigint").agg(F.sum("n")).first()[0] == 3999


def test_budget_states_meet_the_rows_as_text(spark):
    df = spark.createDataFrame([(1, "a", 10), (2, "b", 10), (3, "c", 10)], "id int, scope string, at bigint")
    states = spark.createDataFrame([("a", None, 0, 0, []), ("b", 5, 1, 0, [5])], f"scope string, {budgets.STATE}")
    out = K.admit(df, "scope", "at", ["id"], {"cadence_ms": 100}, states=states)
    assert "to_json" in out._jdf.queryExecution().analyzed().toString()
    assert {r.id: r.verdict for r in out.collect()} == {1: "ADMITTED", 2: "CADENCE_LIMIT", 3: "ADMITTED"}
