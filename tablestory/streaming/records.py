"""Stored forecasts: keys, first-write-wins, budgets, and checked points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.ordering import Running, running
from .budgets import STATE as BUDGET_STATE, Budget, admit, after  # noqa: F401  part of the records
from .stored import Batches, KeyedStore


def state_hash(*fields: Column | str) -> Column:
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def idempotency_key(game: Column, event: Column, play: Column, state: Column) -> Column:
    """Length-prefixed parts, so that no two different jobs share a key."""
    parts = [F.trim(game), F.trim(event), F.coalesce(F.nullif(F.trim(play), F.lit("")), F.lit("event")), state]
    return F.concat_ws("|", *[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts])


# --- first write wins --------------------------------------------------------------------------
def put_if_absent(stored: DataFrame, incoming: DataFrame, key: str, order_by: list[str]) -> DataFrame:
    """Stored records, and the first incoming record of every key that is not stored."""
    rest = [c for c in incoming.columns if c != key]
    first = incoming.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order_by)).alias("__row"))
    new = first.select(key, "__row.*").join(stored.select(key), key, "left_anti")
    return stored.unionByName(new, allowMissingColumns=True)


def append_new(path: str, key: str, order_by: list[str]):
    """A ``foreachBatch`` function that adds the first record of every key that the store at ``path`` does not hold.

    It reads the buckets of the batch's keys only; a batch that is played again writes nothing.
    """
    def write(batch: DataFrame, number: int) -> None:
        KeyedStore(batch.sparkSession, path, key).put(batch, number, order_by)

    return write


def read_stored(spark: SparkSession, path: str, key: str, schema, latest: bool = False) -> DataFrame:
    """The rows of a keyed store, or the last version of each bucket."""
    return KeyedStore(spark, path, key).read(schema, latest=latest)


def replay(keys: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Answer from stored records; ``missed`` marks keys without a usable one."""
    usable = records.where("choice is not null and probabilities is not null and confidence is not null")
    joined = keys.join(usable.withColumn("__found", F.lit(True)), key, "left")
    return joined.withColumn("missed", F.col("__found").isNull()).drop("__found")


def list_by_key(records: DataFrame, key: str, value, order_by: list[str], limit: int = 64) -> DataFrame:
    """The first ``limit`` records of one key in time order; a limit below 1 is an error."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    return records.where(F.col(key) == value).orderBy(*order_by).limit(limit)


# --- budgets -------------------------------------------------------------------------------------
def stricter_limits(configurations: DataFrame, scope: str) -> DataFrame:
    """The strictest value of every limit over the configurations of a scope."""
    return configurations.groupBy(scope).agg(
        F.max("cadence_ms").alias("cadence_ms"), F.max("rate_window_ms").alias("rate_window_ms"),
        F.min("max_requests_per_window").alias("max_requests_per_window"), F.min("max_requests").alias("max_requests"),
        F.min("max_spend_cents").alias("max_spend_cents"), F.max("cost_cents").alias("cost_cents"),
    )


def admit_batches(path: str, scope: str, at_ms: str, order_by: list[str], limits: dict | None = None, outcome: str | None = None):
    """``admit`` on a stream, as a ``foreachBatch`` function: the budgets of the scopes go from batch to batch.

    Requests of a later batch are not earlier than those decided. Verdicts are read with ``read_batches``.
    """
    def write(batch: DataFrame, number: int) -> None:
        kind = batch.schema[scope].dataType.simpleString()
        Batches(batch.sparkSession, path, scope).write(
            batch, number, f"`{scope}` {kind}, {BUDGET_STATE}",
            lambda rows, held: admit(rows, scope, at_ms, order_by, limits, outcome, states=held),
            lambda held, rows: after(held, rows, scope, at_ms, limits, outcome))

    return write


def read_batches(spark: SparkSession, path: str, key: str, schema) -> DataFrame:
    """The rows of all finished micro-batches."""
    return Batches(spark, path, key).read(schema)


def settle(reservations: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(scope, requests, spend_cents, active, active_cents): consumed adds to spend, released frees."""
    last = outcomes.groupBy("reservation_id").agg(F.min_by("outcome", "settled_at").alias("outcome"))
    both = reservations.join(last, "reservation_id", "left")
    used, open_ = F.col("outcome") == "consumed", F.col("outcome").isNull()
    return both.groupBy("scope").agg(
        F.count_if(used).alias("requests"), F.sum(F.when(used, F.col("cost_cents")).otherwise(0)).alias("spend_cents"),
        F.count_if(open_).alias("active"), F.sum(F.when(open_, F.col("cost_cents")).otherwise(0)).alias("active_cents"),
    )


# --- points and checks -----------------------------------------------------------------------------
def _unit(c: Column) -> Column:
    return F.coalesce(c.between(0, 1) & ~F.isnan(c), F.lit(False))


def unit_distribution(home: Column, away: Column, tie: Column) -> Column:
    return _unit(home) & _unit(away) & _unit(tie) & F.coalesce(F.abs(home + away + tie - 1) <= 1e-9, F.lit(False))


def records_to_points(records: DataFrame, key: str, moment: str, order_by: list[str]) -> DataFrame:
    """Successful records with a valid distribution as points: seconds from the first one, percent to 2 places."""
    p = F.col("probabilities")
    usable = records.where(
        (F.col("status") == "success") & F.col("choice").isNotNull() & unit_distribution(p["home"], p["away"], p["tie"])
        & _unit(F.col("confidence"))
    )
    begun = running(usable, order_by, {"__first": Running("first", F.col(moment))}, [key])
    seconds = F.timestamp_diff("MICROSECOND", F.col("__first"), F.col(moment)) / 1e6

    def percent(c: Column) -> Column:
        return F.floor(c * 10_000 + 0.5) / 100

    return begun.select(
        key, *[c for c in order_by if c not in (key, moment)], moment,
        F.greatest(F.lit(0), F.floor(seconds + 0.5)).cast("bigint").alias("elapsed_seconds"),
        percent(p["home"]).alias("home_probability"), percent(p["away"]).alias("away_probability"),
        percent(p["tie"]).alias("tie_probability"), "choice", percent(F.col("confidence")).alias("confidence"),
    )


def check_series(points: DataFrame, key: str, ids: list[str], moment: str, elapsed: str, shares: list[str]) -> DataFrame:
    """(rule, broken): order of time, unique ids and totals of 100, for all series at once."""
    before = running(points, [moment, *ids], {
        "__m": Running("last", F.col(moment), before=True), "__e": Running("last", F.col(elapsed), before=True),
    }, [key])
    total = sum((F.col(s) for s in shares[1:]), F.col(shares[0]))
    rules = before.agg(
        F.count_if(F.col(moment) <= F.col("__m")).alias("time_order"),
        F.count_if(F.col(elapsed) <= F.col("__e")).alias("elapsed_order"),
        F.count_if(F.abs(total - 100) > 1e-9).alias("total"),
    )
    copies = points.groupBy(key, *ids).agg((F.count(F.lit(1)) - 1).alias("extra")).agg(
        F.coalesce(F.sum("extra"), F.lit(0)).alias("duplicate_ids")
    )
    each = F.array(*[
        F.struct(F.lit(n).alias("rule"), F.col(n).cast("bigint").alias("broken")) for n in ("time_order", "elapsed_order", "total")
    ])
    rows = rules.select(F.inline(each))
    return rows.unionByName(copies.select(F.lit("duplicate_ids").alias("rule"), F.col("duplicate_ids").alias("broken")))


def validate_records(records: DataFrame) -> DataFrame:
    """Add ``invalid``: the first rule a record breaks, or null."""
    p = F.col("probabilities")
    ok = F.col("status") == "success"
    rules = [
        (F.col("state_hash").rlike("^[a-f0-9]{64}$"), "state hash"),
        (F.length("model").between(1, 256), "model"),
        (F.col("latency_ms") >= 0, "latency"),
        (F.col("requested_at").isNotNull() & F.col("completed_at").isNotNull(), "timestamps"),
        (~(F.col("source") == "live") | (F.col("source_status") == "LIVE"), "live source"),
        (~(F.col("source") == "stale") | (F.col("source_status") == "STALE"), "stale source"),
        (~ok | F.coalesce(F.col("choice").isin("home", "away", "tie"), F.lit(False)), "choice"),
        (~ok | unit_distribution(p["home"], p["away"], p["tie"]), "distribution"),
        (~ok | _unit(F.col("confidence")), "confidence"),
    ]
    invalid = F.lit(None).cast("string")
    for rule, name in reversed(rules):
        invalid = F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)).otherwise(invalid)
    return records.withColumn("invalid", invalid)


def error_class(status: Column, kind: Column | None = None) -> Column:
    """(code, retryable) of a failed call, from its HTTP status or the kind of failure."""
    kind = kind if kind is not None else F.lit(None).cast("string")
    code = (
        F.when(kind == "timeout", "TIMEOUT").when(status.isNotNull(), F.concat(F.lit("PROVIDER_"), status.cast("string")))
        .when(kind == "connection", "CONNECTION").when(kind == "configuration", "CONFIGURATION")
        .when(kind == "malformed", "MALFORMED_RESPONSE").otherwise("PROVIDER_ERROR")
    )
    retry = F.when(kind == "timeout", True).when(status.isNotNull(), (status == 429) | (status >= 500)).otherwise(
        F.coalesce(kind == "connection", F.lit(False))
    )
    return F.struct(code.alias("code"), retry.alias("retryable"))
