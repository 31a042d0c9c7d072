"""Live state feeds: read, deduplicate, keep the newest state, flag what is stale.

Every stream operator has a batch form that gives the same answer on stored data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..operators.ordering import Running, row_index, running
from .stored import Batches, KeyedStore

LATENESS = "10 minutes"

FEED_SCHEMA = """
id string, date string,
status struct<period:int, displayClock:string, type:struct<state:string, detail:string, shortDetail:string>>,
competitors array<struct<homeAway:string, id:string, score:string,
    team:struct<id:string, displayName:string, abbreviation:string, name:string>>>,
situation struct<possession:string, down:int, distance:double, possessionText:string>,
lastPlay struct<id:string, sequenceNumber:string, text:string, date:string>
"""

STATE_FIELDS = (
    "id", "event_id", "play_id", "sequence_number", "home_team", "away_team", "home_score", "away_score", "quarter",
    "clock", "status", "possession", "down", "distance", "field_position", "last_play", "timestamp", "feed_timestamp",
    "source_status",
)


def normalize_state(df: DataFrame, json: str) -> DataFrame:
    """Flatten a nested feed record; ``reject`` says why a record cannot be used."""
    fed = df.withColumn("__feed", F.from_json(json, FEED_SCHEMA))
    feed = F.col("__feed")

    def side(name: str) -> Column:
        return F.try_element_at(F.filter(feed["competitors"], lambda c: c["homeAway"] == name), F.lit(1))

    def team(c: Column) -> Column:
        return F.coalesce(c["team"]["displayName"], c["team"]["abbreviation"], c["team"]["name"])

    home, away = side("home"), side("away")
    state, play, now = feed["status"], feed["lastPlay"], feed["situation"]
    detail = F.lower(F.concat_ws(" ", state["type"]["detail"], state["type"]["shortDetail"]))
    stamps = [F.try_to_timestamp(c) for c in (play["date"], feed["date"])]
    moment = F.coalesce(*stamps).cast("timestamp_ntz")
    flat = {
        "id": feed["id"], "event_id": feed["id"], "play_id": play["id"],
        "sequence_number": play["sequenceNumber"].try_cast("bigint"),
        "home_team": team(home), "away_team": team(away),
        "home_score": home["score"].try_cast("int"), "away_score": away["score"].try_cast("int"),
        "quarter": F.when(state["period"].isNotNull(), F.concat(F.lit("Q"), state["period"].cast("string"))).otherwise(""),
        "clock": F.coalesce(state["displayClock"], state["type"]["shortDetail"], F.lit("")),
        "status": F.when(state["type"]["state"].isin("post", "final"), "final")
        .when((state["type"]["state"] == "halftime") | detail.contains("halftime"), "halftime").otherwise("quarter"),
        "possession": F.when(now["possession"] == F.coalesce(home["team"]["id"], home["id"]), "home")
        .when(now["possession"] == F.coalesce(away["team"]["id"], away["id"]), "away"),
        "down": now["down"], "distance": now["distance"], "field_position": now["possessionText"],
        "last_play": F.coalesce(play["text"], F.lit("")), "timestamp": moment, "feed_timestamp": moment,
        "source_status": F.lit("LIVE"),
    }
    flattened = fed.select(*[c for c in df.columns if c not in flat], *[c.alias(n) for n, c in flat.items()])
    reject = (
        F.when(F.col("id").isNull() | (F.trim("id") == ""), "no id")
        .when(F.col("home_team").isNull() | F.col("away_team").isNull(), "no team")
        .when(F.col("home_score").isNull() | F.col("away_score").isNull(), "no score")
        .when(F.col("timestamp").isNull(), "no time")
    )
    return flattened.withColumn("reject", reject)


def pick_entity(df: DataFrame, key: str, state: Column, order_by: list[str], preferred: str | None = None) -> DataFrame:
    """(key): the preferred entity, or the first live one in feed order."""
    wanted = F.col(key).cast("string") == preferred if preferred else state.isin("in", "halftime")
    return df.where(wanted).agg(F.min_by(key, F.struct(*order_by)).alias(key)).where(F.col(key).isNotNull())


# --- one record per id -----------------------------------------------------------------------
def dedupe_events(df: DataFrame, key: str, arrival: list[str], order_by: list[str]) -> DataFrame:
    """The last record of every id, in sequence order."""
    rest = [c for c in df.columns if c != key]
    last = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*arrival)).alias("__row"))
    return last.select(key, "__row.*").orderBy(*order_by)


def dedupe_stream(events: DataFrame, key: str, time: str, lateness: str = LATENESS) -> DataFrame:
    """One record per id on a stream; state is kept for as long as copies may be late."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


# --- newest state ------------------------------------------------------------------------------
def flag_versions(df: DataFrame, key: str, version: str, arrival: list[str]) -> DataFrame:
    """Add ``verdict``: LIVE when newer than everything of its key before it, SAME, or STALE when older.

    The newest accepted version before a row is the running maximum of all
    versions in arrival order.
    """
    seen = running(df, arrival, {"newest_before": Running("max", F.col(version), before=True)}, [key])
    verdict = (
        F.when(F.col("newest_before").isNull() | (F.col(version) > F.col("newest_before")), "LIVE")
        .when(F.col(version) == F.col("newest_before"), "SAME").otherwise("STALE")
    )
    return seen.withColumn("verdict", verdict)


def latest_state(df: DataFrame, key: str, version: str, arrival: list[str]) -> DataFrame:
    """The newest state of every key; of equal versions the one that came first."""
    rest = [c for c in df.columns if c != key]
    # Of the largest version the first arrival: the version is found first, so that arrivals of any type are compared as they are.
    arrivals = F.struct(*[F.col(a).alias(f"__a{i}") for i, a in enumerate(arrival)])
    first = df.groupBy(key, version).agg(F.min_by(F.struct(*[c for c in rest if c != version]), arrivals).alias("__row"))
    newest = first.groupBy(key).agg(F.max(F.col(version)).alias(version), F.max_by("__row", F.col(version)).alias("__row"))
    return newest.select(key, version, "__row.*").select(key, *rest)


def flag_versions_batches(path: str, key: str, version: str, arrival: list[str]):
    """``flag_versions`` on a stream, as a ``foreachBatch`` function: the newest version of each key goes from batch to batch.

    Rows of a batch arrive after those of the batches before. Verdicts are read with ``records.read_batches``.
    """
    def write(batch: DataFrame, number: int) -> None:
        kinds = {f.name: f.dataType for f in batch.schema.fields}

        def flag(rows: DataFrame, held: DataFrame) -> DataFrame:
            known = held.select(*[F.col(c) if c in (key, version) else F.lit(None).cast(kinds[c]).alias(c) for c in rows.columns], F.lit(0).alias("__turn"))
            known = known.join(rows.select(key).distinct(), key, "left_semi")
            both = known.unionByName(rows.withColumn("__turn", F.lit(1)))
            order = ["__turn", *[f"__o{i}" for i in range(len(arrival))]]
            # A state has no place in the arrival order; ranges are cut where all order columns have values.
            both = both.withColumns({f"__o{i}": F.coalesce(F.col(c), F.lit(0).cast(kinds[c])) for i, c in enumerate(arrival)})
            return flag_versions(both, key, version, order).where("__turn = 1").select(*rows.columns, "verdict")

        Batches(batch.sparkSession, path, key).write(
            batch, number, ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in (key, version)), flag,
            lambda held, rows: held.unionByName(rows.select(key, version)).groupBy(key).agg(F.max(version).alias(version)))

    return write


def staleness(df: DataFrame, moment: str, now: Column, limit_seconds: int = fixed.STALE_AFTER_SECONDS) -> DataFrame:
    """Add (age_seconds, source_status): STALE when older than the limit."""
    age = F.timestamp_diff("MICROSECOND", F.col(moment), now) / 1e6
    return df.withColumn("age_seconds", age).withColumn(
        "source_status", F.when(F.col("age_seconds") > limit_seconds, "STALE").otherwise("LIVE")
    )


def state_at(states: DataFrame, index: int, order_by: list[str]) -> DataFrame:
    """The state at a position of a stored series, clamped to its ends."""
    last = states.agg(F.count(F.lit(1)) - 1).scalar()
    numbered = row_index(states, order_by, "__place")
    return numbered.where(F.col("__place") == F.greatest(F.lit(0), F.least(F.lit(index), last))).drop("__place")


def trend_batches(path: str, time: str, width: str, measure: str | None = None):
    """Counts (and a total) per time step on a stream, as a ``foreachBatch`` function: a store with one row per bucket.

    A batch is counted by itself and added to the buckets it touches, and only their files are written anew;
    open steps are there at once, late rows add to theirs, and no state is kept in memory. Rows without a
    time are in none. Read with ``records.read_stored(..., latest=True)``.
    """
    def write(batch: DataFrame, number: int) -> None:
        aggregates = [F.count(F.lit(1)).alias("rows")] + ([F.sum(measure).alias("total")] if measure else [])
        stepped = batch.withColumn(time, F.col(time).cast("timestamp")).groupBy(F.window(time, width)).agg(*aggregates)
        steps = stepped.select(F.col("window.start").alias("bucket"), *[c for c in stepped.columns if c != "window"]).where("bucket IS NOT NULL")
        added = [F.sum(c).alias(c) for c in steps.columns if c != "bucket"]
        KeyedStore(batch.sparkSession, path, "bucket").replace(
            steps, number, lambda held, rows: held.unionByName(rows).groupBy("bucket").agg(*added))

    return write


def late_batches(path: str, time: str, lateness: str = LATENESS):
    """A ``foreachBatch`` function that keeps the rows which are behind the watermark when they arrive.

    The watermark of a batch is the largest time of all batches before it less ``lateness``. Rows are read
    with ``records.read_batches`` by the key ``__all``; those that are not late are not kept.
    """
    def write(batch: DataFrame, number: int) -> None:
        moment = F.col(time)

        def late(rows: DataFrame, held: DataFrame) -> DataFrame:
            seen = held.agg(F.max("seen")).scalar()
            return rows.drop("__all").where(moment < seen - F.expr(f"INTERVAL {lateness}"))

        top = batch.agg(F.lit(0).alias("__all"), F.max(time).cast("timestamp_ntz").alias("seen"))
        Batches(batch.sparkSession, path, "__all", 1).write(
            batch.withColumn("__all", F.lit(0)), number, "__all int, seen timestamp_ntz", late,
            lambda held, _: held.unionByName(top).groupBy("__all").agg(F.max("seen").alias("seen")))

    return write
