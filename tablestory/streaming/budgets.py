"""Budgets: which requests of a scope are admitted, when every decision depends on those before it.

A scope is cut into ranges of its time order like everything else here. What one range hands to the next
is small: the last admission, what is used, and the admissions that still count against the window. A
range is run from the state it is entered with, all ranges at once, first from a guess; the driver holds
one row per range, strings their results together and runs those again whose guess was wrong. Where an
admission alone fixes the moment from which the next is possible, a range is summed up for every state
it may be entered with, and nothing is run twice. Then all rows are labelled in parallel, range by range.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import fixed
from ..operators.ordering import RANGE, with_ranges
from ..session import pinned

#: A range's summary for all states has at most so many steps; a longer one is run from its state instead.
MOST_STEPS = 4096
STATE = "last bigint, consumed bigint, active bigint, recent array<bigint>"


class Budget:
    """What a scope has used so far. A refused request changes nothing."""

    def __init__(self, limits: dict, used: tuple | None = None):
        self.limits = limits
        self.last, self.consumed, self.active, self.recent = used or (None, 0, 0, [])

    def used(self) -> tuple:
        return self.last, self.consumed, self.active, list(self.recent)

    def verdict(self, at: int) -> str:
        l = self.limits
        if self.last is not None and at - self.last < l["cadence_ms"]:
            return "CADENCE_LIMIT"
        if self.consumed + self.active >= l["max_requests"]:
            return "REQUEST_LIMIT"
        self.recent = [t for t in self.recent if t >= at - l["rate_window_ms"]]
        if len(self.recent) + self.active >= l["max_requests_per_window"]:
            return "RATE_LIMIT"
        if (self.consumed + self.active + 1) * l["cost_cents"] > l["max_spend_cents"]:
            return "SPEND_LIMIT"
        return "ADMITTED"

    def admit(self, at: int, outcome: str | None) -> None:
        self.last = at
        if outcome == "consumed":
            self.consumed += 1
            self.recent.append(at)
        elif outcome != "released":
            self.active += 1

    def decide(self, times: np.ndarray, outcomes) -> np.ndarray:
        """Verdicts of requests in time order; runs of equal verdicts are filled at once."""
        verdicts = np.empty(len(times), dtype=object)
        i = 0
        while i < len(times):
            at = int(times[i])
            verdict = self.verdict(at)
            if verdict == "ADMITTED":
                self.admit(at, outcomes[i])
                verdicts[i] = verdict
                i += 1
                continue
            until = None  # the moment from which the verdict may change
            if verdict == "CADENCE_LIMIT":
                until = self.last + self.limits["cadence_ms"]
            elif verdict == "RATE_LIMIT" and self.recent:
                until = min(self.recent) + self.limits["rate_window_ms"] + 1
            stop = len(times) if until is None else max(i + 1, int(np.searchsorted(times, until, side="left")))
            verdicts[i:stop] = verdict
            i = stop
        return verdicts


def most_admissions(limits: dict) -> int:
    """How many requests may ever be consumed or reserved."""
    paid = limits["max_spend_cents"] // limits["cost_cents"] if limits["cost_cents"] > 0 else limits["max_requests"]
    return max(0, int(min(limits["max_requests"], paid)))


def waits(limits: dict) -> tuple[int, int] | None:
    """The time after a consumed and after a released admission until the next is possible, if nothing else decides.

    That is so if admissions that keep the cadence never fill the window, or if one fills it and no
    consumed one before the last can still be in it.
    """
    cadence, window, most = limits["cadence_ms"], limits["rate_window_ms"], limits["max_requests_per_window"]
    if cadence > 0 and window // cadence < most:
        return cadence, cadence
    if most == 1 and cadence > 0 and window + 1 <= 2 * cadence:
        return max(cadence, window + 1), cadence
    return None


@dataclass
class Steps:
    """For every moment from which a range may admit: the last admission in it, whether that was consumed, and how many were."""

    upto: list[int]
    last: list[int]
    spent: list[bool]
    consumed: list[int]

    @classmethod
    def of(cls, times: np.ndarray, spent: np.ndarray, wait: tuple[int, int]) -> Steps | None:
        """By doubling: the row after the next, the fourth, … of every row that may be the first."""
        n = len(times)
        hop = np.append(np.searchsorted(times, times + np.where(spent, *wait)), n)
        last, count = np.arange(n + 1), np.append(spent, False).astype(np.int64)
        while (hop < n).any():
            on = hop < n
            count = count + np.where(on, count[hop], 0)
            last = np.where(on, last[hop], last)
            hop = hop[hop]
        last, count = last[:n], count[:n]
        end = np.flatnonzero(np.append((last[1:] != last[:-1]) | (count[1:] != count[:-1]), True)) if n else last
        if len(end) > MOST_STEPS:
            return None
        return cls(times[end].tolist(), times[last[end]].tolist(), spent[last[end]].tolist(), count[end].tolist())


@dataclass
class Unit:
    """A range of one scope: its first moment, its summary, and the runs made so far, by the state they began with."""

    number: int
    first_at: int
    steps: Steps | None = None
    runs: dict = field(default_factory=dict)


def _seen(state: tuple, first_at: int, limits: dict) -> tuple:
    """The part of a state that a range beginning at ``first_at`` can tell."""
    last, consumed, active, recent = state
    last = last if last is not None and first_at - last < limits["cadence_ms"] else None
    return last, consumed, active, tuple(t for t in recent if t >= first_at - limits["rate_window_ms"])


def _left(unit: Unit, state: tuple, limits: dict) -> tuple | None:
    """The state after a range, if it follows from what is known of the range."""
    most = most_admissions(limits)
    last, consumed, active, recent = state
    if consumed + active >= most or active >= limits["max_requests_per_window"]:
        return state
    if unit.steps is not None:
        wait = waits(limits)
        ready = max([unit.first_at] + [t + limits["cadence_ms"] for t in (last,) if t is not None] + [t + wait[0] for t in recent[-1:]])
        k = bisect.bisect_left(unit.steps.upto, ready)
        if k == len(unit.steps.upto):
            return state
        if consumed + unit.steps.consumed[k] < most:
            return unit.steps.last[k], consumed + unit.steps.consumed[k], active, (unit.steps.last[k],) * unit.steps.spent[k]
    for began, ended in unit.runs.get((last, active, recent), {}).items():
        if began == consumed:
            return ended
        more = ended[1] - began
        if began + more + ended[2] < most and consumed + more + ended[2] < most:
            return ended[0], consumed + more, ended[2], ended[3]
    return None


def _entered(scopes: dict, limits: dict, run, begun: dict | None = None) -> dict:
    """The state that every range is entered with, by range and scope; ``run`` runs ranges from given states.

    ``begun`` has the states that scopes begin with; others begin with nothing used.
    """
    found, begun = {}, begun or {}
    while True:
        asked: dict = {}
        for scope, units in scopes.items():
            state, sure = begun.get(scope, (None, 0, 0, ())), True
            for unit in units:
                state = _seen(state, unit.first_at, limits)
                if sure:
                    found[unit.number, scope] = state
                after = _left(unit, state, limits)
                if after is None:
                    asked[unit.number, scope] = state
                    guesses = [end for runs in unit.runs.values() for end in runs.values()]
                    after, sure = guesses[-1] if guesses else (None, 0, 0, ()), False
                state = after
        if not asked:
            return found
        known = {(u.number, scope): u for scope, units in scopes.items() for u in units}
        for number, scope, state, ended, steps in run(asked):
            unit = known[number, scope]
            unit.runs.setdefault((state[0], state[2], state[3]), {})[state[1]] = ended
            unit.steps = unit.steps or steps


def _carried(slim: DataFrame, scope: str, at_ms: str, order_by: list[str], limits: dict, states: DataFrame | None) -> DataFrame | None:
    """``(range, scope, state)`` for the scopes in more than one range, at most one row per range."""
    spark = slim.sparkSession
    order = F.struct(at_ms, *order_by)
    held = slim.groupBy(RANGE, scope).agg(F.min(at_ms).alias("first_at"))
    held = pinned(held.withColumn("ranges", F.count("*").over(Window.partitionBy(scope))).where("ranges > 1").drop("ranges"))
    names = held.select(F.col(RANGE).alias("__r"), F.col(scope).alias("__s"))
    here = (F.col(RANGE) == F.col("__r")) & F.col(scope).eqNullSafe(F.col("__s"))
    rows = slim.join(F.broadcast(names), here).select(RANGE, scope, at_ms, order.alias("order"), "outcome")
    if limits["cadence_ms"] > 0:  # of requests at one moment only the first can be admitted
        rows = rows.groupBy(RANGE, scope, at_ms).agg(F.min_by("outcome", "order").alias("outcome"), F.min("order").alias("order"))
    each = F.struct("order", F.col(at_ms).alias("at"), "outcome")
    units = rows.groupBy(RANGE, scope).agg(F.sort_array(F.collect_list(each)).alias("rows"))
    units = pinned(units.select(F.col(RANGE).alias("range"), F.col(scope).alias("scope"), F.col("rows.at").alias("at"), F.col("rows.outcome").alias("outcome")))
    scopes: dict = {}
    settled = waits(limits) is not None and slim.where("outcome IS NULL OR outcome NOT IN ('consumed', 'released')").isEmpty()
    for r in held.orderBy(scope, RANGE).collect():
        scopes.setdefault(r[scope], []).append(Unit(r[RANGE], r.first_at))
    if not scopes:
        return None
    begun: dict = {}
    if states is not None:
        spanning = names.select("__s").distinct()
        for r in states.join(F.broadcast(spanning), F.col(scope).eqNullSafe(F.col("__s")), "left_semi").collect():
            begun[r[scope]] = r.last, r.consumed, r.active, tuple(r.recent)
        settled = settled and not any(x[2] for x in begun.values())
    state = f"struct<{', '.join(x.replace(' ', ':', 1) for x in STATE.split(', '))}>"
    kind = units.schema["scope"].dataType.simpleString()
    asked_schema, ended_schema = f"range int, scope {kind}, state {state}", (
        f"range int, scope {kind}, state {state}, ended {state}, steps struct<upto:array<bigint>,last:array<bigint>,spent:array<boolean>,consumed:array<bigint>>")

    def simulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                times, outcomes = np.asarray(row.at, np.int64), np.asarray(row.outcome, object)
                began = (None if pd.isna(row.last) else int(row.last), int(row.consumed), int(row.active), [int(t) for t in row.recent])
                budget = Budget(limits, (*began[:3], list(began[3])))
                budget.decide(times, outcomes)
                steps = Steps.of(times, outcomes == "consumed", waits(limits)) if settled else None
                made = dict(zip(("last", "consumed", "active", "recent"), began)), dict(zip(("last", "consumed", "active", "recent"), budget.used()))
                yield pd.DataFrame([{"range": row.range, "scope": row.scope, "state": made[0], "ended": made[1], "steps": vars(steps) if steps else None}])

    def run(asked: dict) -> Iterator[tuple]:
        wanted = spark.createDataFrame([(r, s, (*x[:3], list(x[3]))) for (r, s), x in asked.items()], asked_schema)
        wanted = wanted.select(F.col("range").alias("__r"), F.col("scope").alias("__s"), "state.*")
        both = units.join(F.broadcast(wanted), (F.col("range") == F.col("__r")) & F.col("scope").eqNullSafe(F.col("__s"))).drop("__r", "__s")
        for r in both.mapInPandas(simulate, ended_schema).collect():
            plain = [(x.last, x.consumed, x.active, tuple(x.recent)) for x in (r.state, r.ended)]
            yield r.range, r.scope, *plain, Steps(*map(list, r.steps)) if r.steps else None

    found = _entered(scopes, limits, run, begun)
    return spark.createDataFrame([(r, s, (*x[:3], list(x[3]))) for (r, s), x in found.items()], asked_schema)


def admit(
    requests: DataFrame, scope: str, at_ms: str, order_by: list[str], limits: dict | None = None,
    outcome: str | None = None, ranges: int | None = None, states: DataFrame | None = None,
) -> DataFrame:
    """Add ``verdict`` to every request: ADMITTED, or the limit that refused it.

    ``outcome`` names a column with consumed/released for admitted requests; others stay reserved and
    count for ever. ``at_ms`` has no nulls; a null scope is one like others. A scope of any size is read by
    many tasks: its rows in ``ranges`` of (scope, time), twice a partition by default. If the cadence does
    not bring two ranges' admissions together and the window decides, a scope needs as many short jobs as
    it has ranges; otherwise two or three. ``states`` (scope and the columns of ``STATE``) is what scopes have used before.
    """
    limits = {**fixed.FORECAST_LIMITS, **(limits or {})}
    ranged = with_ranges(requests, [scope, at_ms, *order_by], ranges)
    ended = F.col(outcome) if outcome else F.lit(None).cast("string")
    slim = ranged.select(RANGE, scope, F.col(at_ms).cast("bigint").alias(at_ms), *order_by, ended.alias("outcome"))
    slim = slim.select(*dict.fromkeys(slim.columns))
    entered = _carried(slim, scope, at_ms, order_by, limits, states)
    if entered is None:
        rows = ranged.withColumn("__state", F.lit(None).cast("string"))
    else:
        here = (F.col(RANGE) == F.col("__r")) & F.col(scope).eqNullSafe(F.col("__s"))
        entered = entered.select(F.col("range").alias("__r"), F.col("scope").alias("__s"), F.to_json("state").alias("__state"))  # as text: it meets every row, and is read once a run of rows
        rows = ranged.join(F.broadcast(entered), here, "left").drop("__r", "__s")
    if states is not None:
        before = states.select(F.col(scope).alias("__b"), F.to_json(F.struct("last", "consumed", "active", "recent")).alias("__begun"))
        rows = rows.join(before, F.col(scope).eqNullSafe(F.col("__b")), "left").withColumn("__state", F.coalesce("__state", "__begun")).drop("__b", "__begun")
    own = requests.columns

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, budget = None, None
        for pdf in batches:
            verdicts = np.empty(len(pdf), dtype=object)
            numbers, scopes = pdf[RANGE].to_numpy(), pdf[scope].to_numpy()
            new = (numbers[1:] != numbers[:-1]) | (scopes[1:] != scopes[:-1])
            starts = np.flatnonzero(np.append(len(pdf) > 0, new)).tolist()
            times, ends = pdf[at_ms].to_numpy(), pdf[outcome].to_numpy() if outcome else np.full(len(pdf), None)
            for a, b in zip(starts, [*starts[1:], len(pdf)]):
                if current != (numbers[a], scopes[a]):
                    current, state = (numbers[a], scopes[a]), pdf["__state"].iloc[a]
                    state = None if pd.isna(state) else json.loads(state)
                    budget = Budget(limits, state and (state.get("last"), state["consumed"], state["active"], state["recent"]))
                verdicts[a:b] = budget.decide(times[a:b], ends[a:b])
            yield pdf[own].assign(verdict=verdicts)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields) + ", verdict string"
    return rows.repartition(RANGE).sortWithinPartitions(RANGE, scope, at_ms, *order_by).mapInPandas(label, schema)


def after(states: DataFrame, verdicts: DataFrame, scope: str, at_ms: str, limits: dict | None = None, outcome: str | None = None) -> DataFrame:
    """The states of all scopes of ``states`` or ``verdicts`` after these verdicts: scope and the columns of ``STATE``."""
    limits = {**fixed.FORECAST_LIMITS, **(limits or {})}
    spent = F.col(outcome) == "consumed" if outcome else F.lit(False)
    open_ = F.coalesce(~F.col(outcome).isin("consumed", "released"), F.lit(True)) if outcome else F.lit(True)
    times = F.col(at_ms).cast("bigint")
    keep = max(1, min(limits["max_requests_per_window"], most_admissions(limits)))  # no more than these can fill the window
    admitted = verdicts.where("verdict = 'ADMITTED'").groupBy(scope).agg(
        F.max(times).alias("last"), F.count_if(spent).alias("consumed"), F.count_if(open_).alias("active"),
        F.collect_list(F.when(spent, times)).alias("recent"))  # consumed admissions, of which the limits allow few
    both = states.select(scope, "last", "consumed", "active", "recent").unionByName(admitted)
    recent = F.sort_array(F.slice(F.sort_array(F.flatten(F.collect_list("recent")), False), 1, keep))
    return both.groupBy(scope).agg(
        F.max("last").alias("last"), F.sum("consumed").alias("consumed"), F.sum("active").alias("active"), recent.alias("recent"))
