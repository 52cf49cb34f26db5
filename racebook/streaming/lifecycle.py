"""The life of a watched race as a stream of transitions, by timers on event time.

A race is ACTIVE from its first sample. At the deadline it is DONE if no prediction was frozen by then, else it waits
(WAIT_RESULT) until the result arrives (DONE) or the wait is over (TIMEOUT). Without a deadline it ends as TIMEOUT after the
longest tracking time.

A transition is decided once the watermark has passed its time, so the transitions do not depend on how the samples were cut into
micro-batches. The state of a race is five numbers and the phase; the timer stands at the next
time at which anything can happen. A race that has ended stays until nothing that could still arrive may
change it (the end of the wait, or a day after its end without a deadline), then its timer removes it: the state holds the races
that are on, not those that were. Samples of a busy race are combined before they are dealt out by race, one row per
race and Arrow batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from racebook import constants as K
from racebook.operators.joins import salted_join

FACTS = "race_key LONG, deadline LONG, created LONG, snapshot LONG, result LONG, last_seen TIMESTAMP"
STATE = "deadline LONG, created LONG, snapshot LONG, result LONG, phase INT"
MOVES = "race_key LONG, state STRING, at TIMESTAMP"
MINUTE = 60_000_000  # microseconds, as all times below


def machine(wait: int, longest: int, keep: int = 24 * 60) -> tuple[Callable, Callable, Callable]:
    """Rules of a race: (transitions up to a time, time of the next timer, time at which it may be forgotten).

    A race is (deadline, created, snapshot, result, phase). Phases: 0 not yet seen, 1 active, 2 waiting, 3 ended.
    """
    inf = 1 << 62

    def ends(race) -> tuple[int, int]:
        """Times at which an active or waiting race changes, as far as known: (next, last that could matter)."""
        deadline, created, _, result, phase = race
        if deadline is None:
            return created + longest * MINUTE, created + (longest + keep) * MINUTE
        limit = deadline + wait * MINUTE
        if phase < 2:
            return deadline, limit
        return (min(limit, result) if result is not None else limit), limit

    def moves(race, now: int) -> tuple[tuple, list[tuple[str, int]]]:
        deadline, created, snapshot, result, phase = race
        out = []
        if created is None:
            return race, out
        if phase == 0 and created <= now:
            phase = 1
            out.append(("ACTIVE", created))
        if phase == 1:
            due, _ = ends((deadline, created, snapshot, result, phase))
            if due <= now:
                if deadline is None:
                    phase = 3
                    out.append(("TIMEOUT", due))
                elif snapshot is None or snapshot > deadline:
                    phase = 3
                    out.append(("DONE", max(deadline, created)))
                else:
                    phase = 2
                    out.append(("WAIT_RESULT", max(deadline, created)))
        if phase == 2:
            limit = deadline + wait * MINUTE
            if result is not None and result <= min(limit, now):
                phase = 3
                out.append(("DONE", result))
            elif limit <= now:
                phase = 3
                out.append(("TIMEOUT", limit))
        return (deadline, created, snapshot, result, phase), out

    def timer(race) -> int:
        _, created, _, _, phase = race
        if created is None:
            return inf
        if phase == 0:
            return created
        due, last = ends(race)
        return due if phase < 3 else last

    def forgotten(race) -> int:
        return inf if race[1] is None else ends(race)[1]

    return moves, timer, forgotten


def partial_facts(samples: DataFrame, snapshot: str, result: str, wait: int) -> DataFrame:
    """One row per race and Arrow batch: what its samples say about the race. Combining is stateless, so it runs
    before the rows are dealt out."""

    def combine(batches):
        import pandas as pd

        for d in batches:
            d["t"] = d["fetched_at"].astype("datetime64[us]").astype("int64").where(d["fetched_at"].notna())
            matters = d["deadline"].isna() | (d["t"] <= d["deadline"] + wait * MINUTE)
            d["created"] = d["t"].where(matters)
            d["snapshot"] = d["t"].where(matters & (d["combo"] == snapshot))
            d["result"] = d["t"].where(matters & (d["combo"] == result) & (d["t"] >= d["deadline"]))
            out = d.groupby("race_key", sort=False).agg({"deadline": "first", "created": "min", "snapshot": "min", "result": "min", "fetched_at": "max"}).reset_index()
            for c in ("deadline", "created", "snapshot", "result"):
                out[c] = out[c].astype("Int64")
            yield out.rename(columns={"fetched_at": "last_seen"})[["race_key", "deadline", "created", "snapshot", "result", "last_seen"]]
        del pd

    rows = samples.select(F.col("race_key").cast("long"), "combo", "fetched_at", F.unix_micros("deadline").alias("deadline"))
    return rows.filter("race_key IS NOT NULL AND fetched_at IS NOT NULL").mapInPandas(combine, FACTS)


def transitions(samples: DataFrame, watch: DataFrame, snapshot: str, result: str, wait: int = K.RESULT_WAIT_MINUTES, longest: int = K.MAX_TRACK_MINUTES, late: str = "10 minutes") -> DataFrame:
    """race_key, state, at: every transition of the races in ``watch`` (race_key, deadline), a stream in append mode.

    Samples later than ``late`` are left out, as their time has been decided. Samples of races that are not watched
    take no part; a watched race with a null deadline is tracked for the longest time."""
    moves, timer, forgotten = machine(wait, longest)

    def step(key, batches, state):
        import pandas as pd

        now = state.getCurrentWatermarkMs() * 1000
        known = state.exists
        race = state.get if known else (None, None, None, None, 0)
        if not state.hasTimedOut:
            least = lambda a, b: b if a is None else a if b is None else min(a, b)
            for d in batches:
                for deadline, *facts in d[["deadline", "created", "snapshot", "result"]].astype(object).itertuples(index=False):
                    facts = [None if pd.isna(x) else int(x) for x in facts]
                    deadline = None if pd.isna(deadline) else int(deadline)
                    race = (deadline, *[least(a, b) for a, b in zip(race[1:4], facts)], race[4])
        out = []
        if race[1] is not None and (known or now < forgotten(race)):
            race, out = moves(race, now)
            if race[4] == 3 and forgotten(race) <= now:
                if known:
                    state.remove()
            else:
                state.update(race)
                state.setTimeoutTimestamp(max(-(-timer(race) // 1000), state.getCurrentWatermarkMs() + 1))
        elif known:
            state.remove()
        if out:
            yield pd.DataFrame({"race_key": [key[0]] * len(out), "state": [s for s, _ in out], "at": pd.to_datetime([t for _, t in out], unit="us")})

    joined = salted_join(samples, watch.select("race_key", "deadline"), "race_key", "inner", "arrival")
    facts = partial_facts(joined, snapshot, result, wait).withWatermark("last_seen", late)
    return facts.groupBy("race_key").applyInPandasWithState(step, MOVES, STATE, "append", GroupStateTimeout.EventTimeTimeout)
