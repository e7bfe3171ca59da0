"""Rounds as a stream: the health machine of sources with its state kept by Structured Streaming."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, fields

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from brightloom.config import DEFAULTS, Settings
from brightloom.operators.health import ROUND, STATE, TIMELINE, Health, advance, alarms, clean_round, timeline


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    health = Health(*state.get) if state.exists else Health()
    health = Health(**{k: None if v is None or v != v else v for k, v in asdict(health).items()})
    # rows of a micro-batch come in no order; a micro-batch holds few rounds of one source
    rows = sorted((r for b in batches for r in b.to_dict("records")), key=lambda r: (r["now"], r["round_id"]))
    out = []
    for row in rows:
        health = advance(health, clean_round(row))
        out.append({"source_id": key[0], "round_id": row["round_id"], **asdict(health)})
    state.update(tuple(getattr(health, f.name) for f in fields(Health)))
    yield pd.DataFrame(out)


def health_stream(rounds: DataFrame) -> DataFrame:
    """The state of every source after each of its rounds, for a streaming table of rounds."""
    schema = f"source_id long, round_id long, {STATE}"
    return rounds.groupBy("source_id").applyInPandasWithState(_step, schema, STATE, "append", GroupStateTimeout.NoTimeout)


NAMES = [f.name for f in fields(Health)]

class HealthTimers(StatefulProcessor):
    """A source's rounds wait until the watermark has passed them, so late ones find their place; then they advance its
    state in order. One timer a source stands at whatever comes next: a waiting round, or an alarm of its state."""

    def __init__(self, expiry: float, s: Settings = DEFAULTS):
        self.expiry, self.s = expiry, s
        # read here, as tasks have no session that could read them
        self.kept = StructType.fromDDL(f"{STATE}, since double, seen double")
        self.round = StructType.fromDDL(f"round_id long, kind string, now double, {ROUND}")
        self.out = StructType.fromDDL(TIMELINE)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.kept)
        self.waiting = handle.getListState("waiting", self.round)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [tuple(r[name] for name in self.round.names) for r in rows]
        self.waiting.appendList(new)
        self._wake(min(r[2] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = timerValues.getCurrentWatermarkInMs() / 1000.0
        rounds = sorted((dict(zip(self.round.names, r, strict=True)) for r in self.waiting.get()), key=lambda r: (r["now"], r["round_id"]))
        ready, later = [r for r in rounds if r["now"] <= until], [r for r in rounds if r["now"] > until]
        h, since, seen = None, float("-inf"), float("-inf")
        if self.held.exists():
            *state, since, seen = self.held.get()
            h = Health(**dict(zip(NAMES, state, strict=True)))
        out, h, since, seen = timeline(h, since, seen, ready, until, self.expiry, self.s)
        self.waiting.clear()
        if later:
            self.waiting.appendList([tuple(r[name] for name in self.round.names) for r in later])
        if h is None:
            self.held.clear()
        else:
            self.held.update((*[getattr(h, name) for name in NAMES], since, seen))
        due = [r["now"] for r in later[:1]] + ([t for t, _ in alarms(h, seen, self.expiry, self.s) if t > since][:1] if h else [])
        if due:
            self._wake(min(due), expiredTimerInfo.getExpiryTimeInMs())
        for row in out:
            yield Row(**{name: {"source_id": key[0], **row}[name] for name in self.out.names})

    def _wake(self, at: float, going_off: int = -1) -> None:
        """Keeps the earliest timer only, beside the one that goes off, which is deleted after that."""
        at_ms, timers = math.ceil(at * 1000), [t for t in self.handle.listTimers() if t != going_off]
        if all(at_ms < t for t in timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at_ms)

    def close(self) -> None:
        pass


def health_timeline_stream(rounds: DataFrame, late: str = "1 hour", expiry_days: float = 30.0) -> DataFrame:
    """The timeline of every source, as operators.health.health_timeline, for a streaming table of rounds.

    Rounds that come up to ``late`` behind the newest one are put in order; later ones are left out, as are rows without
    a time. A dropped source holds no state. The session needs the RocksDB state store provider.
    """
    timed = rounds.where("now IS NOT NULL").withColumn("_at", F.timestamp_micros((F.col("now") * 1_000_000).cast("long"))).withWatermark("_at", late)
    machine = HealthTimers(expiry_days * 86400.0)
    return timed.groupBy("source_id").transformWithState(machine, machine.out, "Append", "EventTime")
