"""Health of sources: skip decisions, planning of a fetch round, and the state machine advanced once per round.

The machine is one pure function of (state, round). A batch of rounds streams through it in sorted partitions, with
the state of one source in memory; brightloom.streaming.rounds uses the same function on micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from brightloom.config import DEFAULTS, Settings


def rate_limit_minutes(level: Column, s: Settings = DEFAULTS) -> Column:
    """base * 2^level, at most the maximum."""
    return F.least(F.lit(float(s.rate_limit_base_minutes)) * F.pow(F.lit(2.0), F.greatest(F.coalesce(level, F.lit(0)), F.lit(0))), F.lit(float(s.rate_limit_max_minutes))).cast("int")


def effective_interval_minutes(base: Column, zero_gain_level: Column, s: Settings = DEFAULTS) -> Column:
    level = F.least(F.greatest(F.coalesce(zero_gain_level, F.lit(0)), F.lit(0)), F.lit(s.zero_gain_max_level))
    return (base * F.pow(F.lit(2.0), level)).cast("int")


def probe_due(skips: Column, s: Settings = DEFAULTS) -> Column:
    return F.coalesce(skips, F.lit(0)) % s.backoff_probe_every == 0


def _days(n: int) -> Column:
    return F.expr(f"INTERVAL {n} DAYS")


def dead_probe_due(now: Column, s: Settings = DEFAULTS) -> Column:
    """A dead source may be probed if it has been dead, and was last probed, for the whole window; unknown age: never."""
    window = _days(s.hard_fail_probe_days)
    due = (F.col("failure_level") == "hard_failed") & (now - window >= F.col("failure_since")) & (F.col("last_probe_at").isNull() | (now - window >= F.col("last_probe_at")))
    return F.coalesce(due, F.lit(False))


def stale_dead(now: Column, days: int = DEFAULTS.sentinel_stale_days) -> Column:
    return F.coalesce((F.col("failure_level") == "hard_failed") & (now - _days(days) > F.col("failure_since")), F.lit(False))


def skip_reason(now: Column, s: Settings = DEFAULTS) -> Column:
    """Why a source is skipped this round, by priority; ``probe`` lets it through as a probe, null runs it."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    probe = probe_due(F.col("backoff_skips"), s)
    wait = effective_interval_minutes(F.col("interval_minutes"), F.col("zero_gain_level"), s) * 60
    since = (F.unix_micros(now) - F.unix_micros("last_fetched_at")) / F.lit(1_000_000)
    return (
        F.when(~F.coalesce("enabled", F.lit(False)), "disabled")
        .when(F.col("direction_status") == "expired", "direction_expired")
        .when(F.col("rate_limited_until") > now, "rate_limited")
        .when(F.col("keyword_limited_until") > now, "keyword_exhausted")
        .when(F.col("failure_level") == "hard_failed", "hard_failed")
        .when(F.col("failure_level") == "suspect", F.when(probe, "probe").otherwise("suspect_probe"))
        .when(zero("backoff_failures") >= s.backoff_fail_threshold, F.when(probe, "probe").otherwise("backoff"))
        .when((zero("interval_minutes") > 0) & (since < wait), "interval_not_due")
    )


def plan_round(sources: DataFrame, now: Column, s: Settings = DEFAULTS) -> DataFrame:
    """Adds (reason, fetch, backoff_skips and last_probe_at as they are afterwards) to the sources of a round.

    Of the dead sources that are due, those probed or dead longest go first, up to the quota; ties by id.
    """
    due = sources.where(dead_probe_due(now, s)).orderBy(F.coalesce("last_probe_at", "failure_since"), "source_id").limit(s.hard_fail_probe_quota)
    marked = sources.join(F.broadcast(due.select("source_id", F.lit(True).alias("_probe"))), "source_id", "left")
    reason = F.when(F.col("_probe"), "dead_probe").otherwise(skip_reason(now, s))
    counted = F.col("reason").isin("probe", "backoff", "suspect_probe")
    shown = F.when(F.col("reason") == "interval_not_due", F.concat(F.lit("interval_not_due:"), effective_interval_minutes(F.col("interval_minutes"), F.col("zero_gain_level"), s).cast("string"), F.lit("m"))).otherwise(F.col("reason"))
    return (
        marked.withColumn("reason", reason)
        .withColumn("fetch", F.col("reason").isNull() | F.col("reason").isin("probe", "dead_probe"))
        .withColumn("backoff_skips", F.coalesce("backoff_skips", F.lit(0)) + F.coalesce(counted, F.lit(False)).cast("int"))
        .withColumn("last_probe_at", F.when(F.col("reason") == "dead_probe", now).otherwise(F.col("last_probe_at")))
        .withColumn("reason", shown)
        .drop("_probe")
    )


def reset_keyword_backoff(sources: DataFrame) -> DataFrame:
    """Clears the keyword limits of search sources; ``changed`` marks the rows that had any."""
    had = (F.col("type") == "search") & ((F.coalesce("keyword_zero_rounds", F.lit(0)) > 0) | (F.coalesce("keyword_rate_level", F.lit(0)) > 0) | F.col("keyword_limited_until").isNotNull())
    rows = sources.withColumn("changed", F.coalesce(had, F.lit(False)))
    for c, value in (("keyword_zero_rounds", F.lit(0)), ("keyword_rate_level", F.lit(0)), ("keyword_limited_until", F.lit(None))):
        rows = rows.withColumn(c, F.when(F.col("changed"), value).otherwise(F.col(c)))
    return rows


@dataclass
class Health:
    """State of one source; times are seconds since the epoch."""

    failure_level: str = "none"
    failure_since: float | None = None
    last_probe_at: float | None = None
    empty_rounds: int = 0
    hard_failures: int = 0
    backoff_failures: int = 0
    backoff_skips: int = 0
    rate_level: int = 0
    rate_ok_rounds: int = 0
    rate_limited_until: float | None = None
    keyword_zero_rounds: int = 0
    keyword_rate_level: int = 0
    keyword_limited_until: float | None = None
    zero_gain_rounds: int = 0
    zero_gain_level: int = 0
    event: str | None = None


#: Fields of a round beside source_id, kind ("rss", "web" or "search") and now (seconds).
ROUND = "error string, http_status int, feed_entries int, inserted int, not_modified boolean, rate_limited boolean, retry_after double, skip_day boolean, quota_blocked boolean"
STATE = (
    "failure_level string, failure_since double, last_probe_at double, empty_rounds int, hard_failures int, backoff_failures int, backoff_skips int, rate_level int, rate_ok_rounds int, "
    "rate_limited_until double, keyword_zero_rounds int, keyword_rate_level int, keyword_limited_until double, zero_gain_rounds int, zero_gain_level int, event string"
)


def _ladder(level: int, s: Settings) -> float:
    return 60.0 * min(s.rate_limit_base_minutes * 2 ** max(level, 0), s.rate_limit_max_minutes)


def advance(h: Health, r: dict, s: Settings = DEFAULTS) -> Health:
    """The state after a round. ``event`` tells a change that is worth a notice: suspect, hard_failed or recovered."""
    h.event = None
    error, now, entries, gained = r["error"] or None, r["now"], r["feed_entries"] or 0, r["inserted"] or 0
    kind, unchanged, limited = r["kind"], bool(r["not_modified"]), bool(r["rate_limited"])
    not_xml = bool(error) and error.startswith("non_xml_response")
    calm = error is None and not limited

    alive = unchanged or (error is None and entries > 0)
    silent = not_xml or (error is None and entries == 0 and kind == "rss")
    if alive:
        h.empty_rounds = h.hard_failures = 0
        if h.failure_level != "none":
            h.event = "recovered" if h.failure_level == "hard_failed" else None
            h.failure_level, h.failure_since, h.last_probe_at = "none", None, None
    elif silent and not r["skip_day"]:
        h.empty_rounds += 1
        if h.empty_rounds >= s.suspect_empty_rounds and h.failure_level == "none":
            h.failure_level, h.failure_since, h.event = "suspect", now, "suspect"

    if error is not None and not not_xml:
        gone = r["http_status"] in (404, 403, 410)
        h.hard_failures = h.hard_failures + 1 if gone else 0
        if gone and h.hard_failures >= s.hard_fail_rounds and h.failure_level != "hard_failed":
            h.failure_level, h.failure_since, h.event = "hard_failed", now, "hard_failed"

    if limited:
        h.rate_level, h.rate_ok_rounds = h.rate_level + 1, 0
        wait = r["retry_after"]
        h.rate_limited_until = now + (_ladder(h.rate_level, s) if wait is None else wait)
    elif error is None and h.rate_limited_until is not None and now >= h.rate_limited_until:
        h.rate_ok_rounds += 1
        if h.rate_ok_rounds >= 2:
            h.rate_level, h.rate_ok_rounds = max(0, h.rate_level - 1), 0
            h.rate_limited_until = now + _ladder(h.rate_level, s) if h.rate_level else None

    if error is not None and not not_xml and not limited:
        h.backoff_failures += 1
    elif calm and not (h.failure_level == "suspect" and entries == 0):
        h.backoff_failures = h.backoff_skips = 0

    if kind == "search" and calm and not r["quota_blocked"]:
        if gained:
            h.keyword_zero_rounds, h.keyword_rate_level, h.keyword_limited_until = 0, 0, None
        else:
            h.keyword_zero_rounds += 1
            over = h.keyword_zero_rounds - s.keyword_exhausted_rounds
            if over >= 0:
                h.keyword_rate_level = over + 1
                h.keyword_limited_until = now + _ladder(h.keyword_rate_level, s)
    elif kind != "search" and calm and not unchanged:
        if gained > 0:
            h.zero_gain_rounds = h.zero_gain_level = 0
        elif gained == 0:
            h.zero_gain_rounds += 1
            if h.zero_gain_rounds >= s.zero_gain_rounds:
                h.zero_gain_rounds, h.zero_gain_level = 0, min(h.zero_gain_level + 1, s.zero_gain_max_level)
    return h


def clean_round(row: dict) -> dict:
    """Missing values of a row as None."""
    return {k: None if v is None or v != v else v for k, v in row.items()}


def health_after(rounds: DataFrame, every: bool = False, s: Settings = DEFAULTS) -> DataFrame:
    """State of every source after its last round, or after each one. Rounds are ordered by (now, round_id)."""

    schema = f"source_id long, round_id long, {STATE}"
    wanted = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, state, last = object(), None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["source_id"] != source:
                    if last is not None and not every:
                        out.append(last)
                    source, state = row["source_id"], Health()
                state = advance(state, clean_round(row), s)
                last = {"source_id": source, "round_id": row["round_id"], **asdict(state)}
                if every:
                    out.append(last)
            yield pa.RecordBatch.from_pylist(out, schema=wanted)
        if last is not None and not every:
            yield pa.RecordBatch.from_pylist([last], schema=wanted)

    order = ["source_id", "now", "round_id"]
    return rounds.repartition("source_id").sortWithinPartitions(*order).mapInArrow(run, schema)


#: A row of a timeline: a round of a source (round_id is set) or an alarm (notice is set), with the state after it.
TIMELINE = f"source_id long, at double, round_id long, notice string, {STATE}"


def alarms(h: Health, seen: float, expiry: float, s: Settings = DEFAULTS) -> list[tuple[float, str]]:
    """(time, notice) of what comes due by itself after a source's last round at ``seen``: the ends of its limits, the
    probe of a dead source, and that it counts as dropped after ``expiry`` seconds without a round."""
    due = [(seen + expiry, "dropped"), (h.rate_limited_until, "rate_limit_over"), (h.keyword_limited_until, "keyword_limit_over")]
    if h.failure_level == "hard_failed" and h.failure_since is not None:
        due.append((max(h.failure_since, h.last_probe_at or h.failure_since) + 86400.0 * s.hard_fail_probe_days, "probe_due"))
    return sorted((t, name) for t, name in due if t is not None)


def timeline(h: Health | None, since: float, seen: float, rounds: list[dict], until: float, expiry: float, s: Settings = DEFAULTS) -> tuple[list[dict], Health | None, float, float]:
    """(rows, state, since, seen) after a source's rounds, in order, and its alarms up to the time ``until``.

    Alarms up to ``since`` have been told. One that is due when a round begins comes before it. A dropped source has no
    state (None); its next round begins anew.
    """
    out: list[dict] = []
    for r in [*rounds, None]:
        end = until if r is None else r["now"]
        for t, name in alarms(h, seen, expiry, s) if h is not None else ():
            if since < t <= end and h is not None:
                out.append({"at": t, "round_id": None, "notice": name, **asdict(h)})
                h = None if name == "dropped" else h
        since = max(since, end)
        if r is not None:
            h, seen = advance(Health() if h is None else h, r, s), end
            out.append({"at": end, "round_id": r["round_id"], "notice": None, **asdict(h)})
    return out, h, since, seen


def health_timeline(rounds: DataFrame, until: float, expiry_days: float = 30.0, s: Settings = DEFAULTS) -> DataFrame:
    """All rounds (up to ``until``) with the state after each, and the alarms between and after them.

    Rounds are ordered by (now, round_id). A partition is read in order, a round of a source at a time, so what is held
    does not grow with a source's rounds. Rows without a time take no part.
    """
    wanted = to_arrow_schema(StructType.fromDDL(TIMELINE))
    expiry = expiry_days * 86400.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, held = object(), None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["source_id"] != source:
                    if held:
                        out += [{"source_id": source, **x} for x in timeline(*held, [], until, expiry, s)[0]]
                    source, held = row["source_id"], (None, float("-inf"), float("-inf"))
                rows, *held = timeline(*held, [clean_round(row)], row["now"], expiry, s)
                out += [{"source_id": source, **x} for x in rows]
            yield pa.RecordBatch.from_pylist(out, schema=wanted)
        if held:
            yield pa.RecordBatch.from_pylist([{"source_id": source, **x} for x in timeline(*held, [], until, expiry, s)[0]], schema=wanted)

    known = rounds.where(F.col("now").isNotNull() & (F.col("now") <= until))
    return known.repartition("source_id").sortWithinPartitions("source_id", "now", "round_id").mapInArrow(run, TIMELINE)
