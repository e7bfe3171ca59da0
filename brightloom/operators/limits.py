"""Limiters and windows: quotas, retry budgets, cool-downs, throttles, feedback caps, lockouts, reclaimed tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from brightloom.config import DEFAULTS
from brightloom.functions import dates as D


def search_quota(calls: DataFrame, per_minute: int = DEFAULTS.search_quota_minute, per_day: int = DEFAULTS.search_quota_day) -> DataFrame:
    """Adds ``allowed`` to calls (provider, ts, call_id): a minute's limit, then a day's over the calls that passed it.

    Two stacked ranks are exact, for once a day is used up nothing later in it passes.
    """
    order = [F.col("ts"), F.col("call_id")]
    minute = Window.partitionBy("provider", F.date_trunc("minute", "ts")).orderBy(*order)
    rows = calls.withColumn("_m", (F.row_number().over(minute) <= per_minute))
    day = Window.partitionBy("provider", F.to_date("ts"), "_m").orderBy(*order)
    return rows.withColumn("allowed", F.col("_m") & (F.row_number().over(day) <= per_day)).drop("_m")


def retry_budget(attempts: DataFrame, limit: int = DEFAULTS.retry_budget_per_minute, seconds: int = 60) -> DataFrame:
    """Adds (spent, allowed) to attempts (caller, ts, attempt_id): those of the last minute, rejected ones included.

    Rows of equal time count in the order of attempt_id: the range frame is corrected by the peers that come later.
    Time is cut into spans of the window's length; a row is also shown to the span after its own, so that the windows
    of a busy caller are as many tasks as there are spans.
    """
    length = seconds * 1_000_000
    rows = attempts.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    shown = F.explode(F.array(*[F.struct((F.floor(F.col("_us") / length) + i).alias("span"), F.lit(i == 0).alias("own")) for i in (0, 1)]))
    rows = rows.withColumn("_at", shown).withColumn("_span", F.col("_at.span")).withColumn("_own", F.col("_at.own"))
    window = Window.partitionBy("caller", "_span").orderBy("_us").rangeBetween(-length, 0)
    peers = Window.partitionBy("caller", "_span", "_own", "_us").orderBy(F.desc("attempt_id"))
    counted = rows.withColumn("spent", F.count("*").over(window) - (F.row_number().over(peers) - 1)).where("_own")
    return counted.withColumn("allowed", F.col("spent") <= limit).drop("_us", "_at", "_span", "_own")


def platform_cooldown(calls: DataFrame, now: Column, streak: int = DEFAULTS.hot_cooldown_streak, minutes: int = DEFAULTS.hot_cooldown_minutes) -> DataFrame:
    """(platform, cooling): the newest ``streak`` calls exist, all failed, and the newest is under so many minutes old."""
    w = Window.partitionBy("platform").orderBy(F.desc("call_id"))
    last = calls.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= streak)
    state = last.groupBy("platform").agg(F.count("*").alias("n"), F.bool_or("ok").alias("any_ok"), F.max(F.when(F.col("_n") == 1, F.col("ts"))).alias("newest"))
    return state.select("platform", ((F.col("n") == streak) & ~F.col("any_ok") & (F.col("newest") > now - F.expr(f"INTERVAL {minutes} MINUTES"))).alias("cooling"))


def ordered_fold(rows: DataFrame, key: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, dict], tuple[object, dict]], schema: str) -> DataFrame:
    """A recurrence over the rows of each key in order, streamed through sorted partitions: one state in memory.

    ``step(state, row)`` gives the new state and the output row.

    Rows are whole Python values, so that a null beside an id leaves the id as it is; rows of a null key are one key.
    """
    wanted = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                mine = tuple(row[k] for k in key)
                if mine != last:
                    last, state = mine, start()
                state, made = step(state, row)
                out.append(made)
            yield pa.RecordBatch.from_pylist(out, schema=wanted)

    return rows.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)


def throttled(requests: DataFrame, gap_s: float = DEFAULTS.throttle_gap_s, max_wait_s: float = DEFAULTS.throttle_max_wait_s) -> DataFrame:
    """(netloc, request_id, wait, accepted): slots at least ``gap_s`` apart; a wait over the limit is refused and takes
    no slot. ``requests`` has (netloc, at in seconds, request_id)."""

    def step(slot, row):
        target = row["at"] if slot is None else max(slot + gap_s, row["at"])
        ok = target - row["at"] <= max_wait_s
        return (target if ok else slot), {"netloc": row["netloc"], "request_id": row["request_id"], "wait": target - row["at"], "accepted": ok}

    return ordered_fold(requests, ["netloc"], ["at", "request_id"], lambda: None, step, "netloc string, request_id long, wait double, accepted boolean")


def reactions(feedback: DataFrame, zone: str = DEFAULTS.time_zone, daily: int = DEFAULTS.feedback_article_daily) -> DataFrame:
    """(article_id, feedback_id, outcome): counted, already_counted or rate_limited.

    A visitor counts once per article; a local day holds at most ``daily`` counted ones. A refused visitor may come
    again another day, so this is a fold over the article's feedback in order.
    """
    rows = feedback.select("article_id", "feedback_id", "visitor", "ts", D.local_date_key(F.col("ts"), zone).alias("day"))

    def step(state, row):
        seen, day, used = state
        used = used if day == row["day"] else 0
        outcome = "already_counted" if row["visitor"] in seen else "rate_limited" if used >= daily else "counted"
        if outcome == "counted":
            seen.add(row["visitor"])
            used += 1
        return (seen, row["day"], used), {"article_id": row["article_id"], "feedback_id": row["feedback_id"], "outcome": outcome}

    return ordered_fold(rows, ["article_id"], ["ts", "feedback_id"], lambda: (set(), None, 0), step, "article_id long, feedback_id long, outcome string")


def hourly_limited(requests: DataFrame, limit: int = DEFAULTS.feedback_ip_hourly) -> DataFrame:
    """Adds ``allowed`` to requests (ip, ts, request_id): the first ones of each clock hour."""
    w = Window.partitionBy("ip", F.date_trunc("hour", "ts")).orderBy("ts", "request_id")
    return requests.withColumn("allowed", F.row_number().over(w) <= limit)


def login_lockouts(logins: DataFrame, failures: int = DEFAULTS.login_failures, lock_s: int = 900) -> DataFrame:
    """(account, login_id, outcome): ok, failed or locked; so many failures in a row lock the account for a while."""

    def step(state, row):
        bad, until = state
        if row["at"] < until:
            return state, {"account": row["account"], "login_id": row["login_id"], "outcome": "locked"}
        bad = 0 if row["ok"] else bad + 1
        state = (0, row["at"] + lock_s) if bad >= failures else (bad, 0.0)
        return state, {"account": row["account"], "login_id": row["login_id"], "outcome": "ok" if row["ok"] else "failed"}

    return ordered_fold(logins, ["account"], ["at", "login_id"], lambda: (0, 0.0), step, "account string, login_id long, outcome string")


def memory_capped(entries: DataFrame, zone: str = DEFAULTS.time_zone, daily: int = DEFAULTS.feedback_memory_daily) -> DataFrame:
    w = Window.partitionBy("author_id", D.local_date_key(F.col("ts"), zone)).orderBy("ts", "entry_id")
    return entries.withColumn("kept", F.row_number().over(w) <= daily)


def reclaimed(tasks: DataFrame, now: Column, minutes: dict[str, int]) -> DataFrame:
    """RUNNING tasks older than their kind's limit return to PENDING; kinds without a limit stay."""
    limit = F.create_map(*[x for k, v in minutes.items() for x in (F.lit(k), F.lit(v))])[F.col("kind")]
    stale = (F.col("status") == "RUNNING") & (F.unix_timestamp(now) - F.unix_timestamp("updated_at") > limit * 60)
    return tasks.withColumn("status", F.when(F.coalesce(stale, F.lit(False)), "PENDING").otherwise(F.col("status")))


def first_available(candidates: DataFrame, now: Column) -> DataFrame:
    """(call_point, provider): the first candidate in order that is not cooling down."""
    ready = candidates.where(F.col("cooldown_until").isNull() | (F.col("cooldown_until") <= now))
    return ready.groupBy("call_point").agg(F.min_by("provider", "position").alias("provider"))


def valid_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    return sessions.where(F.col("expires_at") > now)


def notice_dedupe(notices: DataFrame, sent: DataFrame, queued: DataFrame, hours: int = DEFAULTS.notify_window_hours) -> DataFrame:
    """Adds ``outcome`` to notices (category, dedupe_key, at): deduped if its key was delivered within the window or
    waits in the queue, else queued. ``sent`` has (category, dedupe_key, sent_at), a row for each delivery."""
    last = sent.groupBy("category", "dedupe_key").agg(F.max("sent_at").alias("_sent"))
    waiting = queued.select("category", "dedupe_key", F.lit(True).alias("_waits")).distinct()
    rows = notices.join(last, ["category", "dedupe_key"], "left").join(waiting, ["category", "dedupe_key"], "left")
    again = F.coalesce((F.unix_timestamp("at") - F.unix_timestamp("_sent")) < hours * 3600, F.lit(False)) | F.coalesce("_waits", F.lit(False))
    return rows.withColumn("outcome", F.when(again, "deduped").otherwise("queued")).drop("_sent", "_waits")


def queue_overflow(queue: DataFrame, cap: int = DEFAULTS.notify_queue_cap) -> DataFrame:
    """Adds ``dropped`` to a queue (account, seq, family, priority): beyond the cap of an account digests go first, then
    large priority numbers, then the newest."""
    w = Window.partitionBy("account").orderBy((F.col("family") == "digest").cast("int"), "priority", "seq")
    return queue.withColumn("dropped", F.row_number().over(w) > cap)


def deliverable(queue: DataFrame, accounts: DataFrame, categories: DataFrame, now: Column, gap_s: int = DEFAULTS.notify_gap_s) -> DataFrame:
    """(account, seq): the first notice of each account that both gaps let through now, in the order of the queue.

    ``accounts`` has (account, last_sent), ``categories`` (category, last_sent, min_interval_s); what was never sent to
    waits for nothing.
    """
    age = lambda c: F.unix_timestamp(now) - F.unix_timestamp(c)
    rows = queue.join(accounts.select("account", F.col("last_sent").alias("_a")), "account", "left").join(categories.select("category", F.col("last_sent").alias("_c"), "min_interval_s"), "category", "left")
    free = F.coalesce(age("_a") >= gap_s, F.lit(True)) & ((F.coalesce("min_interval_s", F.lit(0)) <= 0) | F.coalesce(age("_c") >= F.col("min_interval_s"), F.lit(True)))
    return rows.where(free).groupBy("account").agg(F.min("seq").alias("seq"))


def request_interval(override: Column, default: Column, crawl_delay: Column) -> Column:
    """Seconds between requests to a host: its own setting if it is a number, not below 0, else the default; the host's
    crawl delay if that is longer."""
    base = F.greatest(F.coalesce(override.try_cast("double"), default.cast("double")), F.lit(0.0))
    return F.greatest(base, F.coalesce(crawl_delay.cast("double"), F.lit(0.0)))


def busy_kinds(tasks: DataFrame) -> DataFrame:
    """Kinds of rounds that may not start: one is waiting or running."""
    return tasks.where(F.col("status").isin("RUNNING", "PENDING")).select("kind").distinct()


def due_ticks(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs (job, every_s, last_run) whose interval has passed, or that never ran."""
    return jobs.where(F.col("last_run").isNull() | (F.unix_timestamp(now) - F.unix_timestamp("last_run") >= F.col("every_s")))


def claimed(tasks: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """Tasks (task_id, status, attempts, updated_at, ...) after a worker asked for those in ``wanted`` (task_id): the
    waiting ones run, with one attempt more; what another worker has taken stays as it is. ``won`` marks them."""
    asked = wanted.select("task_id", F.lit(True).alias("_asked")).distinct()
    won = F.coalesce(F.col("_asked") & (F.col("status") == "PENDING"), F.lit(False))
    rows = tasks.join(asked, "task_id", "left").withColumn("won", won)
    return rows.withColumn("status", F.when(F.col("won"), "RUNNING").otherwise(F.col("status"))).withColumn("attempts", F.coalesce("attempts", F.lit(0)) + F.col("won").cast("int")).withColumn("updated_at", F.when(F.col("won"), now).otherwise(F.col("updated_at"))).drop("_asked")


def finished(tasks: DataFrame, results: DataFrame, now: Column, longest: int = 2000) -> DataFrame:
    """Tasks after ``results`` (task_id, result, error): only running ones end; a result that comes late, for a task that
    was taken back or has ended, is refused and changes nothing. ``late`` marks those."""
    told = results.select("task_id", F.col("result").alias("_result"), F.substring("error", 1, longest).alias("_error"))
    rows = tasks.join(told, "task_id", "left")
    ends = F.coalesce(F.col("_result").isNotNull() & (F.col("status") == "RUNNING"), F.lit(False))
    rows = rows.withColumn("late", F.col("_result").isNotNull() & (F.col("status") != "RUNNING")).withColumn("_ends", ends)
    return (
        rows.withColumn("status", F.when(F.col("_ends"), F.col("_result")).otherwise(F.col("status")))
        .withColumn("last_error", F.when(F.col("_ends") & (F.coalesce("_error", F.lit("")) != ""), F.col("_error")).otherwise(F.col("last_error")))
        .withColumn("updated_at", F.when(F.col("_ends"), now).otherwise(F.col("updated_at"))).drop("_result", "_error", "_ends")
    )
