"""Ledgers and dashboards: usage, call logs, budgets, reconciliation, health payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.config import DEFAULTS
from brightloom.functions import dates as D
from brightloom.operators.evaluation import preceding


def usage_summary(usage: DataFrame) -> DataFrame:
    """Calls, sums and mean latency by call point and model."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return usage.groupBy("call_point", "model").agg(
        F.count("*").alias("calls"), total("prompt_tokens"), total("completion_tokens"), total("billing_units"), F.count_if("ok").alias("ok_calls"), F.avg("latency_ms").alias("avg_latency_ms")
    )


def daily_calls(calls: DataFrame, since: Column, zone: str = DEFAULTS.time_zone) -> DataFrame:
    """Calls by provider and local day: all, ok, failed, blocked by quota, mean latency."""
    rows = calls.where(F.col("created_at") >= since).withColumn("day", D.local_date_key(F.col("created_at"), zone))
    return rows.groupBy("provider", "day").agg(
        F.count("*").alias("calls"), F.count_if("ok").alias("ok_calls"), F.count_if(~F.col("ok")).alias("failed_calls"), F.count_if(F.col("status") == "blocked").alias("quota_blocked"), F.avg("latency_ms").alias("avg_latency_ms")
    )


def rank_calls(calls: DataFrame, since: Column) -> DataFrame:
    return calls.where(F.col("created_at") >= since).groupBy("provider").agg(
        F.count("*").alias("calls"), F.count_if("ok").alias("ok_calls"), F.count_if(~F.col("ok")).alias("failed_calls"), F.count_if(F.col("status") == "blocked").alias("quota_blocked"),
        F.coalesce(F.sum("candidate_count"), F.lit(0)).alias("candidates_total"), F.avg("latency_ms").alias("avg_latency_ms"),
    )


def tokens_by_author(usage: DataFrame, since: Column) -> DataFrame:
    """(author_id, call_points): a map from call point to calls and tokens."""
    rows = usage.where((F.col("ref_type") == "author") & F.col("ref_id").isNotNull() & (F.col("created_at") >= since))
    sums = rows.groupBy(F.col("ref_id").alias("author_id"), "call_point").agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    return sums.groupBy("author_id").agg(F.map_from_entries(F.collect_list(F.struct("call_point", F.struct("calls", "prompt_tokens", "completion_tokens")))).alias("call_points"))


def stage_rates(tasks: DataFrame, since: Column) -> DataFrame:
    """Totals, failures and success rate of each kind of task in the window; no rate without tasks."""
    return tasks.where(F.col("updated_at") >= since).groupBy("kind").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.count_if(F.col("status") == "SKIP").alias("skipped"),
        F.try_divide(F.count_if(F.col("status") == "DONE").cast("double"), F.count("*").cast("double")).alias("success_rate"),
    )


def provider_status(usage: DataFrame, now: Column) -> DataFrame:
    """Calls, errors, error rate and the newest error of each provider within 24 hours."""
    rows = usage.where(F.col("created_at") >= now - F.expr("INTERVAL 24 HOURS"))
    bad = ~F.col("ok")
    return rows.groupBy("provider").agg(
        F.count("*").alias("total"), F.count_if(bad).alias("errors"), (F.count_if(bad) / F.count("*")).alias("error_rate"),
        F.max_by(F.when(bad, F.col("error")), F.when(bad, F.struct("created_at", "usage_id"))).alias("last_error"),
    )


def error_rate(usage: DataFrame, now: Column, minimum: int = DEFAULTS.llm_error_min_calls, warn: float = DEFAULTS.llm_error_rate_warn) -> DataFrame:
    """One row: calls, errors, rate and whether to alert within 24 hours."""
    rows = usage.where(F.col("created_at") >= now - F.expr("INTERVAL 24 HOURS"))
    return rows.agg(F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("errors")).select(
        "calls", "errors", F.try_divide(F.col("errors").cast("double"), F.col("calls").cast("double")).alias("rate"),
        F.coalesce((F.col("calls") >= minimum) & (F.col("errors") >= F.col("calls") * F.lit(warn)), F.lit(False)).alias("alert"),
    )


def degraded_kinds(tasks: DataFrame, now: Column) -> DataFrame:
    """Kinds of tasks that were tried within 24 hours and never finished."""
    rows = tasks.where(F.col("updated_at") >= now - F.expr("INTERVAL 24 HOURS"))
    return rows.groupBy("kind").agg(F.count("*").alias("attempts"), F.count_if(F.col("status") == "DONE").alias("done")).where("attempts > 0 AND done = 0")


def health_payload(tasks: DataFrame, now: Column, stale_minutes: int = DEFAULTS.fetch_stale_minutes, pending_limit: int = DEFAULTS.pending_stale_count) -> DataFrame:
    """One row: minutes since the last finished fetch, pending tasks, oldest running task, and 200 or 503."""
    minutes = lambda ts: (F.unix_timestamp(now) - F.unix_timestamp(ts)) / 60.0
    one = tasks.agg(
        F.max(F.when((F.col("kind") == "fetch") & (F.col("status") == "DONE"), F.col("updated_at"))).alias("last_done"),
        F.count_if(F.col("status") == "PENDING").alias("pending"), F.min(F.when(F.col("status") == "RUNNING", F.col("updated_at"))).alias("oldest_running"),
    )
    bad = F.coalesce(minutes(F.col("last_done")) > stale_minutes, F.lit(True)) | (F.col("pending") > pending_limit)
    return one.select(minutes(F.col("last_done")).alias("fetch_minutes_ago"), "pending", minutes(F.col("oldest_running")).alias("running_minutes"), F.when(bad, 503).otherwise(200).alias("http_status"))


def tokens_today(usage: DataFrame, now: Column, zone: str = DEFAULTS.time_zone, budget: int = 0) -> DataFrame:
    """One row: tokens since local midnight and whether a budget over 0 is used up."""
    used = usage.where(F.col("created_at") >= D.local_day_start(now, zone)).agg(F.coalesce(F.sum(F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))), F.lit(0)).alias("tokens"))
    return used.withColumn("exceeded", F.lit(budget > 0) & (F.col("tokens") >= budget))


def reconcile(usage: DataFrame, bills: DataFrame, alert_pct: float = DEFAULTS.reconcile_alert_pct) -> DataFrame:
    """Billed units against the ledger for each (month, platform_units): deviation in percent and whether to alert.

    With an empty ledger the deviation is 0 for a bill of 0, else 100.
    """
    sums = usage.groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.sum(F.coalesce("billing_units", F.lit(0))).alias("ledger_units"))
    rows = bills.join(sums, "month", "left").withColumn("ledger_units", F.coalesce("ledger_units", F.lit(0)))
    off = F.abs(F.col("platform_units") - F.col("ledger_units")) / F.col("ledger_units") * 100
    pct = F.when(F.col("ledger_units") > 0, off).when(F.col("platform_units") == 0, 0.0).otherwise(100.0)
    return rows.withColumn("deviation_pct", pct).withColumn("alert", F.col("deviation_pct") > alert_pct)


def last_success(tasks: DataFrame, sources: DataFrame) -> DataFrame:
    """Each source with the time of its last finished fetch; the source id is read from the task's JSON payload."""
    done = tasks.where("kind = 'fetch' AND status = 'DONE'").groupBy(F.get_json_object("payload", "$.source_id").cast("long").alias("source_id")).agg(F.max("updated_at").alias("last_success"))
    return sources.join(done, "source_id", "left")


def collective_sentinel(rounds: DataFrame, ratio: float = DEFAULTS.sentinel_ratio, streak: int = DEFAULTS.sentinel_rounds) -> DataFrame:
    """Rounds (round_id, enabled, degraded) with ``alert``: over the ratio for so many rounds in a row.

    A run of high rounds is known by how many low ones came before it: a running sum in bands of round numbers.
    """
    high = F.coalesce(F.col("degraded") > F.col("enabled") * F.lit(ratio), F.lit(False))
    low = preceding(rounds.withColumn("_low", (~high).cast("int")).withColumn("_all", F.lit(0)), "_all", "round_id", "_low", [F.asc("round_id")])
    return low.withColumn("_run", F.col("before") + F.col("_low")).drop("_low", "_all", "before").withColumn("streak", F.sum(high.cast("int")).over(Window.partitionBy("_run").orderBy("round_id"))).withColumn("alert", F.col("streak") >= streak).drop("_run")


def channel_funnel(items: DataFrame, scores: DataFrame, reading: DataFrame, cited: DataFrame, sources: DataFrame) -> DataFrame:
    """By type of source: items, passed items, items in reading sets, citations."""
    rows = items.join(sources.select("source_id", "type"), "source_id").join(scores.where("passed").select("item_id").distinct().withColumn("_p", F.lit(1)), "item_id", "left")
    rows = rows.join(reading.select("item_id").distinct().withColumn("_r", F.lit(1)), "item_id", "left").join(cited.groupBy("item_id").agg(F.count("*").alias("_c")), "item_id", "left")
    return rows.groupBy("type").agg(F.count("*").alias("items"), F.count("_p").alias("passed"), F.count("_r").alias("in_reading_set"), F.coalesce(F.sum("_c"), F.lit(0)).alias("cited"))


def latency_per_item(calls: DataFrame) -> DataFrame:
    """ms per item of each model, and whether any call reported no tokens."""
    return calls.groupBy("model").agg(F.sum("items").alias("items"), (F.sum("latency_ms") / F.sum("items")).alias("ms_per_item"), F.bool_or(F.coalesce("tokens", F.lit(0)) == 0).alias("zero_tokens"))


def score_summary(scores: DataFrame, sizes: list[int]) -> DataFrame:
    """Count, mean and upper median of relevance by band and bucket of body length, from counts per distinct relevance."""
    bucket = F.lit(None).cast("int")
    for size in sorted(sizes):
        bucket = F.when(F.col("chars") >= size, size).otherwise(bucket)
    counts = scores.withColumn("bucket", bucket).groupBy("band", "bucket", "relevance").agg(F.count("*").alias("_n"), F.count("relevance").alias("_known"))
    group = Window.partitionBy("band", "bucket")
    upto, total = F.sum("_known").over(group.orderBy("relevance")), F.sum("_known").over(group)
    rows = counts.withColumn("_mid", F.when(upto > F.floor(total / 2), F.col("relevance")))
    mean = F.try_divide(F.sum(F.col("relevance") * F.col("_n")).cast("double"), F.sum("_known"))
    return rows.groupBy("band", "bucket").agg(F.sum("_n").alias("n"), mean.alias("mean"), F.min("_mid").alias("median"))


def null_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rows, nulls, blanks) of text columns, in one pass over the table."""
    one = rows.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in columns], *[F.count_if(F.trim(F.col(c)) == "").alias(f"b_{c}") for c in columns])
    return one.select("rows", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("nulls"), F.col(f"b_{c}").alias("blanks")) for c in columns])).alias("p")).select("p.column", "rows", "p.nulls", "p.blanks")


def nearest_rank(rows: DataFrame, value: str, shares: list[float], accuracy: int = 10_000) -> DataFrame:
    """(share, value): sorted[min(int(n * p), n - 1)] of a numeric column; rows without a value are left out.

    Two passes. A quantile sketch, which is merged over the partitions, bounds each rank: the value lies between the
    sketch's values two parts in ``accuracy`` below and above. Then the values below are counted, and only those within
    the bounds, about four parts in ``accuracy`` of the rows, are shuffled, as counts of distinct values.
    """
    rows = rows.where(F.col(value).isNotNull()).select(F.col(value).alias("value"))
    room = 2 / accuracy
    wanted = [min(max(p + d, 0.0), 1.0) for p in shares for d in (-room, room)]
    n, sketch, least, most = rows.agg(F.count("*"), F.percentile_approx("value", wanted, accuracy), F.min("value"), F.max("value")).first()
    if not n:
        return rows.select(F.lit(None).cast("double").alias("share"), "value").limit(0)
    places = [min(int(n * p), n - 1) for p in shares]
    bounds = [(least if p <= room else sketch[2 * i], most if p >= 1 - room else sketch[2 * i + 1]) for i, p in enumerate(shares)]
    below = rows.agg(*[F.count_if(F.col("value") < F.lit(b)) for low, high in bounds for b in (low,)], *[F.count_if(F.col("value") <= F.lit(high)) for low, high in bounds]).first()
    known = []
    for i, (p, place, (low, high)) in enumerate(zip(shares, places, bounds, strict=True)):
        if not below[i] <= place < below[len(shares) + i]:  # no sketch may err like this; all values then count as within
            low, high, before = least, most, 0
        else:
            before = below[i]
        known.append(F.struct(F.lit(float(p)).alias("share"), F.lit(place - before).cast("long").alias("place"), F.lit(low).alias("low"), F.lit(high).alias("high")))
    within = rows.withColumn("at", F.explode(F.filter(F.array(*known), lambda x: F.col("value").between(x["low"], x["high"]))))
    counts = within.groupBy("at.share", "at.place", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("share").orderBy("value")
    upto = counts.withColumn("upto", F.sum("n").over(order))
    return upto.where((F.col("upto") > F.col("place")) & (F.col("upto") - F.col("n") <= F.col("place"))).select("share", "value")


def usage_rows(calls: DataFrame, longest: int = 2000) -> DataFrame:
    """Rows of the usage ledger from reported calls: missing counts are 0, a missing outcome is ok, errors are cut and
    rid of what looks like a key."""
    counts = ("prompt_tokens", "completion_tokens", "billing_units", "cache_hit_tokens", "reasoning_tokens", "latency_ms")
    error = F.nullif(F.col("error"), F.lit(""))
    return calls.select(
        *[c for c in calls.columns if c not in (*counts, "ok", "error")], *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts], F.coalesce("ok", F.lit(True)).alias("ok"),
        F.substring(F.replace(error, F.lit("sk-"), F.lit("sk-***")), 1, longest).alias("error"),
    )


def overview(tasks: DataFrame, scores: DataFrame, runs: DataFrame, since: Column) -> DataFrame:
    """One row: failed fetches, failed scores, failed and skipped writing runs, and success rates of fetching and writing
    in the window, to four places; no rate without tasks."""
    rate = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), 4)
    t = tasks.where((F.col("kind") == "fetch") & (F.col("updated_at") >= since)).agg(F.count_if(F.col("status") == "FAILED").alias("fetch_failed"), F.count_if(F.col("status") == "DONE").alias("_done"), F.count("*").alias("_tasks"))
    s = scores.where(F.col("created_at") >= since).agg(F.count_if(F.col("status") == "FAILED").alias("score_failed"))
    r = runs.where(F.col("created_at") >= since).agg(F.count_if(F.col("status") == "FAILED").alias("write_failed"), F.count_if(F.col("decision") == "SKIP").alias("write_skipped"), F.count_if(F.col("status") == "OK").alias("_ok"), F.count("*").alias("_runs"))
    one = t.join(F.broadcast(s)).join(F.broadcast(r))  # one row each
    return one.select("fetch_failed", "score_failed", "write_failed", "write_skipped", rate("_done", "_tasks").alias("fetch_rate"), rate("_ok", "_runs").alias("write_rate"))


def pipeline_stats(tasks: DataFrame, sources: DataFrame, items: DataFrame, scores: DataFrame, now: Column, stale_days: int = DEFAULTS.sentinel_stale_days) -> DataFrame:
    """One row: waiting tasks, tasks reclaimed as stale, new items, scores and passed ones of 24 hours, and the degraded
    of the enabled sources: suspect, dead but not for long, or limited now."""
    day = now - F.expr("INTERVAL 24 HOURS")
    t = tasks.agg(F.count_if(F.col("status") == "PENDING").alias("pending"), F.count_if((F.col("status") == "FAILED") & F.col("last_error").startswith("stale_reclaim:") & (F.col("updated_at") >= day)).alias("stale_24h"))
    i = items.where(F.col("fetched_at") >= day).agg(F.count("*").alias("items_24h"))
    s = scores.where((F.col("created_at") >= day) & (F.col("status") == "OK")).agg(F.count("*").alias("scored_24h"), F.count_if("passed").alias("passed_24h"))
    long_dead = F.coalesce(now - F.expr(f"INTERVAL {stale_days} DAYS") > F.col("failure_since"), F.lit(False))
    bad = (F.col("failure_level") == "suspect") | ((F.col("failure_level") == "hard_failed") & ~long_dead) | (F.col("rate_limited_until") > now)
    src = sources.where("enabled").agg(F.count("*").alias("enabled_sources"), F.count_if(F.coalesce(bad, F.lit(False))).alias("degraded_sources"))
    return t.join(F.broadcast(i)).join(F.broadcast(s)).join(F.broadcast(src))  # one row each


def run_counts(runs: DataFrame) -> DataFrame:
    """One row: finished, skipped and failed writing runs, and all of them."""
    return runs.agg(F.count("*").alias("runs"), F.count_if((F.col("status") == "OK") & (F.col("decision") == "WRITE")).alias("written"), F.count_if(F.col("decision") == "SKIP").alias("skipped"), F.count_if(F.col("status") == "FAILED").alias("failed"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) of every table."""
    out = None
    for name, rows in tables.items():
        part = rows.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


def brief_scores(items: DataFrame) -> DataFrame:
    """Of the items (brief, score) of each brief: how many, how many scored, at least 60, at most 30, and the range and
    mean to one place of the scores."""
    s = F.col("score")
    return items.groupBy("brief").agg(F.count("*").alias("items"), F.count(s).alias("scored"), F.count_if(s >= 60).alias("ge60"), F.count_if(s <= 30).alias("le30"), F.min(s).alias("score_min"), F.max(s).alias("score_max"), F.round(F.avg(s), 1).alias("score_mean"))


def top_sources(sources: DataFrame, items: DataFrame, n: int = 20) -> DataFrame:
    """The n sources with most items, ties by id; a source without items counts 0."""
    counts = items.groupBy("source_id").agg(F.count("*").alias("items"))
    return sources.join(counts, "source_id", "left").fillna(0, ["items"]).orderBy(F.desc("items"), "source_id").limit(n)
