"""Default parameters of the operators, in one immutable record that callers may replace."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # fixed values: they must equal the documented defaults for equal results
    min_body_chars: int = 200
    max_age_days: int = 30
    first_ingest_days: int = 7
    search_max_age_days: int = 365
    page_text_chars: int = 100_000
    score_body_chars: int = 4000
    embed_chars: int = 2000
    score_round_items: int = 200
    score_expire_days: int = 2
    reading_set_k: int = 10
    reading_pool: int = 200
    rank_pool: int = 50
    domain_cap: int = 3
    reading_body_chars: int = 1200
    rank_max_candidates: int = 30
    rank_text_chars: int = 500
    retrieval_top_k: int = 5
    semantic_dedup_threshold: float = 0.92
    explore_mmr_lambda: float = 0.3
    explore_floor: int = 50
    explore_percentile: int = 5
    explore_quota: int = 3
    interleave_probability: float = 0.2
    interleave_minimum: int = 40
    backoff_fail_threshold: int = 3
    backoff_probe_every: int = 4
    hard_fail_rounds: int = 3
    suspect_empty_rounds: int = 3
    hard_fail_probe_days: int = 7
    hard_fail_probe_quota: int = 5
    keyword_exhausted_rounds: int = 6
    rate_limit_base_minutes: int = 15
    rate_limit_max_minutes: int = 240
    zero_gain_rounds: int = 6
    zero_gain_max_level: int = 4
    hot_keywords_per_platform: int = 20
    hot_cooldown_streak: int = 3
    hot_cooldown_minutes: int = 30
    search_quota_minute: int = 8
    search_quota_day: int = 200
    retry_budget_per_minute: int = 50
    throttle_gap_s: float = 3.0
    throttle_max_wait_s: float = 30.0
    feedback_ip_hourly: int = 30
    feedback_article_daily: int = 100
    feedback_memory_daily: int = 50
    notify_window_hours: int = 24
    notify_gap_s: int = 60
    notify_queue_cap: int = 10
    login_failures: int = 5
    sentinel_ratio: float = 0.5
    sentinel_rounds: int = 2
    sentinel_stale_days: int = 30
    echo_min_chars: int = 20
    copyright_ngram: int = 8
    topic_dice: float = 0.55
    llm_error_rate_warn: float = 0.5
    llm_error_min_calls: int = 10
    reconcile_alert_pct: float = 10.0
    time_zone: str = "Asia/Shanghai"
    fetch_stale_minutes: int = 90
    pending_stale_count: int = 500
    upgrade_confidence: float = 0.8


DEFAULTS = Settings()
