"""Every operator as a named query over the test tables, with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brightloom.functions import dates as D
from brightloom.functions import tables
from brightloom.functions import text as T
from brightloom.functions import urls as U
from brightloom.functions import vectors as V
from brightloom.operators import evaluation, gates, health, hot, ingest, ledger, limits, ranking, routing
from brightloom.operators import items as lists
from brightloom.operators.fingerprints import FingerprintIndex
from brightloom.operators.paging import PagedTable
from brightloom.operators.vector_index import VectorIndex
from brightloom.plans import base as B
from brightloom.storage import parts_of, stored
from brightloom.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
TS = "TIMESTAMP '2024-02-01 00:00:00'"
#: Lines that a task of citation_rows holds, on average.
LINES_A_TASK = 500_000
WS = "[ \\t\\n\\r\\f\\v]"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under the function's name."""

    def add(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql:
            ORACLE_SQL[run.__name__] = sql
        return run

    return add


# ---- ingest ----


def _ruled(spark: SparkSession, d: str) -> DataFrame:
    rows = B.items(spark, d)
    reason = ingest.rule_reason(F.col("title"), F.col("content_text"), F.col("published_at"), B.now(), blacklist=["Lorem", "License"])
    rows = rows.withColumn("rule_reason", reason).withColumn("fetch_status", F.when(F.col("rule_reason").isNotNull(), "REJECTED_RULED").otherwise("FETCHED"))
    return ingest.sanitized(rows, deny=["password"])


_RULED_SQL = f"""{B.ITEMS}, ruled AS (
  SELECT *, CASE WHEN length(trim(content_text, ' ' || chr(9) || chr(10) || chr(13))) < 200 THEN 'too_short'
       WHEN contains(title || chr(10) || content_text, 'Lorem') OR contains(title || chr(10) || content_text, 'License') THEN 'blacklist'
       WHEN ({TS} - published_at) > INTERVAL 30 DAYS THEN 'expired' END AS rule
  FROM items), swept AS (
  SELECT *, CASE
    WHEN regexp_matches(title || chr(10) || content_text, '(?i)(disregard|ignore|forget)\\s+(all\\s+)?(previous|prior|above|earlier)\\s+(instructions?|prompts?|rules?|directions?)') THEN 'injection_pattern|ignore_previous_instructions_en'
    WHEN regexp_matches(title || chr(10) || content_text, '(?i)(reveal|output|print|leak|show)\\s*.{{0,24}}(api[\\s_-]?key|secret|credentials?|password|token)') THEN 'injection_pattern|reveal_credentials'
    WHEN regexp_matches(title || chr(10) || content_text, '(?i)jailbreak') THEN 'injection_pattern|developer_mode_override'
    WHEN regexp_matches(title || chr(10) || content_text, '(?i)(reveal|output|repeat|print).{{0,16}}(system\\s*prompt)') THEN 'injection_pattern|system_prompt_extraction'
    WHEN contains(title || chr(10) || content_text, 'password') THEN 'keyword_deny|password' END AS swept
  FROM ruled)"""


@query(f"""WITH {_RULED_SQL}, hits AS (
  SELECT 'rule' AS stage, rule AS reason FROM swept WHERE rule IS NOT NULL UNION ALL SELECT 'sanitize', swept FROM swept WHERE swept IS NOT NULL)
SELECT stage, reason, count(*) AS count, count(*)::DOUBLE / (SELECT count(*) FROM items) AS share FROM hits GROUP BY stage, reason""")
def filter_rules_stats(spark: SparkSession, d: str) -> DataFrame:
    return ingest.filter_stats(_ruled(spark, d))


@query(f"""WITH {_RULED_SQL} SELECT item_id, CASE WHEN rule = 'too_short' THEN 'too_short:' || length(trim(content_text, ' ' || chr(9) || chr(10) || chr(13))) || '<200'
  WHEN rule = 'blacklist' THEN CASE WHEN contains(title || chr(10) || content_text, 'Lorem') THEN 'blacklist:Lorem' ELSE 'blacklist:License' END
  WHEN rule = 'expired' THEN 'expired:' || date_diff('day', published_at, {TS}) || 'd>30d' END AS reason FROM swept""")
def rule_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _ruled(spark, d).select("item_id", F.col("rule_reason").alias("reason"))


@query(f"""WITH {B.ITEMS}, k AS (SELECT item_id, direction, sha256(lower(regexp_replace(content_text, '\\s+', '', 'g'))) AS fp FROM items)
SELECT item_id, CASE WHEN item_id > min(item_id) OVER (PARTITION BY direction, fp) THEN min(item_id) OVER (PARTITION BY direction, fp) END AS duplicate_of FROM k""")
def exact_dup_origin(spark: SparkSession, d: str) -> DataFrame:
    rows = B.items(spark, d).select("item_id", "direction", F.sha2(T.norm(F.col("content_text")), 256).alias("fp"))
    return ingest.exact_origins(rows, ["direction", "fp"]).select("item_id", "duplicate_of")  # only the stored keys read the texts


@query(f"""WITH {B.ITEMS}, k AS (SELECT item_id, lower(regexp_replace(title, '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', '', 'g')) AS title_key FROM items)
SELECT title_key, count(*) AS n, min(item_id) AS first_id FROM k WHERE title_key <> '' GROUP BY title_key HAVING count(*) > 1""")
def duplicate_titles(spark: SparkSession, d: str) -> DataFrame:
    return ingest.duplicate_title_groups(B.items(spark, d))


def _feed(spark: SparkSession, d: str) -> DataFrame:
    """items as one feed: every tenth guid repeats the one before, every fiftieth is missing."""
    n = F.col("item_id")
    guid = F.when(n % 50 == 7, "").otherwise(F.concat(F.lit("g"), (n - F.when(n % 10 == 3, 1).otherwise(0)).cast("string")))
    rows = B.items(spark, d).withColumn("source_id", F.col("direction")).withColumn("guid", guid).withColumn("position", n)
    return rows.withColumn("fingerprint", F.sha2("content_text", 256))


def _classified_sql(guid: str, known: str, rule: str, archived: str) -> str:
    """Counts by source of what a feed's entries become."""
    return f"""WITH {B.ITEMS}, f AS (SELECT *, {guid} AS guid, sha256(content_text) AS fp FROM items), k AS (SELECT direction, fp, guid FROM f WHERE {known}), b AS (
  SELECT *, guid <> '' AND (row_number() OVER (PARTITION BY direction, guid ORDER BY item_id) > 1 OR EXISTS (SELECT 1 FROM k WHERE k.direction = f.direction AND k.guid = f.guid)) AS blocked FROM f
), o AS (SELECT direction, fp, min(item_id) AS origin FROM b WHERE guid <> '' AND NOT blocked GROUP BY ALL), c AS (
  SELECT b.direction AS source_id, CASE WHEN b.guid = '' THEN 'failed' WHEN b.blocked THEN 'dup_blocked'
    WHEN b.item_id > o.origin OR EXISTS (SELECT 1 FROM k WHERE k.direction = b.direction AND k.fp = b.fp) THEN 'inserted'
    WHEN length(trim(content_text, ' ' || chr(9) || chr(10) || chr(13))) < 200 OR {rule} THEN 'rule_rejected' WHEN {archived} THEN 'archived' ELSE 'inserted' END AS class
  FROM b LEFT JOIN o ON o.direction = b.direction AND o.fp = b.fp)
SELECT source_id, count(*) AS feed_entries, count(*) FILTER (WHERE class = 'inserted') AS inserted, count(*) FILTER (WHERE class = 'dup_blocked') AS dup_blocked,
  count(*) FILTER (WHERE class = 'rule_rejected') AS rule_rejected, count(*) FILTER (WHERE class = 'failed') AS failed, count(*) FILTER (WHERE class = 'archived') AS archived FROM c GROUP BY source_id"""


@query(_classified_sql("CASE WHEN item_id % 50 = 7 THEN '' ELSE 'g' || (item_id - CASE WHEN item_id % 10 = 3 THEN 1 ELSE 0 END) END", "item_id % 20 = 0", f"({TS} - published_at) > INTERVAL 30 DAYS", "false"))
def ingest_ledger(spark: SparkSession, d: str) -> DataFrame:
    feed = _feed(spark, d)
    known = feed.where(F.col("item_id") % 20 == 0).select("source_id", "direction", "guid", "fingerprint")
    return ingest.ingest_ledger(ingest.classified(feed, known, B.now()))


@query(_classified_sql("'g' || item_id", "false", "false", f"({TS} - published_at) > INTERVAL 7 DAYS"))
def first_ingest_ledger(spark: SparkSession, d: str) -> DataFrame:
    feed = _feed(spark, d).withColumn("guid", F.concat(F.lit("g"), F.col("item_id").cast("string")))
    return ingest.ingest_ledger(ingest.classified(feed, feed.limit(0).select("source_id", "direction", "guid", "fingerprint"), B.now(), first_ingest=True))


@query("""SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title,
  substr(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), 1, 100000) AS text FROM pages""")
def html_title_text(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "pages").select("page_id", T.html_title(F.col("html")).alias("title"), T.html_text(F.col("html")).alias("text"))


_STRIPPED = "regexp_replace(split_part(url, '#', 1), '[?].*$', '')"


@query(f"""WITH q AS (SELECT page_id, url, list_filter(string_split(regexp_extract(split_part(url, '#', 1), '[?](.*)$', 1), '&'),
    lambda p: p <> '' AND lower(split_part(p, '=', 1)) NOT IN ('utm_source','utm_medium','utm_campaign','utm_term','utm_content','fbclid','gclid','igshid','mc_cid','mc_eid','spm','ref','ref_src')) AS ps FROM pages
), n AS (SELECT page_id, url, {_STRIPPED} || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END AS normalized FROM q)
SELECT page_id, normalized, sha256(lower(regexp_extract(normalized, '^([A-Za-z][A-Za-z0-9+.-]*:(//[^/?#]*)?)', 1)) || substr(normalized, length(regexp_extract(normalized, '^([A-Za-z][A-Za-z0-9+.-]*:(//[^/?#]*)?)', 1)) + 1)) AS fingerprint,
  lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host FROM n""")
def url_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return B.table(spark, d, "pages").select("page_id", U.normalize_url(u).alias("normalized"), U.url_fingerprint(u).alias("fingerprint"), U.host(u).alias("host"))


@query()
def url_fingerprints_exact(spark: SparkSession, d: str) -> DataFrame:
    rows = B.table(spark, d, "pages").select("page_id", U.normalize_url_exact("url").alias("normalized"), U.fold_title(T.html_title(F.col("html"))).alias("title"))
    return rows.withColumn("e", U.entry_fingerprint(F.col("normalized"), F.lit(""), F.col("title"))).select("page_id", "normalized", "title", "e.fingerprint", "e.low_confidence")


@query("""WITH s AS (SELECT split_part(url, '?', 1) AS u, page_id, sha256(html) AS h FROM pages), x AS (
  SELECT u, page_id, h, lag(h) OVER (PARTITION BY u ORDER BY page_id) AS b FROM s)
SELECT page_id, CASE WHEN b IS NULL THEN 'first_fetch' WHEN b = h THEN 'unchanged' ELSE 'content_changed' END AS event,
  CASE WHEN b <> h THEN u || '#v-' || substr(h, 1, 12) ELSE u END AS guid FROM x""")
def page_changes(spark: SparkSession, d: str) -> DataFrame:
    rows = B.table(spark, d, "pages").select("page_id", F.substring_index("url", "?", 1).alias("url"), F.col("page_id").alias("seen_at"), F.lit(None).cast("string").alias("etag"), "html")
    return ingest.page_changes(rows).select("page_id", "event", "guid")


@query(f"""WITH {B.ITEMS}, w AS (SELECT DISTINCT item_id, unnest(regexp_split_to_array(lower(title), '[^\\p{{L}}\\p{{N}}]+')) AS word FROM items),
f AS (SELECT * FROM w WHERE length(word) > 1 AND word IN (SELECT word FROM w WHERE length(word) > 1 GROUP BY word HAVING count(*) BETWEEN 2 AND 6))
SELECT a.item_id AS a, b.item_id AS b, count(*) AS shared FROM f a JOIN f b ON a.word = b.word AND a.item_id < b.item_id GROUP BY ALL HAVING count(*) >= 2""")
def title_rarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    return ingest.title_pairs(B.items(spark, d))


@query(f"""WITH {B.ITEMS} SELECT item_id, CASE WHEN trim(regexp_replace(content_text, '\\s+', ' ', 'g')) = '' THEN '' WHEN regexp_matches(content_text, '[぀-ヿ]') THEN 'ja'
  WHEN len(regexp_extract_all(content_text, '[一-鿿]')) * 10 > length(content_text) THEN 'zh' ELSE 'en' END AS detected,
  CASE WHEN length(s) > 120 THEN rtrim(substr(s, 1, 120)) || '…' ELSE s END AS first
FROM (SELECT *, trim(regexp_extract(trim(regexp_replace(content_text, '\\s+', ' ', 'g')), '^([^。！？；!?]*[。！？；!?]?)', 1)) AS s FROM items)""")
def language_and_first_sentence(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content_text")
    return B.items(spark, d).select("item_id", T.detect_lang(c).alias("detected"), T.first_sentence(c).alias("first"))


# ---- candidates and lists ----

_POOL = f"""{B.ITEMS}, {B.SCORES}, dup AS (
  SELECT item_id, min(item_id) OVER (PARTITION BY direction, sha256(lower(regexp_replace(content_text, '\\s+', '', 'g')))) AS o FROM items)"""


def _pool(spark: SparkSession, d: str) -> DataFrame:
    rows = B.items(spark, d).withColumn("fp", F.sha2(T.norm(F.col("content_text")), 256))
    return ingest.exact_origins(rows, ["direction", "fp"]).withColumn("fetch_status", F.lit("FETCHED")).withColumn("sanitize_status", F.lit("PASSED"))


@query(f"""WITH {_POOL} SELECT i.item_id, i.direction FROM items i JOIN dup USING (item_id)
WHERE dup.o = i.item_id AND NOT EXISTS (SELECT 1 FROM scores s WHERE s.status = 'OK' AND s.item_id = i.item_id AND s.direction = i.direction)""")
def scoring_candidates_anti(spark: SparkSession, d: str) -> DataFrame:
    return lists.scoring_candidates(_pool(spark, d), B.scores(spark, d)).select("item_id", "direction")


@query(f"""WITH {_POOL}, c AS (
  SELECT i.*, row_number() OVER (PARTITION BY i.direction ORDER BY i.n_chars DESC, i.item_id) AS rank FROM items i JOIN dup USING (item_id)
  WHERE dup.o = i.item_id AND length(trim(i.content_text, ' ' || chr(9) || chr(10) || chr(13))) >= 200
    AND NOT EXISTS (SELECT 1 FROM scores s WHERE s.status = 'OK' AND s.item_id = i.item_id AND s.direction = i.direction))
SELECT item_id, direction, title, n_chars, rank::INT AS rank FROM c WHERE rank <= 10""")
def top_unscored(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: fold and fingerprint, drop exact duplicates, apply the rules, drop scored items, best ten by language."""
    rows = lists.scoring_candidates(_pool(spark, d), B.scores(spark, d))
    reason = ingest.rule_reason(F.col("title"), F.col("content_text"), F.lit(None).cast("timestamp"), B.now())
    rows = rows.where(reason.isNull()).select("item_id", "direction", "title", "n_chars")
    return lists.top_per_group(rows, ["direction"], [F.desc("n_chars"), F.col("item_id")], 10)


@query(f"""WITH {_POOL}, st AS (SELECT item_id, bool_or(status = 'OK') AS ok, bool_or(status = 'OK' AND version = 2) AS cur FROM scores GROUP BY item_id)
SELECT i.item_id, i.direction FROM items i LEFT JOIN st USING (item_id)
WHERE (coalesce(ok, false) AND NOT coalesce(cur, false)) OR (i.item_id % 7 = 0 AND NOT coalesce(ok, false))""")
def rescore_scope_all(spark: SparkSession, d: str) -> DataFrame:
    rows = B.items(spark, d).withColumn("fetch_status", F.when(F.col("item_id") % 7 == 0, "ARCHIVED").otherwise("FETCHED"))
    return lists.rescore_candidates(rows, B.scores(spark, d), version=2)


@query(f"""WITH {_POOL}, st AS (SELECT item_id, bool_or(status = 'OK') AS ok, bool_or(status = 'FAILED') AS failed FROM scores GROUP BY item_id)
SELECT i.item_id, i.direction FROM items i JOIN st USING (item_id) WHERE failed AND NOT ok""")
def rescore_scope_failed(spark: SparkSession, d: str) -> DataFrame:
    return lists.rescore_candidates(B.items(spark, d).withColumn("fetch_status", F.lit("FETCHED")), B.scores(spark, d), version=2, scope="failed")


@query(f"""WITH {B.ITEMS}, {B.SCORES} SELECT i.item_id, (floor((row_number() OVER (ORDER BY i.item_id) - 1) / 50))::BIGINT AS batch FROM items i WHERE i.item_id IN (SELECT item_id FROM scores WHERE status = 'FAILED')""")
def rescore_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = B.items(spark, d).join(B.scores(spark, d).where("status = 'FAILED'").select("item_id"), "item_id", "left_semi")
    return lists.batches(rows.select("item_id"), "item_id", 50).select("item_id", "batch")


@query(f"""WITH {B.ITEMS} SELECT item_id, direction, 'EXPIRED' AS status FROM items WHERE published_at < {TS} - INTERVAL 40 DAYS""")
def expiring_items(spark: SparkSession, d: str) -> DataFrame:
    rows = B.items(spark, d).withColumn("fetch_status", F.lit("FETCHED")).withColumn("fetched_at", F.col("published_at"))
    return lists.expiring_items(rows, B.scores(spark, d), B.now() - F.expr("INTERVAL 40 DAYS"))


@query(f"""WITH {B.ITEMS}, {B.SCORES} SELECT i.item_id, i.title, length(i.content_text)::INT AS content_chars, s.relevance, s.status FROM items i
LEFT JOIN scores s ON s.item_id = i.item_id AND s.direction = i.direction WHERE i.direction = 'en' ORDER BY i.item_id DESC LIMIT 50""")
def item_list(spark: SparkSession, d: str) -> DataFrame:
    rows = lists.item_list(B.items(spark, d).where("direction = 'en'"), B.scores(spark, d))
    return lists.page(rows.select("item_id", "title", "content_chars", "relevance", "status"), [F.desc("item_id")], 50)


@query(f"""WITH {B.USAGE} SELECT provider, model, max(usage_id) AS usage_id, arg_max(latency_ms, usage_id) AS latency_ms FROM usage GROUP BY provider, model""")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return lists.latest(B.usage(spark, d).select("provider", "model", "usage_id", "latency_ms"), ["provider", "model"], "usage_id")


@query("""SELECT o_custkey, o_orderkey, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""")
def top_n_per_group(spark: SparkSession, d: str) -> DataFrame:
    rows = lists.top_per_group(B.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)
    return rows.select("o_custkey", "o_orderkey", "rank")


@query(f"""WITH {B.ITEMS}, {B.SCORES} SELECT i.item_id, i.title, i.url, s.relevance FROM items i JOIN scores s USING (item_id, direction)
WHERE s.status = 'OK' AND s.passed AND i.direction IN ('en', 'de') ORDER BY s.relevance DESC, i.item_id LIMIT 50""")
def public_list(spark: SparkSession, d: str) -> DataFrame:
    directions = spark.createDataFrame([("en", True), ("de", True), ("fr", False)], "direction string, public boolean")
    return lists.public_list(B.items(spark, d), B.scores(spark, d), directions).select("item_id", "title", "url", "relevance")


@query(f"""WITH {B.ITEMS}, {B.SCORES}, {B.TASKS} SELECT item_id, title FROM items i WHERE EXISTS (SELECT 1 FROM tasks WHERE kind = 'score' AND status = 'FAILED' AND updated_at >= {TS} - INTERVAL 48 HOURS)
AND NOT EXISTS (SELECT 1 FROM scores s WHERE s.item_id = i.item_id AND s.status = 'OK') ORDER BY item_id DESC LIMIT 10""")
def unscored_entries(spark: SparkSession, d: str) -> DataFrame:
    return lists.unscored_entries(B.items(spark, d), B.scores(spark, d), B.tasks(spark, d), B.now() - F.expr("INTERVAL 24 HOURS")).select("item_id", "title")


@query("""WITH a AS (SELECT o_orderkey AS article_id, l_linenumber AS k, l_partkey AS item_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT a.article_id, a.item_id, p.p_name AS title, count(*) AS n FROM a LEFT JOIN part p ON p.p_partkey = a.item_id GROUP BY ALL""")
def citation_rows(spark: SparkSession, d: str) -> DataFrame:
    """The lines of an order as the citations of an article; lines are counted, so that a task's share does not grow."""
    o, line, p = (B.table(spark, d, t) for t in ("orders", "lineitem", "part"))
    parts = parts_of(line, LINES_A_TASK)
    cited = line.select("l_orderkey", "l_partkey").repartition(parts, "l_orderkey").groupBy(F.col("l_orderkey").alias("article_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_partkey").alias("item_id"), F.lit("").alias("quote")))).alias("citations"))
    articles = o.select(F.col("o_orderkey").alias("article_id")).repartition(parts, "article_id").join(cited, "article_id")
    things = p.select(F.col("p_partkey").alias("item_id"), F.lit("").alias("url"), F.col("p_name").alias("title")).repartition(parts, "item_id")
    return lists.citation_rows(articles, things).groupBy("article_id", "item_id", "title").agg(F.count("*").alias("n"))


# ---- ledgers ----


@query(f"""WITH {B.USAGE} SELECT call_point, model, count(*) AS calls, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens,
  sum(billing_units)::BIGINT AS billing_units, count(*) FILTER (WHERE ok) AS ok_calls, avg(latency_ms)::DOUBLE AS avg_latency_ms FROM usage GROUP BY call_point, model""")
def usage_summary(spark: SparkSession, d: str) -> DataFrame:
    return ledger.usage_summary(B.usage(spark, d))


@query(f"""WITH {B.USAGE} SELECT provider, strftime((created_at AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Shanghai', '%Y-%m-%d') AS day, count(*) AS calls, count(*) FILTER (WHERE ok) AS ok_calls,
  count(*) FILTER (WHERE NOT ok) AS failed_calls, count(*) FILTER (WHERE status = 'blocked') AS quota_blocked, avg(latency_ms)::DOUBLE AS avg_latency_ms
FROM usage WHERE created_at >= {TS} - INTERVAL 7 DAYS GROUP BY ALL""")
def daily_calls_local_tz(spark: SparkSession, d: str) -> DataFrame:
    return ledger.daily_calls(B.usage(spark, d), B.now() - F.expr("INTERVAL 7 DAYS"))


@query(f"""WITH {B.USAGE} SELECT provider, count(*) AS calls, count(*) FILTER (WHERE ok) AS ok_calls, count(*) FILTER (WHERE NOT ok) AS failed_calls, count(*) FILTER (WHERE status = 'blocked') AS quota_blocked,
  sum(billing_units)::BIGINT AS candidates_total, avg(latency_ms)::DOUBLE AS avg_latency_ms FROM usage WHERE created_at >= {TS} - INTERVAL 7 DAYS GROUP BY provider""")
def rank_calls(spark: SparkSession, d: str) -> DataFrame:
    return ledger.rank_calls(B.usage(spark, d).withColumn("candidate_count", F.col("billing_units")), B.now() - F.expr("INTERVAL 7 DAYS"))


@query(f"""WITH {B.USAGE} SELECT ref_id AS author_id, call_point, count(*) AS calls, sum(prompt_tokens)::BIGINT AS prompt_tokens FROM usage WHERE created_at >= {TS} - INTERVAL 7 DAYS GROUP BY ALL""")
def tokens_by_author(spark: SparkSession, d: str) -> DataFrame:
    rows = ledger.tokens_by_author(B.usage(spark, d), B.now() - F.expr("INTERVAL 7 DAYS"))
    return rows.select("author_id", F.explode("call_points").alias("call_point", "x")).select("author_id", "call_point", "x.calls", "x.prompt_tokens")


@query(f"""WITH {B.TASKS} SELECT kind, count(*) AS total, count(*) FILTER (WHERE status = 'FAILED') AS failed, 0::BIGINT AS skipped, count(*) FILTER (WHERE status = 'DONE')::DOUBLE / count(*) AS success_rate
FROM tasks WHERE updated_at >= {TS} - INTERVAL 7 DAYS GROUP BY kind""")
def stage_rates(spark: SparkSession, d: str) -> DataFrame:
    return ledger.stage_rates(B.tasks(spark, d), B.now() - F.expr("INTERVAL 7 DAYS"))


@query(f"""WITH {B.USAGE} SELECT provider, count(*) AS total, count(*) FILTER (WHERE NOT ok) AS errors, count(*) FILTER (WHERE NOT ok)::DOUBLE / count(*) AS error_rate,
  arg_max(error, usage_id) FILTER (WHERE NOT ok) AS last_error FROM usage WHERE created_at >= {TS} - INTERVAL 48 HOURS GROUP BY provider""")
def provider_status(spark: SparkSession, d: str) -> DataFrame:
    return ledger.provider_status(B.usage(spark, d), B.now() - F.expr("INTERVAL 24 HOURS"))


@query(f"""WITH {B.USAGE} SELECT count(*) AS calls, count(*) FILTER (WHERE NOT ok) AS errors, count(*) FILTER (WHERE NOT ok)::DOUBLE / count(*) AS rate,
  count(*) >= 10 AND count(*) FILTER (WHERE NOT ok) >= count(*) * 0.5::DOUBLE AS alert FROM usage WHERE created_at >= {TS} - INTERVAL 48 HOURS""")
def error_rate_24h(spark: SparkSession, d: str) -> DataFrame:
    return ledger.error_rate(B.usage(spark, d), B.now() - F.expr("INTERVAL 24 HOURS"))


@query("""WITH t AS (SELECT 'k' || (event_id % 40) AS kind, CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'DONE' ELSE 'FAILED' END AS status, ts FROM events)
SELECT kind, count(*) AS attempts, 0::BIGINT AS done FROM t WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 24 HOURS GROUP BY kind HAVING count(*) FILTER (WHERE status = 'DONE') = 0""")
def degraded_kinds(spark: SparkSession, d: str) -> DataFrame:
    kind = F.concat(F.lit("k"), (F.col("event_id") % 40).cast("string")).alias("kind")
    tasks = B.table(spark, d, "events").select(kind, F.when((F.col("event_type") == "purchase") & (F.col("event_id") % 2 == 0), "DONE").otherwise("FAILED").alias("status"), F.col("ts").cast("timestamp").alias("updated_at"))
    return ledger.degraded_kinds(tasks, F.lit("2024-01-15 00:00:00").cast("timestamp"))


@query(f"""WITH {B.TASKS}, o AS (SELECT date_diff('second', max(updated_at) FILTER (WHERE kind = 'fetch' AND status = 'DONE'), {TS}) AS f, count(*) FILTER (WHERE status = 'PENDING') AS pending,
  epoch({TS}) - floor(epoch(min(updated_at) FILTER (WHERE status = 'RUNNING'))) AS r, epoch({TS}) - floor(epoch(max(updated_at) FILTER (WHERE kind = 'fetch' AND status = 'DONE'))) AS g FROM tasks)
SELECT (g / 60.0)::DOUBLE AS fetch_minutes_ago, pending, (r / 60.0)::DOUBLE AS running_minutes, CASE WHEN g / 60.0 > 90 OR pending > 500 THEN 503 ELSE 200 END AS http_status FROM o""")
def health_payload(spark: SparkSession, d: str) -> DataFrame:
    return ledger.health_payload(B.tasks(spark, d), B.now())


@query(f"""WITH {B.USAGE} SELECT coalesce(sum(prompt_tokens + completion_tokens), 0)::BIGINT AS tokens, coalesce(sum(prompt_tokens + completion_tokens), 0) >= 1000 AS exceeded FROM usage WHERE created_at >= TIMESTAMP '2024-01-19 16:00:00'""")
def tokens_used_today(spark: SparkSession, d: str) -> DataFrame:
    return ledger.tokens_today(B.usage(spark, d), F.lit("2024-01-20 05:00:00").cast("timestamp"), budget=1000)


_BILLS = "bills AS (SELECT * FROM (VALUES ('2024-01', 50000), ('2024-02', 0), ('2024-03', 7)) t(month, platform_units))"


@query(f"""WITH {B.USAGE}, {_BILLS}, l AS (SELECT strftime(created_at, '%Y-%m') AS month, sum(billing_units)::BIGINT AS ledger_units FROM usage GROUP BY 1), j AS (
  SELECT b.month, b.platform_units::BIGINT AS platform_units, coalesce(l.ledger_units, 0) AS ledger_units FROM bills b LEFT JOIN l USING (month))
SELECT *, CASE WHEN ledger_units > 0 THEN abs(platform_units - ledger_units)::DOUBLE / ledger_units * 100 WHEN platform_units = 0 THEN 0 ELSE 100 END AS deviation_pct,
  CASE WHEN ledger_units > 0 THEN abs(platform_units - ledger_units)::DOUBLE / ledger_units * 100 WHEN platform_units = 0 THEN 0 ELSE 100 END > 10 AS alert FROM j""")
def month_reconcile(spark: SparkSession, d: str) -> DataFrame:
    bills = spark.createDataFrame([("2024-01", 50000), ("2024-02", 0), ("2024-03", 7)], "month string, platform_units long")
    return ledger.reconcile(B.usage(spark, d), bills)


@query(f"""WITH {B.TASKS}, s AS (SELECT DISTINCT source_id FROM tasks) SELECT s.source_id, strftime(max(t.updated_at), '%Y-%m-%d %H:%M:%S') AS last_success FROM s
LEFT JOIN tasks t ON t.source_id = s.source_id AND t.kind = 'fetch' AND t.status = 'DONE' GROUP BY s.source_id""")
def source_last_success(spark: SparkSession, d: str) -> DataFrame:
    t = B.tasks(spark, d)
    sources = t.select(F.get_json_object("payload", "$.source_id").cast("long").alias("source_id")).distinct()
    return ledger.last_success(t, sources).select("source_id", F.date_format("last_success", "yyyy-MM-dd HH:mm:ss").alias("last_success"))


@query("""WITH r AS (SELECT extract('epoch' FROM date_trunc('day', ts))::BIGINT // 86400 AS round_id, count(*) AS enabled, count(*) FILTER (WHERE event_type IN ('error', 'view', 'click')) AS degraded FROM events GROUP BY 1),
h AS (SELECT *, degraded > enabled * 0.6::DOUBLE AS high FROM r), g AS (SELECT *, sum(CASE WHEN high THEN 0 ELSE 1 END) OVER (ORDER BY round_id) AS run FROM h)
SELECT round_id, enabled, degraded, sum(CASE WHEN high THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY round_id)::BIGINT AS streak,
  sum(CASE WHEN high THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY round_id) >= 2 AS alert FROM g""")
def collective_sentinel(spark: SparkSession, d: str) -> DataFrame:
    e = B.table(spark, d, "events")
    rounds = e.groupBy(F.datediff("ts", F.lit("1970-01-01").cast("date")).cast("long").alias("round_id")).agg(F.count("*").alias("enabled"), F.count_if(F.col("event_type").isin("error", "view", "click")).alias("degraded"))
    return ledger.collective_sentinel(rounds, ratio=0.6)


@query(f"""WITH {B.ITEMS}, {B.SCORES} SELECT CASE WHEN i.source_id IN ('src0', 'src1', 'src2') THEN 'rss' WHEN i.source_id IN ('src3', 'src4') THEN 'web' ELSE 'search' END AS type, count(*) AS items,
  count(*) FILTER (WHERE s.passed) AS passed, count(*) FILTER (WHERE s.passed AND i.item_id % 3 = 0) AS in_reading_set, (2 * count(*) FILTER (WHERE s.passed AND i.item_id % 6 = 0))::BIGINT AS cited
FROM items i LEFT JOIN scores s ON s.item_id = i.item_id GROUP BY 1""")
def source_funnel(spark: SparkSession, d: str) -> DataFrame:
    rows, s = B.items(spark, d), B.scores(spark, d)
    kind = F.when(F.col("source_id").isin("src0", "src1", "src2"), "rss").when(F.col("source_id").isin("src3", "src4"), "web").otherwise("search")
    reading = s.where("passed AND item_id % 3 = 0").select("item_id")
    cited = s.where("passed AND item_id % 6 = 0").select("item_id", F.explode(F.array(F.lit(1), F.lit(2))))
    return ledger.channel_funnel(rows, s, reading, cited, rows.select("source_id").distinct().withColumn("type", kind))


@query("""WITH o AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM documents), p AS (SELECT unnest([0.5, 0.9, 0.99, 1.0]::DOUBLE[]) AS share)
SELECT share, n_chars AS value FROM o JOIN p ON i = least(floor(n * share), n - 1)""")
def percentile_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return ledger.nearest_rank(B.table(spark, d, "documents"), "n_chars", [0.5, 0.9, 0.99, 1.0])


@query("""SELECT 'text' AS column, count(*) AS rows, count(*) FILTER (WHERE text IS NULL) AS nulls, count(*) FILTER (WHERE trim(text) = '') AS blanks FROM documents
UNION ALL SELECT 'lang', count(*), count(*) FILTER (WHERE lang IS NULL), count(*) FILTER (WHERE trim(lang) = '') FROM documents""")
def null_profile(spark: SparkSession, d: str) -> DataFrame:
    return ledger.null_profile(B.table(spark, d, "documents"), ["text", "lang"])


@query(f"""WITH {B.ITEMS}, {B.SCORES}, r AS (SELECT s.relevance, CASE WHEN s.relevance >= 75 THEN 'high' WHEN s.relevance >= 25 THEN 'mid' ELSE 'low' END AS band,
  CASE WHEN i.n_chars >= 2000 THEN 2000 WHEN i.n_chars >= 500 THEN 500 WHEN i.n_chars >= 0 THEN 0 END AS bucket FROM items i JOIN scores s USING (item_id))
SELECT band, bucket, count(*) AS n, avg(relevance)::DOUBLE AS mean, list_sort(list(relevance))[(count(*) // 2 + 1)::INT] AS median FROM r GROUP BY band, bucket""")
def score_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = B.scores(spark, d).join(B.items(spark, d).select("item_id", F.col("n_chars").alias("chars")), "item_id")
    return ledger.score_summary(rows.withColumn("band", lists.rank_band(F.col("relevance"))), [0, 500, 2000])


# ---- vectors ----


@query(f"""WITH {B.VECTORS}, {B.QUERY_VECTORS}, s AS (
  SELECT v.item_id, v.direction, list_cosine_similarity(v.vec, q.vec) AS sim FROM vectors v JOIN query_vectors q USING (direction)), r AS (
  SELECT *, row_number() OVER (PARTITION BY direction ORDER BY sim DESC, item_id) AS position FROM s)
SELECT item_id, direction, position::INT AS position, position <= 5 AS is_hit FROM r""")
def partition_hits(spark: SparkSession, d: str) -> DataFrame:
    v = B.vectors(spark, d)
    return routing.hit_first(v.select("item_id", "direction"), v, B.query_vectors(spark, d)).select("item_id", "direction", F.col("position").cast("int").alias("position"), "is_hit")


@query(f"""WITH {B.VECTORS}, s AS (SELECT q.item_id AS query_id, v.item_id, list_cosine_similarity(v.vec, q.vec) AS sim FROM vectors v, vectors q WHERE q.item_id < 10), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, item_id) AS rank FROM s) SELECT query_id, item_id, rank::INT AS rank FROM r WHERE rank <= 5""")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    v = B.vectors(spark, d)
    return routing.ranked_matches(v.where("item_id < 10").select(F.col("item_id").alias("query_id"), "vec"), v.select("item_id", "vec"), 5).select("query_id", "item_id", "rank")


@query(f"""WITH {B.VECTORS}, s AS (SELECT q.item_id AS query_id, v.item_id, list_cosine_similarity(v.vec, q.vec) AS sim FROM vectors v, vectors q WHERE q.item_id % 20 = 0), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, item_id) AS rank FROM s) SELECT query_id, item_id, rank::INT AS rank FROM r WHERE rank <= 5""")
def cosine_topk_every20(spark: SparkSession, d: str) -> DataFrame:
    """The search of cosine_topk with a twentieth of the table as queries."""
    v = B.vectors(spark, d)
    return routing.ranked_matches(v.where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "vec"), v.select("item_id", "vec"), 5).select("query_id", "item_id", "rank")


@query(f"""WITH {B.VECTORS} SELECT c.item_id, min(p.item_id) AS duplicate_of FROM vectors c JOIN vectors p ON p.direction = c.direction AND p.item_id <> c.item_id AND NOT contains(p.guid, '#v-')
  AND (p.item_id % 4 <> 0 OR p.item_id < c.item_id) WHERE c.item_id % 4 = 0 AND list_cosine_similarity(c.vec, p.vec) >= 0.3 GROUP BY c.item_id""")
def semantic_dup_min_origin(spark: SparkSession, d: str) -> DataFrame:
    v = B.vectors(spark, d)
    return routing.semantic_duplicates(v.where("item_id % 4 = 0"), v, threshold=0.3)


@query(f"""WITH {B.VECTORS} SELECT c.item_id, min(p.item_id) AS duplicate_of FROM vectors c JOIN vectors p ON p.direction = c.direction AND p.item_id < c.item_id AND NOT contains(p.guid, '#v-')
  WHERE list_cosine_similarity(c.vec, p.vec) >= 0.92 GROUP BY c.item_id""")
def semantic_dup_all(spark: SparkSession, d: str) -> DataFrame:
    """The duplicates of the whole table as one batch, at the production threshold."""
    v = B.vectors(spark, d)
    return routing.semantic_duplicates(v, v)


@query("""SELECT l_orderkey * 10 + l_linenumber AS item_id, l_quantity FROM lineitem ORDER BY 1 DESC LIMIT 20 OFFSET 40000""")
def deep_page(spark: SparkSession, d: str) -> DataFrame:
    """Page 2,001 of the newest lines, twenty to a page, by the zone index of a table that is written in their order."""
    rows = B.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"), "l_quantity")
    return PagedTable.build(rows, "item_id", files=16).page(40_000, 20)


_COPIES = f"""{B.VECTORS}, w AS (
  SELECT item_id, direction, vec, guid FROM vectors UNION ALL
  SELECT item_id + 1000000, direction, list_transform(vec, lambda x, i: x * 2 + 0.02 * (item_id % 5) * (i % 3 - 1)), guid FROM vectors WHERE item_id % 3 = 0)"""


@query(f"""WITH {_COPIES} SELECT c.item_id, min(p.item_id) AS duplicate_of FROM w c JOIN w p ON p.direction = c.direction AND p.item_id < c.item_id AND NOT contains(p.guid, '#v-')
  WHERE list_cosine_similarity(c.vec, p.vec) >= 0.92 GROUP BY c.item_id""")
def semantic_dup_copies(spark: SparkSession, d: str) -> DataFrame:
    """The duplicates of a table with copies of a third of its vectors, moved a little, at the production threshold."""
    v = B.vectors(spark, d).withColumn("vec", F.col("vec").cast("array<double>"))
    moved = F.transform("vec", lambda x, i: x * 2 + (F.col("item_id") % 5) * 0.02 * ((i + 1) % 3 - 1))
    copies = v.where("item_id % 3 = 0").select((F.col("item_id") + 1_000_000).alias("item_id"), "direction", moved.alias("vec"), "guid")
    rows = stored(v.unionByName(copies), "vectors-with-copies")
    return routing.semantic_duplicates(rows, rows)


@query(f"""WITH {B.VECTORS}, s AS (SELECT q.item_id AS query_id, v.item_id, list_cosine_similarity(v.vec, q.vec) AS sim FROM vectors v, vectors q WHERE q.item_id % 20 = 0), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, item_id) AS rank FROM s) SELECT query_id, item_id, rank::INT AS rank FROM r WHERE rank <= 5""")
def indexed_topk(spark: SparkSession, d: str) -> DataFrame:
    """The search of cosine_topk_every20 by a stored index of the vectors, which is written first."""
    v = B.vectors(spark, d)
    index = VectorIndex.build(v.select("item_id", "vec"))
    return index.search(v.where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "vec"), 5).select("query_id", "item_id", "rank")


@query(f"""WITH {B.ITEMS}, k AS (SELECT item_id, direction, sha256(content_text) AS fp FROM items), o AS (SELECT direction, fp, min(item_id) AS first_id FROM k GROUP BY direction, fp)
SELECT item_id, first_id AS duplicate_of FROM k JOIN o USING (direction, fp) WHERE item_id > first_id""")
def fingerprint_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Exact duplicates by an index that three rounds of ingest have filled, one of them twice."""
    rows = stored(B.items(spark, d).select("item_id", "direction", F.sha2("content_text", 256).alias("fingerprint")), "round-fingerprints")
    index = FingerprintIndex(spark, fanout=2)
    for n in (1, 0, 1, 2):
        index.add(f"round-{n}", rows.where(F.col("item_id") % 3 == n))
    found = stored(index.duplicates(rows), "round-duplicates")
    index.drop()
    return found


def _scored_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = routing.similarities(B.vectors(spark, d), B.query_vectors(spark, d))
    return rows.withColumn("quality", (F.col("item_id") * 7 % 100).cast("int")).withColumn("passed", F.col("item_id") % 3 == 0)


@query(f"""WITH {B.VECTORS}, {B.QUERY_VECTORS}, s AS (SELECT v.*, list_cosine_similarity(v.vec, q.vec) AS sim FROM vectors v JOIN query_vectors q USING (direction)), c AS (
  SELECT direction, quantile_cont(sim, 0.3) AS cut FROM s GROUP BY direction)
SELECT s.item_id, s.direction FROM s JOIN c USING (direction) WHERE s.item_id % 3 <> 0 AND s.item_id * 7 % 100 >= 50 AND s.sim <= c.cut""")
def explore_percentile_pool(spark: SparkSession, d: str) -> DataFrame:
    return routing.explore_pool(_scored_vectors(spark, d), percentile=30).select("item_id", "direction")


@query(f"""WITH {B.VECTORS}, {B.QUERY_VECTORS}, s AS (SELECT v.*, list_cosine_similarity(v.vec, q.vec) AS sim FROM vectors v JOIN query_vectors q USING (direction)), c AS (SELECT direction, quantile_cont(sim, 0.3) AS cut FROM s GROUP BY direction),
pool AS (SELECT s.direction, s.item_id, s.sim, s.vec FROM s JOIN c USING (direction) WHERE s.item_id % 3 <> 0 AND s.item_id * 7 % 100 >= 50 AND s.sim <= c.cut),
p1 AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY direction ORDER BY sim, item_id) = 1),
p2 AS (SELECT pool.* FROM pool JOIN p1 USING (direction) WHERE pool.item_id <> p1.item_id QUALIFY row_number() OVER (PARTITION BY direction ORDER BY -0.3::DOUBLE * pool.sim - 0.7::DOUBLE * list_cosine_similarity(pool.vec, p1.vec) DESC, pool.sim, pool.item_id) = 1),
p3 AS (SELECT pool.* FROM pool JOIN p1 USING (direction) JOIN p2 USING (direction) WHERE pool.item_id <> p1.item_id AND pool.item_id <> p2.item_id
  QUALIFY row_number() OVER (PARTITION BY direction ORDER BY -0.3::DOUBLE * pool.sim - 0.7::DOUBLE * greatest(list_cosine_similarity(pool.vec, p1.vec), list_cosine_similarity(pool.vec, p2.vec)) DESC, pool.sim, pool.item_id) = 1)
SELECT direction, item_id, 1 AS pick FROM p1 UNION ALL SELECT direction, item_id, 2 FROM p2 UNION ALL SELECT direction, item_id, 3 FROM p3""")
def explore_mmr(spark: SparkSession, d: str) -> DataFrame:
    return routing.explore_picks(_scored_vectors(spark, d), direction_type="int", percentile=30)


@query(f"""WITH {B.VECTORS}, t AS (SELECT item_id, vec[1:16] AS t, vec FROM vectors)
SELECT item_id, round(t[1] / sqrt(list_inner_product(t, t)), 6) AS first, round(t[16] / sqrt(list_inner_product(t, t)), 6) AS last, round(list_sum(t) / sqrt(list_inner_product(t, t)), 6) AS total,
  16 AS dims, round(list_sum(vec) / sqrt(list_inner_product(vec, vec)), 6) AS full_total FROM t""")
def truncated_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The first components, normalized again, and the whole vector normalized: sums and single components."""
    total = lambda v: F.round(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x), 6)
    t = V.truncated(F.col("vec"), 16)
    return B.vectors(spark, d).select("item_id", F.round(F.get(t, 0), 6).alias("first"), F.round(F.get(t, 15), 6).alias("last"), total(t).alias("total"), F.size(t).alias("dims"), total(V.l2_normalize(F.col("vec"))).alias("full_total"))


# ---- ranking ----


def _scored_items(spark: SparkSession, d: str) -> DataFrame:
    return B.items(spark, d).select("item_id", "url", "source_id").join(B.scores(spark, d).where("status = 'OK'"), "item_id")


@query(f"""WITH {B.ITEMS}, {B.SCORES}, best AS (SELECT i.item_id, i.source_id, s.direction, s.relevance FROM items i JOIN scores s USING (item_id) WHERE s.status = 'OK' ORDER BY s.relevance DESC, i.item_id LIMIT 200),
m AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY relevance DESC, item_id) AS k FROM best WHERE (direction = 'en' AND relevance >= 60) OR (direction = 'de' AND relevance >= 70)),
r AS (SELECT *, row_number() OVER (ORDER BY relevance DESC, item_id) AS place FROM m WHERE k <= 3)
SELECT item_id, place FROM r WHERE place <= 10""")
def domain_capped_topk(spark: SparkSession, d: str) -> DataFrame:
    readable = spark.createDataFrame([("en", 0), ("de", 70)], "direction string, threshold int")
    return ranking.domain_capped(_scored_items(spark, d), readable).select("item_id", "place")


_SLOTS = [0.05, 0.9, 0.15, 0.5, 0.19, 0.2, 0.01, 0.99, 0.1, 0.3]


@query(f"""WITH {B.SCORES}, ranked AS (SELECT item_id, row_number() OVER (ORDER BY relevance DESC, item_id) AS place FROM scores WHERE status = 'OK' AND passed QUALIFY place <= 10),
low AS (SELECT item_id, row_number() OVER (ORDER BY relevance DESC, item_id) AS place FROM scores WHERE status = 'OK' AND NOT passed AND relevance >= 40 QUALIFY place <= 3),
u AS (SELECT unnest({_SLOTS}) AS u, generate_subscripts({_SLOTS}, 1) AS place),
h AS (SELECT r.place AS slot, row_number() OVER (ORDER BY r.place) AS i FROM ranked r JOIN u USING (place) WHERE u.u < 0.2)
SELECT item_id, place AS slot, 'ranked' AS kind FROM ranked UNION ALL SELECT l.item_id, h.slot, 'low_interleaved' FROM h JOIN low l ON l.place = h.i""")
def interleave_slots(spark: SparkSession, d: str) -> DataFrame:
    s = B.scores(spark, d).where("status = 'OK'")
    page = lambda rows, n: lists.top_per_group(rows.withColumn("_g", F.lit(1)), ["_g"], [F.desc("relevance"), F.col("item_id")], n).select("item_id", F.col("rank").alias("place"))
    return ranking.interleaved(page(s.where("passed"), 10), page(s.where("NOT passed AND relevance >= 40"), 3), _SLOTS).select("item_id", F.col("slot").cast("long").alias("slot"), "kind")


@query(f"""WITH {B.ITEMS}, {B.SCORES}, r AS (SELECT i.source_id, i.item_id, s.relevance, row_number() OVER (PARTITION BY i.source_id ORDER BY s.relevance DESC, i.item_id) AS k FROM items i JOIN scores s USING (item_id) WHERE s.status = 'OK')
SELECT source_id, string_agg(item_id, ',' ORDER BY k) AS items FROM r WHERE k <= 20 GROUP BY source_id""")
def board_per_source(spark: SparkSession, d: str) -> DataFrame:
    return ranking.board(_scored_items(spark, d)).select("source_id", F.array_join(F.transform("items", lambda x: x["item_id"].cast("string")), ",").alias("items"))


@query("""WITH t AS (SELECT event_id AS topic_id, date_trunc('day', ts) AS batch, event_type AS platform, row_number() OVER (PARTITION BY date_trunc('day', ts), event_type ORDER BY event_id) AS r FROM events)
SELECT topic_id, platform FROM t WHERE batch = (SELECT max(batch) FROM t) AND r <= 5""")
def latest_batch_topics(spark: SparkSession, d: str) -> DataFrame:
    topics = B.table(spark, d, "events").select(F.col("event_id").alias("topic_id"), F.to_date("ts").alias("batch"), F.col("event_type").alias("platform"), F.col("event_id").alias("rank"))
    return ranking.latest_batch(topics, 5).select("topic_id", "platform")


@query(f"""WITH {B.SCORES}, r AS (SELECT item_id, direction, row_number() OVER (PARTITION BY direction ORDER BY relevance DESC, item_id) AS k FROM scores)
SELECT item_id, direction, ceil(k / 16)::INT AS chunk FROM r WHERE k <= 30""")
def rank_request_chunks(spark: SparkSession, d: str) -> DataFrame:
    s = lists.top_per_group(B.scores(spark, d).select("item_id", "direction", "relevance"), ["direction"], [F.desc("relevance"), F.col("item_id")], 100).withColumnRenamed("rank", "place")
    rows = s.join(B.items(spark, d).select("item_id", "title", "content_text"), "item_id")
    return ranking.rank_requests(rows).select("item_id", "direction", "chunk")


@query("""WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) SELECT conv_id, turn, role, k::INT AS place FROM r WHERE k <= 3""")
def recent_memory(spark: SparkSession, d: str) -> DataFrame:
    return ranking.recent(B.table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", 3)


@query(f"""WITH {B.SCORES}, b AS (SELECT item_id, CASE WHEN relevance >= 75 THEN 'high' WHEN relevance >= 25 THEN 'mid' ELSE 'low' END AS band FROM scores), k AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY md5('7:' || item_id), item_id) AS k FROM b)
SELECT item_id, band FROM k WHERE k <= CASE band WHEN 'high' THEN 15 WHEN 'mid' THEN 10 ELSE 5 END""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = B.scores(spark, d).withColumn("band", lists.rank_band(F.col("relevance")))
    return ranking.stratified(rows, "band", {"high": 15, "mid": 10, "low": 5}, seed=7).select("item_id", "band")


@query()
def text_slices(spark: SparkSession, d: str) -> DataFrame:
    texts = B.table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("file"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return ranking.slices(texts, ["the", "de", "die"])


@query()
def text_slices_sql(spark: SparkSession, d: str) -> DataFrame:
    """The same by SQL text, with the table function; tested against it."""
    tables.register(spark)
    texts = B.table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("file"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return spark.sql("SELECT * FROM slices(TABLE({texts}) PARTITION BY (file), array('the', 'de', 'die')) ORDER BY score DESC, file, i, n LIMIT 30", texts=texts)


@query("""SELECT doc_id, 1 AS k, doc_id + 2 AS item_id, source || ' again' AS quote FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, 1, doc_id, source FROM documents WHERE doc_id % 2 = 1 UNION ALL SELECT doc_id, 2, doc_id + 1, coalesce(lang, '') FROM documents""")
def footnote_rows(spark: SparkSession, d: str) -> DataFrame:
    """The notes of a draft of every document by SQL text, with the lateral table function; the last of a number counts."""
    tables.register(spark)
    note = lambda k, more, quote: F.concat(F.lit(f"\n[^{k}]: [条目 "), (F.col("doc_id") + more).cast("string"), F.lit("] "), quote)
    again = F.when(F.col("doc_id") % 2 == 0, note(1, 2, F.concat("source", F.lit(" again ")))).otherwise("")
    drafts = B.table(spark, d, "documents").select("doc_id", F.concat(F.lit("a[^1] b[^2]"), note(1, 0, F.col("source")), note(2, 1, F.coalesce("lang", F.lit(""))), again).alias("text"))
    return spark.sql("SELECT doc_id, n.* FROM {drafts}, LATERAL footnotes(text) AS n", drafts=drafts)


# ---- hot topics and gates ----


@query(f"""WITH {B.ITEMS}, t AS (SELECT item_id, regexp_extract_all(title, '([0-9A-Za-z_]+|[一-鿿]{{2,}})', 1) AS ws FROM items), w AS (
  SELECT item_id, lower(unnest(ws)) AS keyword, generate_subscripts(ws, 1) AS pos FROM t), k AS (
  SELECT keyword, count(*) AS n, min(item_id * 1000000 + pos) AS f FROM w WHERE length(keyword) > 1 AND NOT regexp_matches(keyword, '^[0-9]+$')
    AND keyword NOT IN ('the','and','for','with','from','that','this','are','was','were','have','has','will','your','you') GROUP BY keyword)
SELECT keyword, n, row_number() OVER (ORDER BY n DESC, f)::INT AS rank FROM k ORDER BY n DESC, f LIMIT 15""")
def keyword_top15(spark: SparkSession, d: str) -> DataFrame:
    return hot.keywords(B.items(spark, d).select("item_id", "title"), ["item_id"])


@query("""SELECT date_trunc('day', ts)::DATE AS batch, event_type AS platform, count(*) AS n FROM events GROUP BY ALL""")
def hot_batch_counts(spark: SparkSession, d: str) -> DataFrame:
    topics = B.table(spark, d, "events").select(F.to_date("ts").alias("batch"), F.col("event_type").alias("platform"))
    return hot.batch_counts(topics).select("batch", F.explode("platforms").alias("platform", "n"))


def _drafts(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "documents").select(F.col("doc_id").alias("draft_id"), "text", T.first_line(F.col("text")).alias("title"), F.col("lang").alias("author_id"))


@query("""WITH n AS (SELECT doc_id, lower(regexp_replace(text, '\\s+', '', 'g')) AS t FROM documents), c AS (SELECT lower(regexp_replace(text, '\\s+', '', 'g')) AS t FROM benchmark),
p AS (SELECT doc_id, substr(t, (k * 500 + 1)::BIGINT, 539) AS t FROM (SELECT doc_id, t, unnest(range(0, length(t) // 500 + 1)) AS k FROM n)),
g AS (SELECT DISTINCT doc_id, substr(t, i::BIGINT, 40) AS s FROM (SELECT doc_id, t, unnest(range(1, length(t) - 38)) AS i FROM p)),
b AS (SELECT DISTINCT substr(t, i::BIGINT, 40) AS s FROM (SELECT t, unnest(range(1, length(t) - 38)) AS i FROM c))
SELECT d.doc_id AS draft_id, count(b.s) AS hits, CASE WHEN count(b.s) >= 2 THEN 'issue' WHEN count(b.s) = 1 THEN 'warn' ELSE 'pass' END AS level
FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id LEFT JOIN b ON b.s = g.s GROUP BY d.doc_id""")
def shared_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return gates.shared_ngrams(_drafts(spark, d), B.table(spark, d, "benchmark").select("text"), n=40)


@query("""WITH n AS (SELECT doc_id, lang, lower(regexp_replace(split_part(text, chr(10), 1), '\\s+', '', 'g')) AS t FROM documents), r AS (SELECT lang, doc_id AS place, t AS u FROM n QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 5),
p AS (SELECT n.doc_id, r.place, t, u, list_distinct(list_transform(range(1, length(t)), lambda i: substr(t, i, 2))) AS a, list_distinct(list_transform(range(1, length(u)), lambda i: substr(u, i, 2))) AS b FROM n JOIN r USING (lang) WHERE t <> '' AND u <> ''),
s AS (SELECT doc_id, place, t = u AS same, CASE WHEN length(t) < 2 OR length(u) < 2 THEN (t = u)::INT::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) END AS dice FROM p)
SELECT doc_id AS draft_id, min(place) AS recent_place, arg_min(same, place) AS same, arg_min(dice, place) AS dice FROM s WHERE same OR dice >= 0.55 GROUP BY doc_id""")
def topic_repeats(spark: SparkSession, d: str) -> DataFrame:
    rows = _drafts(spark, d)
    recent = ranking.recent(rows.select("author_id", F.col("title").alias("recent_title"), (-F.col("draft_id")).alias("o")), "author_id", "o", 5).select("author_id", "recent_title", (-F.col("o")).alias("place"))
    return gates.topic_repeats(rows.select("draft_id", "author_id", "title"), recent)


@query("""WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[。！？!?；;\\n]')) AS s FROM documents), l AS (SELECT doc_id, length(regexp_replace(s, '\\s+', '', 'g')) AS n FROM s WHERE length(trim(s, ' ' || chr(9) || chr(13))) > 1)
SELECT doc_id AS draft_id, count(*)::INT AS sentences, sum(n)::BIGINT AS chars, round(stddev_pop(n), 6) AS sigma FROM l GROUP BY doc_id HAVING count(*) >= 5""")
def rhythm_sentences(spark: SparkSession, d: str) -> DataFrame:
    lengths = T.sentence_lengths(F.col("text"))
    rows = _drafts(spark, d).select("draft_id", lengths.alias("l"), T.rhythm_stddev(F.col("text")).alias("sigma"))
    return rows.where("sigma IS NOT NULL").select("draft_id", F.size("l").alias("sentences"), F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + x).alias("chars"), F.round("sigma", 6).alias("sigma"))


@query("""SELECT doc_id AS draft_id, length(regexp_replace(text, '\\s+', '', 'g'))::INT AS chars, length(regexp_replace(text, '\\s+', '', 'g')) NOT BETWEEN 100 AND 5000 AS bad,
  (contains(regexp_replace(text, '\\s+', '', 'g'), 'tion')::INT + contains(regexp_replace(text, '\\s+', '', 'g'), 'ung')::INT + contains(regexp_replace(text, '\\s+', '', 'g'), 'zzz')::INT) AS hits FROM documents""")
def length_and_style(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    rows = _drafts(spark, d).select("draft_id", gates.length_issue(t, 100, 5000).alias("g"), F.size(gates.style_hits(t, ["tion", "ung", "zzz"])).alias("hits"))
    return rows.select("draft_id", "g.chars", F.col("g.issue").isNotNull().alias("bad"), "hits")


_NOTED = """noted AS (SELECT d.doc_id, d.lang, d.text, CASE WHEN d.doc_id % 4 = 0 THEN regexp_replace(coalesce(CASE WHEN d.doc_id % 8 = 4 THEN o.text ELSE d.text END, ''), '[\\[\\]\\s]+', '', 'g')[1:15] END AS quote
  FROM documents d LEFT JOIN documents o ON o.doc_id = d.doc_id + 1)"""


@query(f"""WITH {_NOTED}, bare AS (SELECT doc_id, lang, quote, regexp_replace(text, '\\s+', '', 'g') AS c, lower(regexp_replace(text, '\\s+', '', 'g')) AS t FROM noted),
style AS (SELECT *, contains(c, 'tion')::INT + contains(c, 'ung')::INT + contains(c, 'en')::INT AS hits FROM bare),
low AS (SELECT lower(regexp_replace(text, '\\s+', '', 'g')) AS t FROM benchmark), b AS (SELECT DISTINCT substr(t, i::BIGINT, 40) AS s FROM (SELECT t, unnest(range(1, length(t) - 38)) AS i FROM low)),
g AS (SELECT DISTINCT doc_id, substr(t, i::BIGINT, 40) AS s FROM (SELECT doc_id, t, unnest(range(1, length(t) - 38)) AS i FROM bare)),
shared AS (SELECT doc_id, count(*) AS n FROM g JOIN b USING (s) GROUP BY doc_id),
heads AS (SELECT doc_id, lang, lower(regexp_replace(split_part(text, chr(10), 1), '\\s+', '', 'g')) AS t FROM documents), r AS (SELECT lang, doc_id AS place, t AS u FROM heads QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 5),
p AS (SELECT heads.doc_id, r.place, t, u, list_distinct(list_transform(range(1, length(t)), lambda i: substr(t, i, 2))) AS a, list_distinct(list_transform(range(1, length(u)), lambda i: substr(u, i, 2))) AS b FROM heads JOIN r USING (lang) WHERE t <> '' AND u <> '' AND r.place <> heads.doc_id),
topics AS (SELECT doc_id, min(place) AS place FROM p WHERE t = u OR (length(t) >= 2 AND length(u) >= 2 AND 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) >= 0.55) GROUP BY doc_id),
said AS (SELECT s.doc_id, CASE WHEN length(c) < 100 THEN 'length:' || length(c) || ' < 100' WHEN length(c) > 5000 THEN 'length:' || length(c) || ' > 5000' END AS i1, CASE WHEN hits < 2 THEN 'style:' || hits || ' of 2' END AS i2,
  CASE WHEN quote IS NULL THEN 'citation:too_few:0' WHEN quote = '' THEN 'citation:empty_quote:1' WHEN NOT contains(t, lower(quote)) THEN 'citation:quote_not_found:1' END AS i3,
  CASE WHEN n >= 2 THEN 'copyright:' || n || ' shared' END AS i4, CASE WHEN place IS NOT NULL THEN 'topic:as ' || place END AS i5, CASE WHEN n = 1 THEN 'copyright:1 shared' ELSE '' END AS warns
  FROM style s LEFT JOIN shared USING (doc_id) LEFT JOIN topics USING (doc_id))
SELECT doc_id AS draft_id, coalesce(i1, i2, i3, i4, i5) IS NULL AS passed, array_to_string(list_filter([i1, i2, i3, i4, i5], lambda x: x IS NOT NULL), ',') AS issues, warns FROM said""")
def gate_run(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a draft through all gates: bounds of length, style words, notes of which some quote another
    document, n-grams shared with the benchmark, and titles of the author's first five others."""
    docs = B.table(spark, d, "documents").select("doc_id", "lang", "text")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("_other"))
    n = F.col("doc_id")
    source = F.when(n % 8 == 4, F.coalesce("_other", F.lit(""))).otherwise(F.coalesce("text", F.lit("")))
    quote = F.substring(F.regexp_replace(source, r"[\[\]\s]+", ""), 1, 15)
    note = F.when(n % 4 == 0, F.concat(F.lit("[^1]\n[^1]: [条目 "), n.cast("string"), F.lit("] "), quote)).otherwise("")
    drafts = stored(docs.join(after, "doc_id", "left").select(n.alias("draft_id"), F.col("lang").alias("author_id"), T.first_line(F.col("text")).alias("title"), F.concat(F.col("text"), note).alias("text")), "drafts")
    reading = docs.select(n.alias("draft_id"), n.alias("item_id"), F.col("text").alias("content_text"))
    titles = drafts.select("author_id", F.col("title").alias("recent_title"), (-F.col("draft_id")).alias("o"))
    recent = stored(ranking.recent(titles, "author_id", "o", 5).select("author_id", "recent_title", (-F.col("o")).alias("place")), "recent-titles")
    # a draft is no repeat of itself: those among the first five meet the others of them by author and place
    places = recent.select("author_id", F.col("place").alias("draft_id")).distinct()
    key = lambda own: F.when(F.col("author_id").isNotNull(), F.struct("author_id", own.cast("long").alias("own")))
    others = places.join(recent, "author_id").where("place <> draft_id").withColumn("author_id", key(F.col("draft_id")))
    known = recent.withColumn("author_id", key(F.lit(None))).unionByName(others.drop("draft_id"))
    marked = drafts.join(places.withColumn("_own", F.col("draft_id")), ["author_id", "draft_id"], "left")
    drafts = marked.select("draft_id", key(F.col("_own")).alias("author_id"), "title", "text")
    args = {"low": 100, "high": 5000, "words": ["tion", "ung", "en"], "min_hits": 2, "n": 40}
    rows = gates.gate_run(drafts, reading, B.table(spark, d, "benchmark").select("text"), known, **args)
    return rows.select("draft_id", "passed", F.array_join("issues", ",").alias("issues"), F.array_join("warns", ",").alias("warns"))


@query("""WITH b AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS k, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '' AND NOT starts_with(x, '【') AND NOT starts_with(x, '（续') AND NOT starts_with(x, '(')) AS lines FROM benchmark),
a AS (SELECT k, array_to_string(lines, '') AS a FROM b), c AS (SELECT conv_id, turn, regexp_replace(text, '\\s+', '', 'g') AS t, conv_id % (SELECT count(*) FROM a) AS k FROM conversations),
p AS (SELECT conv_id, turn, k, unnest(string_split(t, '')) AS x, generate_subscripts(string_split(t, ''), 1) AS i FROM c), q AS (SELECT k, unnest(string_split(a, '')) AS x, generate_subscripts(string_split(a, ''), 1) AS j FROM a),
m AS (SELECT conv_id, turn, i - j AS diagonal, i - row_number() OVER (PARTITION BY conv_id, turn, i - j ORDER BY i) AS island FROM p JOIN q USING (k, x)),
n AS (SELECT conv_id, turn, count(*) AS n FROM m GROUP BY conv_id, turn, diagonal, island)
SELECT c.conv_id, c.turn, coalesce(max(n.n), 0)::INT AS echo_max_chars FROM c LEFT JOIN n ON n.conv_id = c.conv_id AND n.turn = c.turn GROUP BY c.conv_id, c.turn""")
def echo_lengths(spark: SparkSession, d: str) -> DataFrame:
    """The longest stretch that a turn has in common with the anchor of its conversation."""
    # the n-th conversation id modulo the number of anchors has the n-th anchor, so that each anchor is used; only ids are numbered in one task
    items = B.table(spark, d, "benchmark")
    places = items.select("item_id").distinct().select("item_id", (F.row_number().over(Window.orderBy("item_id")) - 1).cast("long").alias("k"))
    anchors = items.select("item_id", gates.echo_source(F.col("text")).alias("a")).join(places, "item_id")
    count = places.agg(F.count("*").alias("_n"))
    rows = B.table(spark, d, "conversations").select("conv_id", "turn", T.clean_text(F.col("text")).alias("t")).join(F.broadcast(count)).withColumn("k", F.pmod(F.col("conv_id").cast("long"), F.col("_n")))
    return rows.join(anchors, "k").select("conv_id", "turn", gates.longest_common(F.col("t"), F.col("a")).alias("echo_max_chars"))


# ---- limits and health ----


@query(f"""WITH {B.USAGE}, m AS (SELECT *, row_number() OVER (PARTITION BY provider, date_trunc('minute', ts) ORDER BY ts, call_id) <= 1 AS a FROM usage)
SELECT call_id, a AND row_number() OVER (PARTITION BY provider, date_trunc('day', ts), a ORDER BY ts, call_id) <= 20 AS allowed FROM m""")
def search_quota(spark: SparkSession, d: str) -> DataFrame:
    return limits.search_quota(B.usage(spark, d), per_minute=1, per_day=20).select("call_id", "allowed")


@query("""SELECT event_id AS attempt_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW)
  - (row_number() OVER (PARTITION BY event_type, ts ORDER BY event_id DESC) - 1) AS spent FROM events""")
def retry_budget_60s(spark: SparkSession, d: str) -> DataFrame:
    rows = B.table(spark, d, "events").select(F.col("event_type").alias("caller"), "ts", F.col("event_id").alias("attempt_id"))
    return limits.retry_budget(rows).select("attempt_id", "spent")


@query(f"""WITH {B.USAGE}, r AS (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY call_id DESC) AS k FROM usage)
SELECT platform, count(*) = 3 AND NOT bool_or(ok) AND max(ts) FILTER (WHERE k = 1) > {TS} - INTERVAL 1440 MINUTES AS cooling FROM r WHERE k <= 3 GROUP BY platform""")
def cooldown_last3(spark: SparkSession, d: str) -> DataFrame:
    return limits.platform_cooldown(B.usage(spark, d), B.now(), minutes=1440)


@query("""SELECT event_id AS request_id, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) <= 1 AS allowed FROM events""")
def hourly_limit(spark: SparkSession, d: str) -> DataFrame:
    rows = B.table(spark, d, "events").select(F.col("user_id").alias("ip"), "ts", F.col("event_id").alias("request_id"))
    return limits.hourly_limited(rows, 1).select("request_id", "allowed")


@query(f"""WITH {B.TASKS} SELECT task_id, CASE WHEN status = 'RUNNING' AND {TS} - updated_at > CASE kind WHEN 'fetch' THEN INTERVAL 30 MINUTES WHEN 'score' THEN INTERVAL 60 MINUTES ELSE INTERVAL 120 MINUTES END THEN 'PENDING' ELSE status END AS status FROM tasks""")
def stale_tasks(spark: SparkSession, d: str) -> DataFrame:
    return limits.reclaimed(B.tasks(spark, d), B.now(), {"fetch": 30, "score": 60, "write": 120}).select("task_id", "status")


@query("""WITH RECURSIVE e AS (SELECT 'h' || (user_id % 7) AS netloc, event_id AS request_id, epoch_us(ts) / 1e6::DOUBLE AS at, row_number() OVER (PARTITION BY user_id % 7 ORDER BY epoch_us(ts), event_id) AS k FROM events),
w(netloc, k, request_id, slot, wait, accepted) AS (
  SELECT netloc, 0::BIGINT, NULL::BIGINT, -1e18::DOUBLE, 0.0::DOUBLE, false FROM e GROUP BY netloc UNION ALL
  SELECT w.netloc, e.k, e.request_id, CASE WHEN greatest(w.slot + 2400, e.at) - e.at <= 9000 THEN greatest(w.slot + 2400, e.at) ELSE w.slot END, greatest(w.slot + 2400, e.at) - e.at, greatest(w.slot + 2400, e.at) - e.at <= 9000 FROM w JOIN e ON e.netloc = w.netloc AND e.k = w.k + 1)
SELECT netloc, request_id, round(wait, 3) AS wait, accepted FROM w WHERE k > 0""")
def throttle_slots(spark: SparkSession, d: str) -> DataFrame:
    rows = B.table(spark, d, "events").select(F.concat(F.lit("h"), (F.col("user_id") % 7).cast("string")).alias("netloc"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("event_id").alias("request_id"))
    return limits.throttled(rows, gap_s=2400.0, max_wait_s=9000.0).withColumn("wait", F.round("wait", 3))


@query("""WITH RECURSIVE e AS (SELECT user_id % 4 AS article_id, event_id AS feedback_id, 'v' || (event_id % 300) AS visitor, ((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Shanghai')::DATE AS day, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) AS k FROM events),
w(article_id, k, feedback_id, seen, day, used, outcome) AS (
  SELECT article_id, 0::BIGINT, NULL::BIGINT, []::VARCHAR[], NULL::DATE, 0, NULL::VARCHAR FROM e GROUP BY article_id UNION ALL
  SELECT article_id, k, feedback_id, CASE WHEN outcome = 'counted' THEN list_append(seen, visitor) ELSE seen END, day, CASE WHEN outcome = 'counted' THEN used + 1 ELSE used END, outcome FROM (
    SELECT *, CASE WHEN list_contains(seen, visitor) THEN 'already_counted' WHEN used >= 5 THEN 'rate_limited' ELSE 'counted' END AS outcome FROM (
      SELECT e.article_id, e.k, e.feedback_id, e.visitor, e.day, w.seen, CASE WHEN w.day = e.day THEN w.used ELSE 0 END AS used FROM w JOIN e ON e.article_id = w.article_id AND e.k = w.k + 1)))
SELECT article_id, feedback_id, outcome FROM w WHERE k > 0""")
def article_reactions(spark: SparkSession, d: str) -> DataFrame:
    rows = B.table(spark, d, "events").select((F.col("user_id") % 4).alias("article_id"), F.col("event_id").alias("feedback_id"), F.concat(F.lit("v"), (F.col("event_id") % 300).cast("string")).alias("visitor"), F.col("ts").cast("timestamp").alias("ts"))
    return limits.reactions(rows, daily=5)


_NOTICES = """n AS (SELECT event_id AS seq, 'a' || (user_id % 3) AS account, event_type AS category, 'k' || (user_id % 50) AS dedupe_key, ts AS happened, user_id % 3 AS priority,
  CASE WHEN event_type = 'view' THEN 'digest' ELSE 'alert' END AS family FROM events)"""


def _notices(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("user_id")
    return B.table(spark, d, "events").select(
        F.col("event_id").alias("seq"), F.concat(F.lit("a"), (n % 3).cast("string")).alias("account"), F.col("event_type").alias("category"), F.concat(F.lit("k"), (n % 50).cast("string")).alias("dedupe_key"),
        F.col("ts").cast("timestamp").alias("at"), (n % 3).alias("priority"), F.when(F.col("event_type") == "view", "digest").otherwise("alert").alias("family"),
    )


@query(f"""WITH {_NOTICES}, s AS (SELECT category, dedupe_key, max(happened) AS sent FROM n WHERE seq % 7 = 0 GROUP BY ALL), q AS (SELECT DISTINCT category, dedupe_key FROM n WHERE seq % 97 = 0)
SELECT n.seq, CASE WHEN epoch(date_trunc('second', n.happened)) - epoch(date_trunc('second', s.sent)) < 86400 OR q.category IS NOT NULL THEN 'deduped' ELSE 'queued' END AS outcome
FROM n LEFT JOIN s USING (category, dedupe_key) LEFT JOIN q USING (category, dedupe_key)""")
def notice_dedupe(spark: SparkSession, d: str) -> DataFrame:
    n = _notices(spark, d)
    sent = n.where("seq % 7 = 0").select("category", "dedupe_key", F.col("at").alias("sent_at"))
    return limits.notice_dedupe(n, sent, n.where("seq % 97 = 0")).select("seq", "outcome")


@query(f"""WITH {_NOTICES} SELECT seq, row_number() OVER (PARTITION BY account ORDER BY CASE WHEN family = 'digest' THEN 1 ELSE 0 END, priority, seq) > 10 AS dropped FROM n""")
def notice_overflow(spark: SparkSession, d: str) -> DataFrame:
    return limits.queue_overflow(_notices(spark, d)).select("seq", "dropped")


@query(f"""WITH {_NOTICES} SELECT account, min(seq) AS seq FROM n WHERE account <> 'a1' AND category <> 'click' GROUP BY account""")
def notice_deliverable(spark: SparkSession, d: str) -> DataFrame:
    at = lambda s: B.now() - F.expr(f"INTERVAL {s} SECONDS")
    accounts = spark.range(1).select(F.explode(F.array(F.struct(F.lit("a1").alias("account"), at(59).alias("last_sent")), F.struct(F.lit("a2").alias("account"), at(60).alias("last_sent")))).alias("x")).select("x.*")
    categories = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(c).alias("category"), at(s).alias("last_sent"), F.lit(i).alias("min_interval_s")) for c, s, i in (("click", 10, 3600), ("view", 10, 0), ("error", 3600, 3600))])).alias("x")).select("x.*")
    return limits.deliverable(_notices(spark, d), accounts, categories, B.now())


def _rounds(spark: SparkSession, d: str) -> DataFrame:
    """events as rounds of sources."""
    e, n = B.table(spark, d, "events"), F.col("event_id")
    bad = F.col("event_type") == "error"
    return e.select(
        (F.col("user_id") % 20).alias("source_id"), n.alias("round_id"), F.when(F.col("user_id") % 5 == 0, "search").when(F.col("user_id") % 5 == 1, "web").otherwise("rss").alias("kind"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("now"),
        F.when(bad, F.when(n % 3 == 0, "http 404").when(n % 3 == 1, "timeout").otherwise("non_xml_response: html")).alias("error"), F.when(bad & (n % 3 == 0), 404).cast("int").alias("http_status"),
        F.when(F.col("event_type") == "view", 0).otherwise(n % 5).cast("int").alias("feed_entries"), F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("inserted"), (F.col("event_type") == "signup").alias("not_modified"),
        (n % 17 == 0).alias("rate_limited"), F.when(n % 34 == 0, 120.0).alias("retry_after"), (n % 23 == 0).alias("skip_day"), (n % 29 == 0).alias("quota_blocked"),
    )


@query()
def health_machine(spark: SparkSession, d: str) -> DataFrame:
    return health.health_after(_rounds(spark, d))


@query()
def health_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Rounds and alarms of every source up to the moment of the queries; the stream is tested against it."""
    return health.health_timeline(_rounds(spark, d), datetime.fromisoformat(B.NOW + "+00:00").timestamp()).select("source_id", "at", "round_id", "notice", "failure_level", "rate_limited_until")


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """supplier as sources of every state."""
    n = F.col("s_suppkey")
    at = lambda days: (B.now() - F.make_dt_interval(days))
    return B.table(spark, d, "supplier").select(
        n.alias("source_id"), (n % 11 != 0).alias("enabled"), F.when(n % 13 == 0, "expired").otherwise("active").alias("direction_status"), F.when(n % 7 == 0, at((n % 3).cast("int")) + F.expr("INTERVAL 1 DAY")).alias("rate_limited_until"),
        F.when(n % 9 == 0, B.now() + F.expr("INTERVAL 1 HOUR")).alias("keyword_limited_until"), F.when(n % 5 == 0, "hard_failed").when(n % 5 == 1, "suspect").otherwise("none").alias("failure_level"), F.when(n % 5 <= 1, at((n % 20).cast("int"))).alias("failure_since"),
        F.lit(None).cast("timestamp").alias("last_probe_at"), (n % 8).cast("int").alias("backoff_skips"), (n % 6).cast("int").alias("backoff_failures"), F.lit(60).alias("interval_minutes"), (n % 6).cast("int").alias("zero_gain_level"), (B.now() - F.expr("INTERVAL 5 HOURS")).alias("last_fetched_at"),
    )


@query(f"""WITH s AS (SELECT s_suppkey AS n FROM supplier), x AS (SELECT n, CASE WHEN n % 5 <= 1 THEN {TS} - (n % 20)::INT * INTERVAL 1 DAY END AS since FROM s),
due AS (SELECT n FROM x WHERE n % 5 = 0 AND since <= {TS} - INTERVAL 7 DAYS ORDER BY since, n LIMIT 5)
SELECT n AS source_id, CASE WHEN n IN (SELECT n FROM due) THEN 'dead_probe' WHEN n % 11 = 0 THEN 'disabled' WHEN n % 13 = 0 THEN 'direction_expired' WHEN n % 7 = 0 AND n % 3 = 0 THEN 'rate_limited'
  WHEN n % 9 = 0 THEN 'keyword_exhausted' WHEN n % 5 = 0 THEN 'hard_failed' WHEN n % 5 = 1 THEN CASE WHEN n % 8 % 4 = 0 THEN 'probe' ELSE 'suspect_probe' END
  WHEN n % 6 >= 3 THEN CASE WHEN n % 8 % 4 = 0 THEN 'probe' ELSE 'backoff' END WHEN 300 < 60 * 2 ** least(n % 6, 4) THEN 'interval_not_due:' || (60 * 2 ** least(n % 6, 4))::INT || 'm' END AS reason FROM x""")
def fetch_round_plan(spark: SparkSession, d: str) -> DataFrame:
    return health.plan_round(_sources(spark, d), B.now()).select("source_id", "reason")


# ---- evaluation ----


def _query_sims(spark: SparkSession, d: str) -> DataFrame:
    rows = routing.similarities(B.vectors(spark, d), B.query_vectors(spark, d))
    return rows.select(F.col("direction").alias("query_id"), "item_id", "sim")


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.ranked(_query_sims(spark, d), "query_id", "sim", "item_id")


_RANKED = f"""{B.VECTORS}, {B.QUERY_VECTORS}, s AS (SELECT v.direction AS query_id, v.item_id, list_cosine_similarity(v.vec, q.vec) AS sim FROM vectors v JOIN query_vectors q USING (direction)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, item_id) AS rank FROM s)"""


@query(f"""WITH {_RANKED} SELECT query_id, count(*) AS n_positive, count(*) FILTER (WHERE rank <= 5)::DOUBLE / count(*) AS recall_5, count(*) FILTER (WHERE rank <= 10)::DOUBLE / count(*) AS recall_10,
  min(rank) AS best FROM ranked WHERE item_id % 3 = 0 GROUP BY query_id""")
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    ranked = _ranked(spark, d)
    positives = ranked.where("item_id % 3 = 0").select("query_id", "item_id")
    best = ranked.where("item_id % 3 = 0").groupBy("query_id").agg(F.min("rank").cast("long").alias("best"))
    return evaluation.retrieval(ranked, positives).drop("mrr").join(best, "query_id")


@query(f"""WITH {_RANKED}, p AS (SELECT * FROM s WHERE item_id % 3 = 0), n AS (SELECT * FROM s WHERE item_id % 3 <> 0)
SELECT p.query_id, sum(CASE WHEN p.sim > n.sim THEN 1.0 WHEN p.sim = n.sim THEN 0.5 ELSE 0 END)::DOUBLE / count(*) AS auc FROM p JOIN n USING (query_id) GROUP BY p.query_id""")
def auc_by_query(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.auc(_query_sims(spark, d).withColumn("positive", F.col("item_id") % 3 == 0), score="sim")


@query(f"""WITH {_RANKED} SELECT query_id, avg(1.0::DOUBLE / rank) AS mrr FROM ranked WHERE item_id % 3 = 0 GROUP BY query_id""")
def mrr_by_query(spark: SparkSession, d: str) -> DataFrame:
    ranked = _ranked(spark, d)
    return evaluation.retrieval(ranked, ranked.where("item_id % 3 = 0").select("query_id", "item_id")).select("query_id", "mrr")


@query(f"""WITH {B.SCORES}, r AS (SELECT direction, row_number() OVER (PARTITION BY direction ORDER BY relevance, item_id)::DOUBLE AS x, row_number() OVER (PARTITION BY direction ORDER BY quality, item_id)::DOUBLE AS y FROM scores)
SELECT direction, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(corr(x, y), 9) END AS rho FROM r GROUP BY direction""")
def spearman_by_direction(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.spearman(B.scores(spark, d), "relevance", "quality", "direction", "item_id").withColumn("rho", F.round("rho", 9))


@query(f"""WITH {B.SCORES}, b AS (SELECT direction, CASE WHEN relevance >= 75 THEN 'high' WHEN relevance >= 25 THEN 'mid' ELSE 'low' END AS x, CASE WHEN quality >= 75 THEN 'high' WHEN quality >= 25 THEN 'mid' ELSE 'low' END AS y FROM scores)
SELECT direction, count(*) AS n, count(*) FILTER (WHERE x = y)::DOUBLE / count(*) AS agreement FROM b GROUP BY direction""")
def band_agreement(spark: SparkSession, d: str) -> DataFrame:
    rows = B.scores(spark, d).withColumn("x", lists.rank_band(F.col("relevance"))).withColumn("y", lists.rank_band(F.col("quality")))
    return evaluation.agreement(rows, "x", "y", "direction")


# ---- time and windows ----


@query("""SELECT event_id, strftime((date_trunc('day', (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Shanghai') AT TIME ZONE 'Asia/Shanghai') AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS day_start,
  strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Shanghai', '%Y-%m-%d') AS local_date FROM events""")
def local_days(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return B.table(spark, d, "events").select("event_id", F.date_format(D.local_day_start(ts, "Asia/Shanghai"), "yyyy-MM-dd HH:mm:ss").alias("day_start"), D.local_date_key(ts, "Asia/Shanghai").alias("local_date"))


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def tumbling_events(spark: SparkSession, d: str) -> DataFrame:
    return windows.tumbling(B.table(spark, d, "events")).select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_events(spark: SparkSession, d: str) -> DataFrame:
    return windows.sessions(B.table(spark, d, "events")).select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")
