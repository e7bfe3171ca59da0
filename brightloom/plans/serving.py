"""Queries over lists, ledgers, health, routing, ranking, gates, limits and evaluation beside those of the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.functions import dates as D
from brightloom.functions import text as T
from brightloom.functions import vectors as V
from brightloom.operators import evaluation, gates, health, ledger, limits, ranking, routing
from brightloom.operators import items as lists
from brightloom.operators.taskboard import TaskBoard
from brightloom.plans import base as B
from brightloom.plans.catalog import TS, query


def _joined(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _table(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# ---- lists ----


@query(f"""WITH {B.ITEMS}, {B.SCORES} SELECT i.item_id, length(i.content_text)::INT AS content_chars, s.score_id, s.relevance FROM items i LEFT JOIN scores s USING (item_id)""")
def item_scores_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """Items with every score they have, in any direction."""
    return lists.item_list(B.items(spark, d), B.scores(spark, d), fan_out=True).select("item_id", "content_chars", "score_id", "relevance")


def _articles(spark: SparkSession, d: str) -> DataFrame:
    """orders as articles of customers; lines are their citations."""
    cited = B.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_partkey").alias("item_id"))).alias("citations"))
    o = B.table(spark, d, "orders").join(cited, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select(F.col("o_orderkey").alias("article_id"), F.col("o_custkey").alias("author_id"), F.col("o_orderpriority").alias("title"), (F.col("o_orderstatus") == "F").alias("bookmarked"), (F.col("o_orderkey") % 2 == 0).alias("public"), "citations")


def _authors(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "customer").select(F.col("c_custkey").alias("author_id"), F.col("c_name").alias("name"), (F.col("c_custkey") % 3 == 0).alias("visible"))


@query("""WITH a AS (SELECT o.*, c_name FROM orders o JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F')
SELECT o_orderkey AS article_id, o_custkey AS author_id, c_name AS author_name, o_orderpriority AS title, true AS bookmarked, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey)::INT AS citations, (SELECT count(*) FROM a) AS total
FROM a ORDER BY o_orderkey DESC LIMIT 200 OFFSET 3""")
def article_list(spark: SparkSession, d: str) -> DataFrame:
    """A page of bookmarked articles with the total; the limit of 500 is clamped to 200."""
    return lists.article_list(_articles(spark, d), _authors(spark, d), bookmarked=True, limit=500, offset=3)


@query("""SELECT o_orderkey AS article_id, c_name AS author_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 2 = 0 AND c_custkey % 3 = 0""")
def visible_articles(spark: SparkSession, d: str) -> DataFrame:
    return lists.visible_articles(_articles(spark, d), _authors(spark, d)).select("article_id", "author_name")


@query("""WITH r AS (SELECT event_id % 50 AS article_id, 'v' || event_id AS visitor, CASE event_type WHEN 'view' THEN 'like' WHEN 'click' THEN 'dislike' ELSE 'comment' END AS verdict FROM events WHERE event_id % 50 < 40)
SELECT a.article_id, count(*) FILTER (WHERE verdict = 'like') AS likes, count(*) FILTER (WHERE verdict = 'dislike') AS dislikes, max(CASE WHEN visitor = 'v107' AND verdict <> 'comment' THEN verdict END) AS viewer_reacted
FROM (SELECT DISTINCT event_id % 50 AS article_id FROM events) a LEFT JOIN r USING (article_id) GROUP BY a.article_id""")
def article_reaction_counts(spark: SparkSession, d: str) -> DataFrame:
    """Likes and dislikes of every article, also of those without any, and the viewer's own reaction."""
    e, n = B.table(spark, d, "events"), F.col("event_id")
    verdict = F.when(F.col("event_type") == "view", "like").when(F.col("event_type") == "click", "dislike").otherwise("comment")
    rows = e.where("event_id % 50 < 40").select((n % 50).alias("article_id"), _joined("v", n.cast("string")).alias("visitor"), verdict.alias("verdict"))
    return lists.article_reaction_counts(e.select((n % 50).alias("article_id")).distinct(), rows, "v107")


@query("""WITH t AS (SELECT event_id AS task_id, event_type AS kind, user_id FROM events WHERE event_type = 'view' ORDER BY event_id DESC LIMIT 200)
SELECT t.task_id, CASE WHEN task_id % 4 < 3 THEN c_name END AS author_name, NULL::BIGINT AS article_id FROM t LEFT JOIN customer ON c_custkey = user_id""")
def task_list(spark: SparkSession, d: str) -> DataFrame:
    """The newest tasks of a kind with the author of their payload; an id that is a text, or is missing, names nobody."""
    n, user = F.col("event_id"), F.col("user_id").cast("string")
    payload = F.when(n % 4 < 3, _joined('{"author_id": ', user, ', "article_id": 5}')).otherwise('{"author_id": "x"}')
    tasks = B.table(spark, d, "events").select(n.alias("task_id"), F.col("event_type").alias("kind"), payload.alias("payload"))
    return lists.task_list(tasks, _authors(spark, d), kind="view", limit=1000).select("task_id", "author_name", "article_id")


@query("""SELECT event_id AS task_id, user_id AS article_id FROM events WHERE event_type = 'click' AND event_id > (SELECT max(event_id) FROM events) - 100""")
def writing_tasks(spark: SparkSession, d: str) -> DataFrame:
    """The articles of writing tasks."""
    e, top = B.table(spark, d, "events"), B.table(spark, d, "events").agg((F.max("event_id") - 100).alias("top"))
    rows = e.where("event_type = 'click'").join(F.broadcast(top)).where("event_id > top").select(F.col("event_id").alias("task_id"), F.lit("write").alias("kind"), _joined('{"article_id": ', F.col("user_id").cast("string"), "}").alias("payload"))
    return lists.task_list(rows, _authors(spark, d), limit=200).select("task_id", "article_id")


@query("""SELECT conv_id AS author_id, role AS module, count(*) AS n FROM conversations GROUP BY ALL""")
def memory_counts(spark: SparkSession, d: str) -> DataFrame:
    return lists.memory_counts(B.table(spark, d, "conversations").select(F.col("conv_id").alias("author_id"), F.col("role").alias("module")))


@query("""SELECT conv_id AS author_id, turn AS entry_id, role AS module FROM conversations WHERE conv_id = 3 AND role = 'user'""")
def memory_list(spark: SparkSession, d: str) -> DataFrame:
    """An author's entries of a module."""
    return lists.memory_list(B.table(spark, d, "conversations").select(F.col("conv_id").alias("author_id"), F.col("turn").alias("entry_id"), F.col("role").alias("module")), 3, "user")


@query("""SELECT s_suppkey AS source_id FROM supplier WHERE s_suppkey % 3 <> 0 AND s_nationkey % 2 = 0""")
def fetchable_sources(spark: SparkSession, d: str) -> DataFrame:
    """Enabled sources of active directions."""
    directions = B.table(spark, d, "nation").select(F.col("n_nationkey").alias("direction_id"), F.when(F.col("n_nationkey") % 2 == 0, "active").otherwise("expired").alias("status"))
    rows = B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"), (F.col("s_suppkey") % 3 != 0).alias("enabled"), F.col("s_nationkey").alias("direction_id"))
    return lists.fetchable_sources(rows, directions).select("source_id")


@query("""SELECT n_nationkey AS direction_id, CASE WHEN n_nationkey % 2 = 0 AND n_nationkey % 3 <> 0 AND n_nationkey <= 12 THEN 'expired' WHEN n_nationkey % 3 = 0 THEN 'deleted' ELSE 'active' END AS status FROM nation""")
def expired_directions(spark: SparkSession, d: str) -> DataFrame:
    """Temporary directions whose end has come, to the second."""
    n = F.col("n_nationkey")
    rows = B.table(spark, d, "nation").select(n.alias("direction_id"), (n % 2 == 0).alias("temp"), F.when(n % 3 == 0, "deleted").otherwise("active").alias("status"), (B.now() + F.make_dt_interval(n - 12)).alias("expires_at"))
    return lists.expired_directions(rows, B.now()).select("direction_id", "status")


@query("""SELECT n_nationkey AS author_id, CASE WHEN k = 0 THEN n_regionkey ELSE 1000 END AS direction_id, CASE WHEN k = 0 THEN 70 ELSE 0 END AS threshold, CASE WHEN k = 0 THEN r_name END AS name
FROM nation JOIN region ON r_regionkey = n_regionkey, (SELECT unnest([0, 1]) AS k)""")
def direction_names(spark: SparkSession, d: str) -> DataFrame:
    """The directions that an author reads by name; a deleted one stays without."""
    read = F.array(F.struct(F.col("n_regionkey").alias("direction_id"), F.lit(70).alias("threshold")), F.struct(F.lit(1000).alias("direction_id"), F.lit(0).alias("threshold")))
    authors = B.table(spark, d, "nation").select(F.col("n_nationkey").alias("author_id"), read.alias("readable_directions"))
    return lists.names_of_directions(authors, B.table(spark, d, "region").select(F.col("r_regionkey").alias("direction_id"), F.col("r_name").alias("name")))


@query(f"""WITH {B.ITEMS}, {B.SCORES} SELECT i.item_id, s.direction, s.relevance, 'S ' || i.source_id AS source_name, round(v.embedding[1]::DOUBLE, 6) AS first FROM items i JOIN scores s USING (item_id) JOIN embeddings v ON v.vec_id = i.item_id
WHERE s.status = 'OK' AND i.item_id % 5 <> 0 AND i.item_id % 7 <> 0 AND i.item_id % 3 <> 0""")
def explore_rows(spark: SparkSession, d: str) -> DataFrame:
    """Items, scores, vectors and sources joined for exploration: fetched ones that are no duplicates, of one model."""
    n = F.col("item_id")
    items = B.items(spark, d).select(n, "direction", "source_id", F.when(n % 5 == 0, "ARCHIVED").otherwise("FETCHED").alias("fetch_status"), F.when(n % 7 == 0, 1).alias("duplicate_of"))
    vectors = B.vectors(spark, d).select("item_id", "vec", F.when(n % 3 == 0, "old").otherwise("m1").alias("model_version"))
    sources = B.items(spark, d).select("source_id", _joined("S ", F.col("source_id")).alias("name")).distinct()
    return lists.explore_rows(items, B.scores(spark, d), vectors, sources, "m1").select("item_id", "direction", "relevance", "source_name", F.round(F.get("vec", 0).cast("double"), 6).alias("first"))


@query("""WITH a AS (SELECT event_id AS item_id, event_id % 8 AS k, user_id % 101 AS r FROM events), s AS (SELECT *, CASE WHEN k IN (0, 1, 2, 3) THEN true ELSE false END AS ok FROM a)
SELECT item_id, CASE WHEN ok THEN 'OK' ELSE 'FAILED' END AS status, CASE WHEN ok THEN r END AS relevance, CASE WHEN ok THEN 7::BIGINT END AS quality, CASE WHEN ok THEN 'mid' END AS band, CASE WHEN ok THEN 'why' END AS reason, CASE WHEN ok THEN r >= 50 END AS passed FROM s""")
def score_rows(spark: SparkSession, d: str) -> DataFrame:
    """Score rows of model answers: fenced JSON, numbers as text or with a fraction, bands in capitals, and five ways to fail."""
    n, r = F.col("event_id") % 8, (F.col("user_id") % 101).cast("string")
    quality = F.when(n == 1, '"7"').when(n == 2, "7.9").when(n == 4, '"7.5"').when(n == 5, "101").when(n == 6, "null").otherwise("7")
    band = F.when(n == 3, " MID ").when(n == 7, "huge").otherwise("mid")
    answer = F.concat(F.when(n == 0, "```json\n").otherwise(""), F.lit('{"relevance": '), r, F.lit(', "quality": '), quality, F.lit(', "band": "'), band, F.lit('", "reason": " why "}'), F.when(n == 0, "\n``` done").otherwise(""))
    rows = B.table(spark, d, "events").select(F.col("event_id").alias("item_id"), F.lit("d").alias("direction"), F.lit(50).alias("threshold"), answer.alias("answer"))
    return lists.score_rows(rows).drop("direction")


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'reject' WHEN 2 THEN 'score' WHEN 3 THEN 'upgrade' ELSE 'upgrade' END AS route, CASE WHEN event_id % 3 = 0 THEN round(least(greatest(value, 0), 100) * 10) / 10 WHEN event_id % 3 = 1 THEN 100.0 ELSE 0.0 END AS normalized,
  CASE event_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'mid' WHEN 2 THEN 'mid' ELSE 'low' END AS band, CASE event_id % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'A' WHEN 2 THEN 'C' ELSE 'A' END AS mode, CASE event_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 3 ELSE NULL END AS version FROM events""")
def score_routes(spark: SparkSession, d: str) -> DataFrame:
    """Routes by a cheap verdict, scores of ranking services on one scale with their bands, and forms of settings."""
    n, value = F.col("event_id"), F.col("value")
    verdict = F.when(n % 5 == 0, None).when(n % 5 == 1, "reject").when(n % 5 == 4, "odd").otherwise("keep")
    route = lists.prefilter_route(verdict, F.when(n % 5 == 3, 0.79).otherwise(0.8))
    norm = F.when(n % 3 == 0, lists.rank_score(F.round(value, 1) / 100, "unit")).when(n % 3 == 1, lists.rank_score(F.lit(2.5), "index")).otherwise(lists.rank_score(F.lit(-1.0), "unit"))
    band = lists.rank_band(F.when(n % 4 == 0, 75).when(n % 4 == 1, 74.9).when(n % 4 == 2, 25).otherwise(24.9))
    mode = lists.public_mode(F.when(n % 4 == 0, " b").when(n % 4 == 1, None).when(n % 4 == 2, "C").otherwise("D"))
    version = lists.prompt_version(F.when(n % 3 == 0, " V3").when(n % 3 == 1, "3").otherwise("x"))
    return B.table(spark, d, "events").select(n, route.alias("route"), norm.alias("normalized"), band.alias("band"), mode.alias("mode"), version.alias("version"))


# ---- ledgers and health ----


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """orders as writing runs."""
    status, n = F.col("o_orderstatus"), F.col("o_orderkey")
    return B.table(spark, d, "orders").select(n.alias("run_id"), F.when(status == "F", "FAILED").otherwise("OK").alias("status"), F.when(n % 4 == 0, "SKIP").otherwise("WRITE").alias("decision"), F.col("o_orderdate").cast("timestamp").alias("created_at"))


_RUNS = "runs AS (SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'FAILED' ELSE 'OK' END AS status, CASE WHEN o_orderkey % 4 = 0 THEN 'SKIP' ELSE 'WRITE' END AS decision, o_orderdate AS created_at FROM orders)"


@query(f"""WITH {B.TASKS}, {B.SCORES}, {_RUNS}, s AS (SELECT status, DATE '2024-01-01' + (item_id % 30)::INT AS day FROM scores)
SELECT (SELECT count(*) FROM tasks WHERE kind = 'fetch' AND status = 'FAILED' AND updated_at >= DATE '2024-01-10') AS fetch_failed, (SELECT count(*) FROM s WHERE status = 'FAILED' AND day >= DATE '2024-01-10') AS score_failed,
  (SELECT count(*) FROM runs WHERE status = 'FAILED' AND created_at >= DATE '1995-01-01') AS write_failed, (SELECT count(*) FROM runs WHERE decision = 'SKIP' AND created_at >= DATE '1995-01-01') AS write_skipped,
  (SELECT round(count(*) FILTER (WHERE status = 'DONE') / count(*)::DOUBLE, 4) FROM tasks WHERE kind = 'fetch' AND updated_at >= DATE '2024-01-10') AS fetch_rate, (SELECT round(count(*) FILTER (WHERE status = 'OK') / count(*)::DOUBLE, 4) FROM runs WHERE created_at >= DATE '1995-01-01') AS write_rate""")
def overview_counts(spark: SparkSession, d: str) -> DataFrame:
    """Four kinds of failures and two success rates of a window."""
    at = F.lit("2024-01-10").cast("timestamp")
    scores = B.scores(spark, d).select("status", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("item_id") % 30).cast("int")).cast("timestamp").alias("created_at"))
    runs = _runs(spark, d).withColumn("created_at", F.when(F.col("created_at") >= F.lit("1995-01-01").cast("timestamp"), at).otherwise(F.lit("1990-01-01").cast("timestamp")))
    return ledger.overview(B.tasks(spark, d), scores, runs, at)


@query(f"""WITH {_RUNS} SELECT count(*) AS runs, count(*) FILTER (WHERE status = 'OK' AND decision = 'WRITE') AS written, count(*) FILTER (WHERE decision = 'SKIP') AS skipped, count(*) FILTER (WHERE status = 'FAILED') AS failed FROM runs""")
def run_counts(spark: SparkSession, d: str) -> DataFrame:
    """The counts of a morning report."""
    return ledger.run_counts(_runs(spark, d))


@query(f"""WITH {B.TASKS}, {B.SCORES}, t AS (SELECT *, task_id % 3 = 0 AS stale FROM tasks), s AS (SELECT s_suppkey % 11 <> 0 AS enabled, s_suppkey % 5 AS k, s_suppkey % 60 AS age, s_suppkey % 7 = 0 AS limited FROM supplier)
SELECT (SELECT count(*) FROM t WHERE status = 'PENDING') AS pending, (SELECT count(*) FROM t WHERE status = 'FAILED' AND stale AND updated_at >= TIMESTAMP '2024-01-19 00:00:00') AS stale_24h,
  (SELECT count(*) FROM documents WHERE doc_id % 30 >= 19) AS items_24h, (SELECT count(*) FROM scores WHERE status = 'OK' AND item_id % 30 >= 19) AS scored_24h, (SELECT count(*) FROM scores WHERE status = 'OK' AND passed AND item_id % 30 >= 19) AS passed_24h,
  (SELECT count(*) FROM s WHERE enabled) AS enabled_sources, (SELECT count(*) FROM s WHERE enabled AND (k = 1 OR (k = 0 AND age <= 30) OR limited)) AS degraded_sources""")
def pipeline_stats(spark: SparkSession, d: str) -> DataFrame:
    """A day's counts and the degraded sources; long dead ones are no longer counted among them."""
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    day = F.lit("2024-01-01").cast("date")
    tasks = B.tasks(spark, d).withColumn("last_error", F.when(F.col("task_id") % 3 == 0, "stale_reclaim: 30 min").otherwise("other"))
    items = B.table(spark, d, "documents").select(F.date_add(day, (F.col("doc_id") % 30).cast("int") - 1).cast("timestamp").alias("fetched_at"))
    scores = B.scores(spark, d).withColumn("created_at", F.date_add(day, (F.col("item_id") % 30).cast("int") - 1).cast("timestamp"))
    n = F.col("s_suppkey")
    sources = B.table(spark, d, "supplier").select(
        (n % 11 != 0).alias("enabled"), F.when(n % 5 == 0, "hard_failed").when(n % 5 == 1, "suspect").otherwise("none").alias("failure_level"),
        (now - F.make_dt_interval((n % 60).cast("int"))).alias("failure_since"), F.when(n % 7 == 0, now + F.expr("INTERVAL 1 MINUTE")).when(n % 7 == 1, now).alias("rate_limited_until"),
    )
    return ledger.pipeline_stats(tasks, sources, items, scores, now)


@query(f"""WITH {B.USAGE} SELECT model, sum(billing_units + 1)::BIGINT AS items, sum(latency_ms) / sum(billing_units + 1)::DOUBLE AS ms_per_item, bool_or(coalesce(completion_tokens, 0) = 0) AS zero_tokens FROM usage GROUP BY model""")
def latency_per_item(spark: SparkSession, d: str) -> DataFrame:
    return ledger.latency_per_item(B.usage(spark, d).select("model", (F.col("billing_units") + 1).alias("items"), "latency_ms", F.col("completion_tokens").alias("tokens")))


@query("""SELECT 'nation' AS "table", count(*) AS rows FROM nation UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'events', count(*) FROM events""")
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    return ledger.table_counts({name: B.table(spark, d, name) for name in ("nation", "documents", "events")})


@query(f"""WITH {B.ITEMS}, {B.SCORES}, r AS (SELECT i.direction AS brief, s.relevance AS score FROM items i LEFT JOIN scores s ON s.item_id = i.item_id AND s.status = 'OK')
SELECT brief, count(*) AS items, count(score) AS scored, count(*) FILTER (WHERE score >= 60) AS ge60, count(*) FILTER (WHERE score <= 30) AS le30, min(score) AS score_min, max(score) AS score_max, round(avg(score), 1) AS score_mean FROM r GROUP BY brief""")
def brief_scores(spark: SparkSession, d: str) -> DataFrame:
    """Items and scores of each brief."""
    s = B.scores(spark, d).where("status = 'OK'").select("item_id", F.col("relevance").alias("score"))
    return ledger.brief_scores(B.items(spark, d).select("item_id", F.col("direction").alias("brief")).join(s, "item_id", "left"))


@query(f"""WITH {B.ITEMS}, s AS (SELECT DISTINCT source_id FROM items UNION ALL SELECT 'none') SELECT s.source_id, count(i.item_id) AS items FROM s LEFT JOIN items i USING (source_id) GROUP BY s.source_id ORDER BY items DESC, s.source_id LIMIT 20""")
def top_sources(spark: SparkSession, d: str) -> DataFrame:
    rows = B.items(spark, d).select("source_id")
    return ledger.top_sources(rows.distinct().unionByName(_table(spark, "source_id string", [("none",)])), rows)


@query("""SELECT event_id AS usage_id, CASE WHEN event_id % 2 = 0 THEN floor(value)::BIGINT ELSE 0 END AS prompt_tokens, 0 AS reasoning_tokens, event_type <> 'error' AS ok, CASE WHEN event_type = 'error' THEN substr('sk-***' || event_id || repeat('x', 3000), 1, 2000) END AS error FROM events""")
def usage_rows(spark: SparkSession, d: str) -> DataFrame:
    """Reported calls as rows of the ledger: defaults, cut and scrubbed errors."""
    n, bad = F.col("event_id"), F.col("event_type") == "error"
    none = F.lit(None).cast("int")
    calls = B.table(spark, d, "events").select(
        n.alias("usage_id"), F.when(n % 2 == 0, F.floor("value")).alias("prompt_tokens"), *[none.alias(c) for c in ("completion_tokens", "billing_units", "cache_hit_tokens", "reasoning_tokens", "latency_ms")],
        F.when(bad, False).alias("ok"), F.when(bad, _joined("sk-", n.cast("string"), "x" * 3000)).otherwise("").alias("error"),
    )
    return ledger.usage_rows(calls).select("usage_id", "prompt_tokens", "reasoning_tokens", "ok", "error")


@query("""SELECT s_suppkey AS source_id, least(15 * 2 ** greatest(s_suppkey % 7 - 1, 0), 240)::INT AS minutes, s_suppkey % 3 = 0 AND s_suppkey % 60 > 30 AS stale, s_suppkey % 4 = 0 AND s_suppkey % 5 > 0 AS changed, CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE s_suppkey % 5 END::INT AS keyword_zero_rounds FROM supplier""")
def health_ladders(spark: SparkSession, d: str) -> DataFrame:
    """Back-off minutes by level, sources that are dead for more than 30 days, and cleared keyword limits."""
    n = F.col("s_suppkey")
    rows = B.table(spark, d, "supplier").select(
        n.alias("source_id"), health.rate_limit_minutes((n % 7 - 1).cast("int")).alias("minutes"), F.when(n % 3 == 0, "hard_failed").otherwise("suspect").alias("failure_level"), (B.now() - F.make_dt_interval((n % 60).cast("int"))).alias("failure_since"),
        F.when(n % 4 == 0, "search").otherwise("rss").alias("type"), (n % 5).cast("int").alias("keyword_zero_rounds"), F.lit(0).alias("keyword_rate_level"), F.lit(None).cast("timestamp").alias("keyword_limited_until"),
    )
    marked = rows.withColumn("stale", health.stale_dead(B.now()))
    return health.reset_keyword_backoff(marked).select("source_id", "minutes", "stale", "changed", "keyword_zero_rounds")


# ---- routing ----


@query(f"""WITH {B.ITEMS} SELECT item_id, sha256(CASE WHEN trim(title) = '' THEN substr(content_text, 1, 2000) ELSE trim(title, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) || CASE WHEN content_text = '' THEN '' ELSE chr(10) || substr(content_text, 1, 2000) END END) AS input FROM items WHERE item_id % 4 <> 0""")
def embed_inputs(spark: SparkSession, d: str) -> DataFrame:
    """The input texts of items whose vector of this model is missing."""
    rows, n = B.items(spark, d), F.col("item_id")
    known = rows.select(n, F.when(n % 4 == 0, "m2").otherwise("m1").alias("model_version"))
    missing = routing.missing_vectors(rows, known, "m2")
    return missing.select("item_id", F.sha2(routing.embed_text(F.col("title"), F.col("content_text")), 256).alias("input"))


@query("""WITH b AS (SELECT vec_id AS item_id, (row_number() OVER (ORDER BY vec_id) - 1) // 16 AS batch FROM embeddings), f AS (SELECT min(batch) AS failed FROM b WHERE item_id % 150 = 149)
SELECT b.item_id, b.batch FROM b, f WHERE failed IS NULL OR batch < failed""")
def filled_vectors(spark: SparkSession, d: str) -> DataFrame:
    """A filling in batches of 16: from the first batch with a vector that is missing or too short on, nothing counts."""
    v = B.vectors(spark, d)
    answers = v.where("item_id % 300 <> 299").select("item_id", F.when(F.col("item_id") % 300 == 149, F.slice("vec", 1, 3)).otherwise(F.col("vec")).alias("vec"))
    return routing.filled(lists.batches(v.select("item_id"), "item_id", 16), answers, 64).select("item_id", "batch")


@query("""SELECT n_nationkey AS direction, n_nationkey % 3 <> 1 AS stale, CASE WHEN n_nationkey % 3 = 1 THEN 'old' WHEN n_nationkey % 2 = 0 THEN 'new' WHEN n_nationkey % 3 = 2 THEN 'old' END AS query, CASE WHEN n_nationkey % 3 = 1 THEN 5 WHEN n_nationkey % 2 = 0 THEN 5 WHEN n_nationkey % 3 = 2 THEN 4 END AS version FROM nation""")
def query_cache(spark: SparkSession, d: str) -> DataFrame:
    """Query vectors by version of the prompt: the stale ones are made anew, and those that could not be stay as they are."""
    n = F.col("n_nationkey")
    cache = B.table(spark, d, "nation").select(n.alias("direction"), F.lit(5).alias("prompt_version"), F.when(n % 3 != 0, "old").alias("query_vec"), F.when(n % 3 == 1, 5).when(n % 3 == 2, 4).alias("query_vec_version"))
    stale = routing.stale_queries(cache).select("direction", F.lit(True).alias("stale"))
    made = stale.select("direction", F.when(F.col("direction") % 2 == 0, "new").alias("vec"))
    out = routing.cached_queries(cache, made).join(stale, "direction", "left")
    return out.select("direction", F.coalesce("stale", F.lit(False)).alias("stale"), F.col("query_vec").alias("query"), F.col("query_vec_version").alias("version"))


@query(f"""WITH {B.VECTORS}, {B.QUERY_VECTORS}, gone AS (SELECT DISTINCT c.item_id FROM vectors c JOIN vectors p ON p.direction = c.direction AND p.item_id < c.item_id AND NOT contains(p.guid, '#v-') WHERE list_cosine_similarity(c.vec, p.vec) >= 0.92),
r AS (SELECT v.item_id, v.direction, CASE v.direction % 3 WHEN 0 THEN 'routed' WHEN 1 THEN 'budget_paused' ELSE 'disabled' END AS route, list_cosine_similarity(v.vec, q.vec) AS sim FROM vectors v JOIN query_vectors q USING (direction)), k AS (
  SELECT * FROM r WHERE route <> 'routed' OR item_id NOT IN (SELECT item_id FROM gone))
SELECT item_id, direction, route, row_number() OVER (PARTITION BY direction ORDER BY CASE WHEN route = 'routed' THEN sim END DESC, item_id) AS position, route = 'routed' AND row_number() OVER (PARTITION BY direction ORDER BY CASE WHEN route = 'routed' THEN sim END DESC, item_id) <= 5 AS is_hit FROM k""")
def routed_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates in the order of scoring: a paused or disabled direction keeps all of its own in order, without hits."""
    v, n = B.vectors(spark, d), F.col("direction")
    directions = v.select("direction").distinct().select(n, (n % 6 != 2).alias("enabled"), (n % 3 == 1).alias("paused"), F.lit(2).alias("prompt_version"), F.when(n % 3 == 0, 2).otherwise(1).alias("query_vec_version"))
    return routing.routed(v.select("item_id", "direction"), v, B.query_vectors(spark, d), directions)


@query("""SELECT n_nationkey AS direction, CASE WHEN n_nationkey % 2 = 0 THEN 70 ELSE CASE WHEN n_nationkey % 3 = 0 THEN 50 ELSE 60 END END AS floor, CASE WHEN n_nationkey % 2 = 0 THEN 0 ELSE 5 END AS percentile, 3 AS quota FROM nation""")
def explore_settings(spark: SparkSession, d: str) -> DataFrame:
    """The direction's value, else the site's if it is not zero, else the default."""
    n = F.col("n_nationkey")
    own = F.when(n % 2 == 0, F.create_map(F.lit("floor"), F.lit("70"), F.lit("percentile"), F.lit("0"))).otherwise(F.create_map(F.lit("other"), F.lit("1")))
    rows = B.table(spark, d, "nation").select(n.alias("direction"), own.alias("explore_config"), F.when(n % 3 == 0, 0).otherwise(60).alias("site_floor"), F.lit(None).cast("int").alias("site_percentile"), F.lit(0).alias("site_quota"))
    return routing.explore_settings(rows)


@query("""SELECT n_nationkey AS item_id, n_nationkey + 1 AS place, NULL AS flag FROM nation WHERE n_nationkey < 20 UNION ALL SELECT n_nationkey, n_nationkey + 1, 'explore' FROM nation WHERE n_nationkey >= 20""")
def injected_picks(spark: SparkSession, d: str) -> DataFrame:
    """A ranked list with the picks that it does not hold behind it."""
    n, rows = F.col("n_nationkey"), B.table(spark, d, "nation")
    return routing.injected(rows.where(n < 20).select(n.alias("item_id"), (n + 1).alias("place")), rows.where(n >= 15).select(n.alias("item_id"), (n - 19).alias("pick")))


# ---- ranking ----


@query(f"""WITH {B.SCORES}, p AS (SELECT item_id, row_number() OVER (ORDER BY relevance DESC, item_id) AS place FROM scores QUALIFY place <= 50), r AS (SELECT item_id, place, CASE WHEN item_id % 3 > 0 THEN item_id % 100 END AS s FROM p)
SELECT item_id, row_number() OVER (ORDER BY s DESC, place)::INT AS rank FROM r WHERE s >= 20 QUALIFY rank <= 10""")
def reranked_set(spark: SparkSession, d: str) -> DataFrame:
    """The pool in the order of a service's scores without those that are too low or missing."""
    pool = lists.top_per_group(B.scores(spark, d).withColumn("_g", F.lit(1)), ["_g"], [F.desc("relevance"), F.col("item_id")], 50).select("item_id", F.col("rank").alias("place"))
    ranks = pool.where("item_id % 3 > 0").select("item_id", (F.col("item_id") % 100).alias("rank_score"))
    return ranking.reranked(pool, ranks, exclude_below=20).select("item_id", "rank")


@query(f"""WITH {B.SCORES}, p AS (SELECT item_id, direction, row_number() OVER (ORDER BY relevance DESC, item_id) AS place FROM scores QUALIFY place <= 50), r AS (SELECT item_id, place, CASE WHEN direction IN ('en', 'de') AND item_id % 4 > 0 THEN item_id % 100 END AS s FROM p)
SELECT item_id, row_number() OVER (ORDER BY s DESC, place)::INT AS rank FROM r WHERE s >= 10 QUALIFY rank <= 10""")
def ranked_pool(spark: SparkSession, d: str) -> DataFrame:
    """A pool ranked direction by direction: answers for a direction that is gone, or for another's item, do not count."""
    pool = lists.top_per_group(B.scores(spark, d).withColumn("_g", F.lit(1)), ["_g"], [F.desc("relevance"), F.col("item_id")], 50).select("item_id", "direction", F.col("rank").alias("place"))
    own = pool.where("item_id % 4 > 0").select("direction", "item_id", (F.col("item_id") % 100).alias("rank_score"))
    stray = pool.where("item_id % 4 = 0").select(F.lit("en-other").alias("direction"), "item_id", F.lit(99).cast("long").alias("rank_score"))
    return ranking.rank_pool(pool, own.unionByName(stray), _table(spark, "direction string", [("en",), ("de",)]), exclude_below=10).select("item_id", "rank")


@query(f"""WITH {B.ITEMS}, k AS (SELECT item_id, direction AS lang, row_number() OVER (PARTITION BY direction ORDER BY md5('3:' || item_id), item_id) AS k FROM items WHERE length(content_text) > 300), l AS (
  SELECT item_id, 'long' AS lang, row_number() OVER (ORDER BY md5('4:' || item_id), item_id) AS k FROM items WHERE length(content_text) >= 2200)
SELECT item_id, lang FROM k WHERE k <= CASE lang WHEN 'en' THEN 15 WHEN 'de' THEN 15 ELSE 5 END UNION ALL SELECT item_id, lang FROM l WHERE k <= 36""")
def evaluation_samples(spark: SparkSession, d: str) -> DataFrame:
    """So many known items of each language, and long texts."""
    rows = B.items(spark, d).select("item_id", F.coalesce("direction", F.lit("none")).alias("lang"), F.length("content_text").alias("n"))
    known = ranking.stratified(rows.where("n > 300"), "lang", {"en": 15, "de": 15, "es": 5, "fr": 5}, seed=3)
    return known.select("item_id", "lang").unionByName(ranking.stratified(rows.where("n >= 2200").withColumn("lang", F.lit("long")), "lang", {"long": 36}, seed=4).select("item_id", "lang"))


@query(f"""WITH {B.ITEMS}, r AS (SELECT item_id, source_id, CASE WHEN n_chars >= 2000 THEN 'long' WHEN n_chars >= 500 THEN 'mid' ELSE 'short' END AS bucket, md5('7:' || item_id) AS h FROM items), s AS (
  SELECT *, row_number() OVER (PARTITION BY bucket, source_id ORDER BY h, item_id) > 1 AS later FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY later, h, item_id) AS k FROM s)
SELECT item_id, bucket FROM k WHERE k <= CASE bucket WHEN 'long' THEN 15 WHEN 'mid' THEN 15 ELSE 20 END""")
def quota_sample(spark: SparkSession, d: str) -> DataFrame:
    """So many items of each length, first one of every source."""
    bucket = F.when(F.col("n_chars") >= 2000, "long").when(F.col("n_chars") >= 500, "mid").otherwise("short")
    rows = B.items(spark, d).select("item_id", "source_id", bucket.alias("bucket"))
    return ranking.quota_sample(rows, "bucket", "source_id", {"long": 15, "mid": 15, "short": 20}, seed=7).select("item_id", "bucket")


@query(f"""WITH {B.SCORES} SELECT item_id, 'excluded' AS change FROM scores WHERE relevance >= 60 AND quality < 50 UNION ALL SELECT item_id, 'added' FROM scores WHERE relevance < 60 AND quality >= 50""")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    s = B.scores(spark, d)
    return ranking.set_difference(s.where("relevance >= 60"), s.where("quality >= 50"))


# ---- gates and texts ----


@query("""WITH d AS (SELECT doc_id AS draft_id, CASE doc_id % 6 WHEN 0 THEN [] WHEN 1 THEN ['undefined:2'] WHEN 2 THEN ['unmarked:3'] WHEN 3 THEN ['too_few:1', 'not_in_reading_set:1'] WHEN 4 THEN ['quote_not_found:2'] ELSE ['empty_quote:1'] END AS i FROM documents)
SELECT draft_id, array_to_string(i, ',') AS issues FROM d""")
def citation_issues(spark: SparkSession, d: str) -> DataFrame:
    """Drafts over every document: marks without note, notes without mark, foreign items, quotes that are empty or not there."""
    n, key = F.col("doc_id") % 6, F.col("doc_id").cast("string")
    start = F.substring(F.regexp_replace(F.col("text"), r"(?U)\s+", " "), 1, 12)
    quote = F.regexp_replace(start, "[\\[\\]]", "")
    note = lambda k, item, q: _joined(f"\n[^{k}]: [条目 ", item, "] ", q)
    two = F.concat(note(1, key, quote), note(2, key, quote))
    text = F.concat(
        F.lit("a[^1] b[^2]"),
        F.when(n == 0, two).when(n == 1, F.concat(note(1, key, quote), F.lit("\n[^9]x"), F.lit(""))).when(n == 2, F.concat(two, note(3, key, quote))).when(n == 3, F.lit("")).when(n == 4, F.concat(note(1, key, quote), note(2, key, F.lit("nowhere to be found ~")))).otherwise(F.concat(note(1, key, F.lit("")), note(2, key, quote))),
    )
    text = F.when(n == 1, F.concat(F.lit("a[^1] b[^2]"), note(1, key, quote), note(1, key, quote))).when(n == 3, _joined("a[^1]", note(1, F.lit("-1"), quote).substr(F.lit(1), F.lit(0)), "\n[^1]: [条目 999999999] x")).otherwise(text)
    rows = B.table(spark, d, "documents")
    drafts = rows.select(F.col("doc_id").alias("draft_id"), text.alias("text"))
    reading = rows.select(F.col("doc_id").alias("draft_id"), F.col("doc_id").alias("item_id"), F.regexp_replace("text", "[\\[\\]]", "").alias("content_text"))
    minimum = 2
    few = drafts.where("draft_id % 6 = 3 OR draft_id % 6 = 1")
    out = gates.citation_issues(drafts.where("draft_id % 6 NOT IN (1, 3)"), reading, minimum).unionByName(gates.citation_issues(few.where("draft_id % 6 = 3"), reading, minimum)).unionByName(gates.citation_issues(few.where("draft_id % 6 = 1"), reading, 1))
    return out.select("draft_id", F.array_join("issues", ",").alias("issues"))


@query("""SELECT doc_id AS draft_id, doc_id % 2 = 0 AND doc_id % 3 <> 0 AS passed, array_to_string(list_filter([CASE WHEN doc_id % 2 = 1 THEN 'length:short' END, CASE WHEN doc_id % 3 = 0 THEN 'citation:none' END], lambda x: x IS NOT NULL), ',') AS issues, CASE WHEN doc_id % 5 = 0 THEN 'style:few' ELSE '' END AS warns FROM documents""")
def gate_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """One verdict of each draft over three gates."""
    n, drafts = F.col("draft_id"), B.table(spark, d, "documents").select(F.col("doc_id").alias("draft_id"))
    gate = lambda fails, level, message: drafts.select(n, F.when(fails, level).otherwise("pass").alias("level"), F.lit(message).alias("message"))
    out = gates.gate_verdicts(drafts, [("length", gate(n % 2 == 1, "issue", "short")), ("style", gate(n % 5 == 0, "warn", "few")), ("citation", gate(n % 3 == 0, "issue", "none"))])
    return out.select("draft_id", "passed", F.array_join("issues", ",").alias("issues"), F.array_join("warns", ",").alias("warns"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'write' WHEN 1 THEN 'skip' END AS decision, CASE p_partkey % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.0 END::DOUBLE AS pruned, 'Hi ' || p_name || '! {other} {' || p_name || '}' AS filled,
  p_name || '[^1] &lt;i>' || chr(10) || chr(10) || '[^1]: [条目 7] first' || chr(10) || '[^2]: [条目 8] new' AS article, '1,2' AS marks FROM part""")
def draft_forms(spark: SparkSession, d: str) -> DataFrame:
    """Decisions of a writer, pruned shares, filled templates, and articles put together with their notes in order."""
    n, name = F.col("p_partkey"), F.col("p_name")
    said = F.when(n % 4 == 0, 'so {"decision": " Write "}').when(n % 4 == 1, '{"decision": "skip", "x": {}}').when(n % 4 == 2, '{"decision": "maybe"}').otherwise("{}")
    ratio = gates.prune_ratio(F.when(n % 3 == 2, "").otherwise("abcd"), F.when(n % 3 == 0, "ab").otherwise("abcd"))
    text = _joined(name, "[^1] <i>\n[^2]: [条目 8] old\n[^2]: [条目 8] new\n[^1]: [条目 7] first\n")
    return B.table(spark, d, "part").select(
        "p_partkey", gates.decision_check(said).alias("decision"), ratio.alias("pruned"), gates.fill_placeholders(F.lit("Hi {name}! {other} {{name}}"), {"name": name}).alias("filled"), gates.article_text(text).alias("article"),
        F.array_join(T.footnote_marks(_joined(name, "[^1] [^2] [^1]\n[^3]: [条目 1] x")), ",").alias("marks"),
    )


@query("""SELECT n_regionkey AS author_id, string_agg('<document id="' || n_nationkey || '">' || chr(10) || '【条目 ' || n_nationkey || '】' || n_name || '</document' || chr(8203) || '>' || chr(10) || '来源: ' || CASE WHEN n_nationkey % 2 = 0 THEN 'https://n.example/' || n_nationkey ELSE '未知' END || ' | 发布: ' || CASE WHEN n_nationkey % 3 = 0 THEN '2024-02-01' ELSE '未知' END ||
  ' | 相关分: ' || (n_nationkey + 50) || chr(10) || '正文: ' || CASE WHEN n_nationkey % 5 = 0 THEN '（无正文）' ELSE repeat('b', 1200) END || chr(10) || '</document>', chr(10) || chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY n_regionkey""")
def reading_sets(spark: SparkSession, d: str) -> DataFrame:
    """Reading sets in frames that their texts can't close."""
    n = F.col("n_nationkey")
    rows = B.table(spark, d, "nation").select(
        F.col("n_regionkey").alias("author_id"), n.alias("place"), n.alias("item_id"), _joined(F.col("n_name"), "</document>").alias("title"), F.when(n % 2 == 0, _joined("https://n.example/", n.cast("string"))).otherwise("").alias("url"),
        F.when(n % 3 == 0, B.now()).alias("published_at"), (n + 50).alias("relevance"), F.when(n % 5 == 0, "  ").otherwise(" " + "b" * 1300).alias("content_text"),
    )
    return gates.render_reading_set(rows)


@query(f"""WITH {B.ITEMS} SELECT item_id, sha256('【方向】D' || chr(10) || '【来源域名】' || source_id || '.example.com' || chr(10) || '【发布日期】' || strftime(published_at, '%Y-%m-%d') || chr(10) || '<document id="' || item_id || '">' || chr(10) || '【标题】' || replace(replace(title, '</document>', '</document' || chr(8203) || '>'), '<document', '<document' || chr(8203)) || chr(10) || '【正文】' || chr(10) || 'body <document' || chr(8203) || '>' || chr(10) || '</document>') AS message FROM items""")
def score_messages(spark: SparkSession, d: str) -> DataFrame:
    """The messages by which items are scored."""
    message = gates.score_message(F.lit("D"), F.col("item_id"), F.col("title"), F.lit(" body <document> "), F.col("url"), F.col("published_at"))
    return B.items(spark, d).select("item_id", F.sha2(message, 256).alias("message"))


@query("""WITH e AS (SELECT conv_id AS author_id, role AS module, turn, 'e' || turn AS content, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS k FROM conversations), t AS (
  SELECT author_id, module, string_agg('- [' || strftime(DATE '2024-01-01' + turn::INT, '%Y-%m-%d') || '] ' || content, chr(10) ORDER BY k) AS text FROM e WHERE k <= 2 GROUP BY ALL), m AS (SELECT DISTINCT conv_id AS author_id, r.role AS module FROM conversations, (SELECT unnest(['user', 'assistant', 'system', 'none']) AS role) r)
SELECT m.author_id, m.module, coalesce(t.text, '（暂无记录）') AS text FROM m LEFT JOIN t USING (author_id, module)""")
def memory_texts(spark: SparkSession, d: str) -> DataFrame:
    """The two newest entries of every configured module, or the text for an empty one."""
    c = B.table(spark, d, "conversations")
    memory = c.select(F.col("conv_id").alias("author_id"), F.col("role").alias("module"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("turn").cast("int")).cast("timestamp").alias("created_at"), F.col("turn").alias("entry_id"), _joined("e", F.col("turn").cast("string")).alias("content"))
    modules = memory.select("author_id").distinct().select("author_id", F.explode(F.array(*[F.lit(x) for x in ("user", "assistant", "system", "none")])).alias("module"))
    return gates.memory_texts(modules, memory, 2)


@query("""WITH b AS (SELECT n_regionkey AS author_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS pos, n_nationkey AS block_id, n_name AS text, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation), r AS (
  SELECT author_id, block_id, ((pos - author_id * 3) % n + n) % n AS place, substr(text, 1, 7) AS text, length(text) > 7 AS truncated, 'round_robin' AS way FROM b UNION ALL SELECT author_id, block_id, pos - greatest(n - 2, 0), substr(text, 1, 7), length(text) > 7, 'recency' FROM b WHERE pos >= n - 2)
SELECT way, author_id, place::INT AS pos, block_id, text, truncated FROM r WHERE place < 2""")
def static_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Two blocks of each author, from the number of past runs on, and the last two."""
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    blocks = lists.top_per_group(B.table(spark, d, "nation").select(r.alias("author_id"), n.alias("block_id"), F.col("n_name").alias("text")), ["author_id"], [F.col("block_id")], 100).withColumn("pos", F.col("rank") - 1).drop("rank")
    runs = B.table(spark, d, "region").select(F.col("r_regionkey").alias("author_id"), F.explode(F.sequence(F.lit(1), F.col("r_regionkey") * 3)).alias("x")).where("author_id > 0")
    ways = [gates.injected_blocks(blocks, runs, 2, way, max_chars=7).withColumn("way", F.lit(way)) for way in ("round_robin", "recency")]
    return ways[0].unionByName(ways[1])


@query("""WITH r AS (SELECT l_orderkey AS run_id, l_linenumber AS round, l_quantity::INT % 2 AS i FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) = 1)
SELECT run_id, round, coalesce(i = lag(i) OVER (PARTITION BY run_id ORDER BY round), false) AS stop FROM r""")
def rewrite_stops(spark: SparkSession, d: str) -> DataFrame:
    """Rounds of rewriting that repeat the issues of the round before, in any order."""
    first = lists.top_per_group(B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), ["l_orderkey", "l_linenumber"], [F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity")], 1)
    issues = F.when(F.col("l_quantity").cast("int") % 2 == 0, F.when(F.col("l_linenumber") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"), F.lit("a")))).otherwise(F.array(F.lit("c")))
    return gates.repeated_issues(first.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("round"), issues.alias("issues"))).select("run_id", "round", "stop")


@query("""WITH a AS (SELECT item_id AS anchor_id, item_id % 3 AS author_id, regexp_replace(text, '\\s+', '', 'g') AS a FROM benchmark), b AS (SELECT item_id AS draft_id, item_id % 3 AS author_id, 'pre ' || text[20:80] || ' post' AS t FROM benchmark)
SELECT draft_id, anchor_id, true AS long FROM (SELECT b.draft_id, a.anchor_id, length(regexp_replace(b.t[5:65], '\\s+', '', 'g')) AS n FROM b JOIN a ON a.anchor_id = b.draft_id) WHERE n >= 20""")
def echo_gate(spark: SparkSession, d: str) -> DataFrame:
    """Drafts that carry a stretch of an anchor of their author; every one finds at least its own."""
    bare = F.regexp_replace("text", r"(?U)\s+", "")
    rows = B.table(spark, d, "benchmark").select("item_id", (F.col("item_id") % 3).alias("author_id"), "text")
    anchors = rows.select(F.col("item_id").alias("anchor_id"), "author_id", bare.alias("text"))
    drafts = rows.select(F.col("item_id").alias("draft_id"), "author_id", _joined("pre ", F.substring("text", 20, 61), " post").alias("text"))
    return gates.echo_hits(drafts, anchors).where("draft_id = anchor_id").select("draft_id", "anchor_id", (F.col("echo_max_chars") >= 20).alias("long"))


@query("""WITH r AS (SELECT item_id, item_id % 3 AS author_id, regexp_replace(text, '\\s+', '', 'g') AS a, regexp_replace('pre ' || text[20:80] || text[1:25] || ' post', '\\s+', '', 'g') AS t FROM benchmark),
p AS (SELECT item_id AS draft_id, author_id, unnest(string_split(t, '')) AS x, generate_subscripts(string_split(t, ''), 1) AS i FROM r), q AS (SELECT item_id AS anchor_id, author_id, unnest(string_split(a, '')) AS x, generate_subscripts(string_split(a, ''), 1) AS j FROM r),
m AS (SELECT draft_id, anchor_id, i - j AS diagonal, i - row_number() OVER (PARTITION BY draft_id, anchor_id, i - j ORDER BY i) AS island FROM p JOIN q USING (author_id, x)),
n AS (SELECT draft_id, anchor_id, count(*) AS n FROM m GROUP BY draft_id, anchor_id, diagonal, island)
SELECT draft_id, anchor_id, max(n)::INT AS echo_max_chars FROM n GROUP BY draft_id, anchor_id HAVING max(n) >= 20""")
def echo_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of a draft and an anchor of its author with a stretch of twenty characters or more, and its length."""
    bare = F.regexp_replace("text", r"(?U)\s+", "")
    rows = B.table(spark, d, "benchmark").select("item_id", (F.col("item_id") % 3).alias("author_id"), "text")
    anchors = rows.select(F.col("item_id").alias("anchor_id"), "author_id", bare.alias("text"))
    drafts = rows.select(F.col("item_id").alias("draft_id"), "author_id", _joined("pre ", F.substring("text", 20, 61), F.substring("text", 1, 25), " post").alias("text"))
    return gates.echo_hits(drafts, anchors)


@query()
def citation_hints(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a draft that quotes itself with letters changed, or truly, or another document; tested against a loop."""
    docs = B.table(spark, d, "documents").select("doc_id", "text")
    n, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    start = F.regexp_replace(F.substring(text, 1, 70), r"[\[\]\s]+", " ")
    quote = F.when(n % 3 == 0, F.translate(start, "aeiou", "eeeuu")).when(n % 3 == 1, start).otherwise(F.reverse(start))
    note = F.concat(F.lit("a[^1]\n[^1]: [条目 "), n.cast("string"), F.lit("] "), quote)
    reading = docs.select(n.alias("draft_id"), n.alias("item_id"), F.col("text").alias("content_text"))
    return gates.citation_hints(docs.select(n.alias("draft_id"), note.alias("text")), reading)


# ---- limits and time ----


@query("""SELECT n_regionkey AS call_point, arg_min(n_name, n_nationkey) AS provider FROM nation WHERE n_nationkey % 3 <> 1 GROUP BY n_regionkey""")
def first_available(spark: SparkSession, d: str) -> DataFrame:
    """The first provider that is not cooling down; a cool-down that ends now is over."""
    n = F.col("n_nationkey")
    until = F.when(n % 3 == 1, B.now() + F.expr("INTERVAL 1 SECOND")).when(n % 3 == 2, B.now())
    return limits.first_available(B.table(spark, d, "nation").select(F.col("n_regionkey").alias("call_point"), F.col("n_name").alias("provider"), n.alias("position"), until.alias("cooldown_until")), B.now())


@query(f"""SELECT event_id AS session_id FROM events WHERE ts + INTERVAL 15 DAYS > {TS}""")
def valid_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = B.table(spark, d, "events").select(F.col("event_id").alias("session_id"), (F.col("ts").cast("timestamp") + F.expr("INTERVAL 15 DAYS")).alias("expires_at"))
    return limits.valid_sessions(rows, B.now()).select("session_id")


@query("""SELECT event_id AS entry_id, row_number() OVER (PARTITION BY user_id % 10, ((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Shanghai')::DATE ORDER BY ts, event_id) <= 5 AS kept FROM events""")
def memory_caps(spark: SparkSession, d: str) -> DataFrame:
    """The first entries of an author on each local day."""
    rows = B.table(spark, d, "events").select((F.col("user_id") % 10).alias("author_id"), F.col("event_id").alias("entry_id"), F.col("ts").cast("timestamp").alias("ts"))
    return limits.memory_capped(rows, "Asia/Shanghai", daily=5).select("entry_id", "kept")


@query(f"""WITH {B.TASKS}, c AS (SELECT task_id, CASE WHEN status = 'PENDING' AND task_id % 3 = 0 THEN 'RUNNING' ELSE status END AS status, CASE WHEN status = 'PENDING' AND task_id % 3 = 0 THEN 2 ELSE 1 END AS attempts, status = 'PENDING' AND task_id % 3 = 0 AS won FROM tasks)
SELECT task_id, attempts, won, CASE WHEN status = 'RUNNING' AND task_id % 5 = 0 THEN 'DONE' WHEN status = 'RUNNING' AND task_id % 5 = 1 THEN 'FAILED' ELSE status END AS status, CASE WHEN status = 'RUNNING' AND task_id % 5 = 1 THEN 'boom' END AS last_error, status <> 'RUNNING' AND task_id % 5 <= 1 AS late FROM c""")
def claimed_and_finished(spark: SparkSession, d: str) -> DataFrame:
    """Tasks that a worker claims and then ends: taken ones are not won, late results change nothing."""
    n, rows = F.col("task_id"), B.tasks(spark, d).withColumn("attempts", F.lit(1)).withColumn("last_error", F.lit(None).cast("string"))
    taken = limits.claimed(rows, rows.where("task_id % 3 = 0"), B.now())
    results = rows.where("task_id % 5 <= 1").select(n, F.when(n % 5 == 0, "DONE").otherwise("FAILED").alias("result"), F.when(n % 5 == 1, "boom").alias("error"))
    return limits.finished(taken, results, B.now()).select("task_id", "attempts", "won", "status", "last_error", "late")


@query(f"""WITH {B.TASKS}, p AS (SELECT task_id, row_number() OVER (ORDER BY task_id) AS n FROM tasks WHERE kind = 'score')
SELECT task_id, CASE WHEN n <= 80 THEN 'w' || ((n - 1) // 40)::VARCHAR END AS owner, CASE WHEN n <= 40 AND task_id % 2 = 0 THEN 'DONE' WHEN n <= 80 THEN 'RUNNING' ELSE 'PENDING' END AS status, CASE WHEN n <= 80 THEN 1 ELSE 0 END AS attempts FROM p""")
def claimed_by_two(spark: SparkSession, d: str) -> DataFrame:
    """Waiting tasks of a board of which two workers claim forty each; the first one ends some of its own, and tries to
    end one that is not its own."""
    board = TaskBoard(spark, compact_after=3)
    board.put(B.tasks(spark, d).where("kind = 'score'").select("task_id", "kind"))
    own = [board.claim(worker, 40, B.now()) for worker in ("w0", "w1")]
    results = own[0].where("task_id % 2 = 0").unionByName(own[1].limit(1)).select("task_id", F.lit("DONE").alias("result"), F.lit(None).cast("string").alias("error"))
    board.finish("w0", results, B.now())
    return board.tasks().select("task_id", "owner", "status", "attempts")


@query("""SELECT n_nationkey AS host, CASE n_nationkey % 4 WHEN 0 THEN greatest(n_nationkey, 6.0) WHEN 1 THEN 6.0 WHEN 2 THEN 3.0 ELSE 0.0 END::DOUBLE AS seconds, n_nationkey % 3 = 0 AS busy, n_nationkey % 5 >= 2 AS due FROM nation""")
def request_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Intervals between requests to a host, kinds of rounds that may not start, and jobs that are due."""
    n, rows = F.col("n_nationkey"), B.table(spark, d, "nation")
    override = F.when(n % 4 == 0, n.cast("string")).when(n % 4 == 1, "x").when(n % 4 == 3, "-4")
    own = rows.select(n.alias("host"), limits.request_interval(override, F.lit(3), F.when(n % 4 <= 1, 6)).alias("seconds"))
    busy = limits.busy_kinds(rows.select(n.alias("kind"), F.when(n % 3 == 0, F.when(n % 2 == 0, "RUNNING").otherwise("PENDING")).otherwise("DONE").alias("status"))).select(F.col("kind").alias("host"), F.lit(True).alias("busy"))
    jobs = rows.select(n.alias("host"), F.lit(900).alias("every_s"), F.when(n % 5 < 4, B.now() - F.make_dt_interval(mins=(n % 5 + 13).cast("int"))).alias("last_run"))
    due = limits.due_ticks(jobs, B.now()).select("host", F.lit(True).alias("due"))
    return own.join(busy, "host", "left").join(due, "host", "left").select("host", "seconds", F.coalesce("busy", F.lit(False)).alias("busy"), F.coalesce("due", F.lit(False)).alias("due"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS account, event_id AS login_id, epoch(ts) AS at, event_type = 'view' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w(account, k, login_id, bad, until, outcome) AS (
  SELECT account, 0::BIGINT, NULL::BIGINT, 0, 0.0::DOUBLE, NULL::VARCHAR FROM e GROUP BY account UNION ALL
  SELECT w.account, e.k, e.login_id, CASE WHEN e.at < w.until THEN w.bad WHEN e.ok THEN 0 WHEN w.bad + 1 >= 3 THEN 0 ELSE w.bad + 1 END, CASE WHEN e.at < w.until THEN w.until WHEN NOT e.ok AND w.bad + 1 >= 3 THEN e.at + 864000 ELSE 0.0 END,
    CASE WHEN e.at < w.until THEN 'locked' WHEN e.ok THEN 'ok' ELSE 'failed' END FROM w JOIN e ON e.account = w.account AND e.k = w.k + 1)
SELECT login_id, outcome FROM w WHERE k > 0""")
def login_lockouts(spark: SparkSession, d: str) -> DataFrame:
    """Logins of each account in order: three failures in a row lock it for ten days."""
    rows = B.table(spark, d, "events").select(F.col("user_id").cast("string").alias("account"), F.col("event_id").alias("login_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), (F.col("event_type") == "view").alias("ok"))
    return limits.login_lockouts(rows, failures=3, lock_s=864_000).select("login_id", "outcome")


@query("""SELECT o_orderkey, strftime(timezone('UTC', timezone('America/New_York', date_trunc('day', timezone('America/New_York', timezone('UTC', o_orderdate))) + INTERVAL 40 DAYS)), '%Y-%m-%d %H:%M:%S') AS later,
  strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_start, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH, '%Y-%m-%d') AS month_end,
  CASE o_orderkey % 4 WHEN 0 THEN 7 WHEN 1 THEN 60 WHEN 2 THEN 0 END::BIGINT AS retry_after, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 08:00:00' WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00' END AS parsed,
  CASE o_orderkey % 3 WHEN 0 THEN 5000.0 WHEN 1 THEN 8000.0 ELSE 8000.0 END::DOUBLE AS delay_ms FROM orders""")
def time_forms(spark: SparkSession, d: str) -> DataFrame:
    """Local midnights some days later over changes of the clock, months, Retry-After, tolerant ISO times and delays."""
    n, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    day = F.date_format(at, "yyyy-MM-dd")
    start, end = D.month_bounds(F.date_format(at, "yyyy-MM"))
    header = F.when(n % 4 == 0, " 7 ").when(n % 4 == 1, F.concat(F.date_format(at + F.expr("INTERVAL 1 MINUTE"), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).when(n % 4 == 2, F.concat(F.date_format(at - F.expr("INTERVAL 1 HOUR"), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).otherwise("-3")
    iso = F.when(n % 3 == 0, _joined(day, "T10:00:00+02:00")).when(n % 3 == 1, day).otherwise("31.12.")
    delay = D.retry_delay_ms(F.lit(3), F.when(n % 3 == 0, 5.0).when(n % 3 == 1, 60.0), F.lit(0.5))
    text = lambda c, form: F.date_format(c, form)
    return B.table(spark, d, "orders").select(
        n, text(D.local_day_start_after(at, D.resolve_zone("America/New_York"), 40), "yyyy-MM-dd HH:mm:ss").alias("later"), text(start, "yyyy-MM-dd").alias("month_start"), text(end, "yyyy-MM-dd").alias("month_end"),
        D.retry_after_seconds(header, at).alias("retry_after"), text(D.parse_time(iso), "yyyy-MM-dd HH:mm:ss").alias("parsed"), delay.alias("delay_ms"),
    )


# ---- evaluation ----


@query(f"""WITH {B.SCORES}, r AS (SELECT item_id, direction, row_number() OVER (PARTITION BY direction ORDER BY relevance DESC, item_id) AS rank FROM scores), t AS (SELECT r.*, CASE item_id % 3 WHEN 0 THEN direction ELSE 'x' END AS owner FROM r WHERE rank <= 10 AND item_id % 4 > 0)
SELECT direction AS query_id, count(*) AS labelled, count(*) FILTER (WHERE owner <> direction) AS mixed FROM t GROUP BY direction""")
def brief_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Labelled items among the first ten of each query, and those of another brief."""
    rows = lists.top_per_group(B.scores(spark, d).select("item_id", F.col("direction").alias("query_id"), "relevance"), ["query_id"], [F.desc("relevance"), F.col("item_id")], 50)
    labels = B.scores(spark, d).where("item_id % 4 > 0").select("item_id", F.when(F.col("item_id") % 3 == 0, F.col("direction")).otherwise("x").alias("owner"))
    return evaluation.mixture(rows, labels)


@query("""SELECT p_brand AS brand, count(*) AS n, avg((p_size = 1)::INT) AS recall_1, avg((p_size <= 5)::INT) AS recall_5, avg(p_size)::DOUBLE AS mean_rank, max(p_size) AS worst_rank FROM part GROUP BY p_brand""")
def rank_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Recall at 1 and 5, mean and worst rank."""
    return evaluation.rank_summary(B.table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_size").alias("rank")), "brand")


@query(f"""WITH {B.SCORES} SELECT count(*) AS n, avg(abs(relevance - quality))::DOUBLE AS mae, count(*) FILTER (WHERE abs(relevance - quality) <= 20) AS within FROM scores""")
def anchor_consistency(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.anchor_consistency(B.scores(spark, d), "relevance", "quality")


@query("""WITH v AS (SELECT event_type AS model, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'keep' ELSE 'reject' END AS verdict, CASE event_id % 3 WHEN 0 THEN 'keep' ELSE 'reject' END AS gold, 'r' || event_id % 2 AS reason, 'r0' AS gold_reason, event_id % 4 = 0 AS trap FROM events)
SELECT model, count(*) AS n, count(*) FILTER (WHERE verdict IS NULL) AS errors, avg(coalesce(verdict = gold, false)::INT) AS accuracy, avg((reason = gold_reason)::INT) FILTER (WHERE verdict = gold) AS reason_accuracy, count(*) FILTER (WHERE trap AND NOT coalesce(verdict = gold, false)) AS trapped FROM v GROUP BY model""")
def verdict_accuracy(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    rows = B.table(spark, d, "events").select(
        F.col("event_type").alias("model"), F.when(n % 5 == 0, None).when(n % 5 == 1, "keep").otherwise("reject").alias("verdict"), F.when(n % 3 == 0, "keep").otherwise("reject").alias("gold_verdict"),
        _joined("r", (n % 2).cast("string")).alias("reason"), F.lit("r0").alias("gold_reason"), (n % 4 == 0).alias("trap"),
    )
    return evaluation.verdicts(rows, "model")


@query("""WITH c AS (SELECT doc_id AS item_id, CASE WHEN doc_id % 2 = 0 THEN 'even' WHEN doc_id % 3 = 0 THEN 'three' WHEN doc_id % 5 = 0 THEN 'five' END AS class FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY md5('11:' || item_id), item_id) AS k FROM c WHERE class IS NOT NULL)
SELECT item_id, class FROM k WHERE k <= CASE class WHEN 'even' THEN 20 WHEN 'three' THEN 10 ELSE 5 END""")
def labelled_cascade(spark: SparkSession, d: str) -> DataFrame:
    """So many rows of the first class that holds."""
    n = F.col("item_id")
    return evaluation.labelled_cascade(B.table(spark, d, "documents").select(F.col("doc_id").alias("item_id")), [("even", n % 2 == 0, 20), ("three", n % 3 == 0, 10), ("five", n % 5 == 0, 5)], seed=11).select("item_id", "class")


@query("""WITH l AS (SELECT event_id % 100 AS item_id, event_type AS brief, arg_max(event_id % 37, event_id) AS score FROM events GROUP BY ALL) SELECT item_id, string_agg(brief || '=' || score, ',' ORDER BY brief) AS scores FROM l GROUP BY item_id""")
def gold_labels(spark: SparkSession, d: str) -> DataFrame:
    """The last score of an item for each brief, as a map."""
    n = F.col("event_id")
    rows = evaluation.gold_labels(B.table(spark, d, "events").select((n % 100).alias("item_id"), F.col("event_type").alias("brief"), (n % 37).alias("score"), n.alias("score_id")))
    return rows.select("item_id", F.array_join(F.transform(F.array_sort(F.map_entries("scores")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",").alias("scores"))


@query(f"""WITH {B.VECTORS}, p AS (SELECT CASE WHEN item_id % 2 = 0 THEN 'near' ELSE 'far' END AS kind, item_id AS a, item_id + 7 AS b FROM vectors WHERE item_id % 5 = 0)
SELECT kind, a, b, round((list_inner_product(x.vec, y.vec))::DOUBLE, 5) AS sim FROM p JOIN vectors x ON x.item_id = a JOIN vectors y ON y.item_id = b""")
def gold_pair_similarities(spark: SparkSession, d: str) -> DataFrame:
    """Similarities of gold pairs both of whose items have a vector."""
    n, v = F.col("item_id"), B.vectors(spark, d)
    pairs = v.where("item_id % 5 = 0").select(F.when(n % 2 == 0, "near").otherwise("far").alias("kind"), n.alias("a"), (n + 7).alias("b"))
    return evaluation.pair_similarities(pairs, v).withColumn("sim", F.round("sim", 5))


@query("""SELECT p_brand AS model, count(*) AS n, round(avg(CASE WHEN p_size % 2 = 0 THEN p_size END), 3) AS recall, NULL::DOUBLE AS mrr, median(p_size)::DOUBLE AS median_latency FROM part GROUP BY p_brand""")
def report_roll_up(spark: SparkSession, d: str) -> DataFrame:
    """Means over what is there, and the median latency, of each model."""
    rows = B.table(spark, d, "part").select(F.col("p_brand").alias("model"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("recall"), F.lit(None).cast("double").alias("mrr"), F.col("p_size").alias("latency"))
    return evaluation.roll_up(rows, ["model"], ["recall", "mrr"], "latency")


@query("""WITH s AS (SELECT c_mktsegment AS module, CASE c_custkey % 5 WHEN 0 THEN 'survived' WHEN 1 THEN 'timeout' ELSE 'killed' END AS status FROM customer)
SELECT module, count(*) AS total, count(*) FILTER (WHERE status = 'killed') AS killed, count(*) FILTER (WHERE status = 'survived') AS survived, count(*) FILTER (WHERE status = 'timeout') AS other, count(*) FILTER (WHERE status = 'killed') / count(*) FILTER (WHERE status <> 'timeout')::DOUBLE AS score FROM s GROUP BY module""")
def module_status(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of mutation runs by module."""
    n = F.col("c_custkey")
    return evaluation.module_status(B.table(spark, d, "customer").select(F.col("c_mktsegment").alias("module"), F.when(n % 5 == 0, "survived").when(n % 5 == 1, "timeout").otherwise("killed").alias("status")))


@query(f"""WITH {B.SCORES} SELECT CASE WHEN relevance >= 75 THEN 'high' WHEN relevance >= 25 THEN 'mid' ELSE 'low' END AS band, count(*) AS n, avg(quality)::DOUBLE AS mean FROM scores GROUP BY 1""")
def band_means(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.band_means(B.scores(spark, d).withColumn("band", lists.rank_band(F.col("relevance"))), "band", "quality")
