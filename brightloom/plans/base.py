"""The test tables in the roles of the data model: items, scores, usage ledgers, vectors, drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.functions import text as T
from brightloom.storage import dealt

#: The moment at which queries with a "now" are asked.
NOW = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return dealt(rows) if name in ("documents", "pages") else rows  # texts: much work a row


def now():
    return F.lit(NOW).cast("timestamp")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as items: the first line is the title; the publication day, status and url follow from the id."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("item_id"), F.col("source").alias("source_id"), F.col("lang").alias("direction"), T.first_line(F.col("text")).alias("title"), F.col("text").alias("content_text"),
        F.date_sub(F.lit("2024-02-01").cast("date"), (F.col("doc_id") % 60).cast("int")).cast("timestamp").alias("published_at"), "n_chars",
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/a/"), F.col("doc_id").cast("string")).alias("url"),
    )


ITEMS = """items AS (
  SELECT doc_id AS item_id, source AS source_id, lang AS direction, split_part(text, chr(10), 1) AS title, text AS content_text,
         (DATE '2024-02-01' - (doc_id % 60)::INT)::TIMESTAMP AS published_at, n_chars,
         'https://' || source || '.example.com/a/' || doc_id AS url
  FROM documents)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as scores: toxic rows are failed attempts; relevance mixes the label and the id."""
    s = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    relevance = (F.col("quality") * 50 + F.col("doc_id") % 50).cast("int")
    return s.select(
        F.col("doc_id").alias("score_id"), F.col("doc_id").alias("item_id"), F.col("lang").alias("direction"), F.when(F.col("toxic") == 1, "FAILED").otherwise("OK").alias("status"),
        relevance.alias("relevance"), (F.col("doc_id") * 7 % 100).cast("int").alias("quality"), (relevance >= 60).alias("passed"), (F.col("doc_id") % 2 + 1).cast("int").alias("version"),
    )


SCORES = """scores AS (
  SELECT l.doc_id AS score_id, l.doc_id AS item_id, d.lang AS direction, CASE WHEN l.toxic = 1 THEN 'FAILED' ELSE 'OK' END AS status,
         (l.quality * 50 + l.doc_id % 50)::INT AS relevance, (l.doc_id * 7 % 100)::INT AS quality,
         (l.quality * 50 + l.doc_id % 50) >= 60 AS passed, (l.doc_id % 2 + 1)::INT AS version
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a ledger of calls."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("usage_id"), F.col("event_id").alias("call_id"), F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")).alias("provider"), F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")).alias("platform"),
        F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"), F.col("event_type").alias("call_point"), F.floor("value").cast("long").alias("prompt_tokens"), (F.col("event_id") % 7).alias("completion_tokens"),
        (F.col("event_id") % 11).alias("billing_units"), (F.col("event_id") * 13 % 1000).alias("latency_ms"), (F.col("event_type") != "error").alias("ok"), F.when(F.col("event_type") == "error", F.concat(F.lit("e"), (F.col("event_id") % 4).cast("string"))).alias("error"),
        F.when(F.col("event_id") % 10 == 0, "blocked").otherwise("200").alias("status"), F.lit("author").alias("ref_type"), (F.col("user_id") % 10).alias("ref_id"), F.col("ts").cast("timestamp").alias("created_at"), F.col("ts").cast("timestamp").alias("ts"), "user_id",
    )


USAGE = """usage AS (
  SELECT event_id AS usage_id, event_id AS call_id, 'p' || (user_id % 5) AS provider, 'p' || (user_id % 5) AS platform, 'm' || (user_id % 3) AS model,
         event_type AS call_point, floor(value)::BIGINT AS prompt_tokens, event_id % 7 AS completion_tokens, event_id % 11 AS billing_units,
         event_id * 13 % 1000 AS latency_ms, event_type <> 'error' AS ok, CASE WHEN event_type = 'error' THEN 'e' || (event_id % 4) END AS error,
         CASE WHEN event_id % 10 = 0 THEN 'blocked' ELSE '200' END AS status, user_id % 10 AS ref_id, ts AS created_at, ts, user_id
  FROM events)"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as pipeline tasks."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("user_id") % 3 == 0, "fetch").when(F.col("user_id") % 3 == 1, "score").otherwise("write")
    status = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "view", "PENDING").when(F.col("event_type") == "click", "RUNNING").otherwise("DONE")
    return e.select(F.col("event_id").alias("task_id"), kind.alias("kind"), status.alias("status"), F.col("ts").cast("timestamp").alias("updated_at"), F.to_json(F.struct((F.col("user_id") % 20).alias("source_id"))).alias("payload"))


TASKS = """tasks AS (
  SELECT event_id AS task_id, CASE user_id % 3 WHEN 0 THEN 'fetch' WHEN 1 THEN 'score' ELSE 'write' END AS kind,
         CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'PENDING' WHEN 'click' THEN 'RUNNING' ELSE 'DONE' END AS status,
         ts AS updated_at, user_id % 20 AS source_id
  FROM events)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("label").alias("direction"), F.col("embedding").alias("vec"), F.concat(F.lit("g"), F.col("vec_id").cast("string"), F.when(F.col("vec_id") % 9 == 0, "#v-1").otherwise("")).alias("guid"))


VECTORS = """vectors AS (
  SELECT vec_id AS item_id, label AS direction, embedding::DOUBLE[] AS vec, 'g' || vec_id || CASE WHEN vec_id % 9 = 0 THEN '#v-1' ELSE '' END AS guid FROM embeddings)"""


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query vector per direction: that of its smallest id."""
    v = vectors(spark, sf_dir)
    return v.groupBy("direction").agg(F.min_by("vec", "item_id").alias("vec"))


QUERY_VECTORS = "query_vectors AS (SELECT direction, arg_min(vec, item_id) AS vec FROM vectors GROUP BY direction)"
