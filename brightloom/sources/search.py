"""Search answers as tables of results, and their ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.config import DEFAULTS
from brightloom.functions import dates as D
from brightloom.functions import text as T
from brightloom.operators.hot import call_status
from brightloom.operators.limits import search_quota

PAGES = "code INT, data STRUCT<webPages: STRUCT<value: ARRAY<STRUCT<name: STRING, url: STRING, snippet: STRING, summary: STRING, datePublished: STRING>>>>"
LIST = "Response STRUCT<Pages: ARRAY<STRING>>"
HIT = "title STRING, url STRING, passage STRING, content STRING, date STRING"


def _trimmed(c: str) -> Column:
    return T.strip(F.coalesce(c, F.lit("")))


def object_results(answers: DataFrame) -> DataFrame:
    """Results of answers (keyword, body) of the vendor whose hits are JSON objects."""
    rows = answers.select("keyword", F.from_json("body", PAGES).alias("j")).where("j.data IS NOT NULL AND coalesce(j.code, 200) = 200")
    v = rows.select("keyword", F.posexplode("j.data.webPages.value").alias("position", "v"))
    return v.select("keyword", "position", _trimmed("v.name").alias("title"), _trimmed("v.url").alias("url"), _trimmed("v.snippet").alias("snippet"), _trimmed("v.summary").alias("content"), D.parse_time(F.col("v.datePublished")).alias("published_at"))


def string_results(answers: DataFrame) -> DataFrame:
    """Results of the vendor whose hits are JSON inside of strings; unreadable ones are passed over."""
    pages = answers.select("keyword", F.posexplode(F.from_json("body", LIST)["Response"]["Pages"]).alias("position", "p"))
    v = pages.select("keyword", "position", F.from_json("p", HIT).alias("v"), F.col("p").rlike(r"^\s*\{").alias("ok")).where("ok AND v IS NOT NULL")
    return v.select("keyword", "position", _trimmed("v.title").alias("title"), _trimmed("v.url").alias("url"), _trimmed("v.passage").alias("snippet"), _trimmed("v.content").alias("content"), D.parse_time(F.col("v.date")).alias("published_at"))


def page_size(count: Column) -> Column:
    """Counts are rounded up to tens from 10 to 50."""
    return F.least(F.greatest(F.ceil(count / 10) * 10, F.lit(10)), F.lit(50)).cast("int")


def search_entries(results: DataFrame) -> DataFrame:
    """Entries of search results with a url: the body is the content or else the snippet; the keyword is kept."""
    rows = results.where("url <> ''")
    body = F.coalesce(F.nullif("content", F.lit("")), F.col("snippet"))
    return rows.select("position", F.col("url").alias("guid"), "url", F.substring("title", 1, 500).alias("title"), body.alias("content_text"), "published_at", F.col("keyword").alias("source_keyword"))


def search_round(calls: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, call log) of a round. ``calls`` has (provider, ts, call_id, keyword, http_code, error), ``results``
    (call_id, keyword, position, title, url, snippet, content, published_at).

    Calls beyond a quota are not made: they are logged as blocked and give no entries; nor do those that failed.
    """
    asked = search_quota(calls)
    ok = F.col("allowed") & F.col("error").isNull()
    log = asked.select("call_id", "provider", "keyword", ok.alias("ok"), F.when(~F.col("allowed"), "blocked").otherwise(call_status(F.col("http_code"), F.col("error"))).alias("status"))
    return search_entries(results.join(log.where("ok").select("call_id"), "call_id", "left_semi")), log


MAX_AGE_DAYS = DEFAULTS.search_max_age_days
