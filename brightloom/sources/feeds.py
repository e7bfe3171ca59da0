"""Feeds: RSS and Atom as tables of entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from brightloom.functions import text as T
from brightloom.operators.ingest import entry_body, entry_keys

#: Schema of one RSS item; guid and link may carry attributes.
RSS_ITEM = "guid STRUCT<_VALUE: STRING, _isPermaLink: STRING>, link STRING, title STRING, pubDate STRING, description STRING, `content:encoded` STRING"
ATOM_ENTRY = "id STRING, link ARRAY<STRUCT<_href: STRING, _rel: STRING, _VALUE: STRING>>, title STRING, published STRING, updated STRING, summary STRING, content STRING"


def looks_like_xml(body: Column, content_type: Column) -> Column:
    """The first 512 bytes start with an XML, RSS or feed mark after a byte order mark and blanks, or the type says xml."""
    head = F.regexp_replace(F.substring(body.cast("string"), 1, 512), "^\\uFEFF", "")
    return head.rlike(r"(?i)^\s*(<\?xml|<rss|<feed)") | F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("xml"))


def skip_days(body: Column) -> Column:
    """Lower-cased names of the week days on which a channel says that it rests (first 64 kB)."""
    part = F.regexp_extract(F.substring(body.cast("string"), 1, 65536), r"(?is)<skipdays>(.*?)</skipdays>", 1)
    return F.transform(F.regexp_extract_all(part, F.lit(r"(?i)<day>\s*([A-Za-z]+)\s*</day>"), F.lit(1)), F.lower)


def rests_today(body: Column, now: Column) -> Column:
    return F.array_contains(skip_days(body), F.lower(F.date_format(now, "EEEE")))


def feed_time(value: Column) -> Column:
    """Time of an RFC 822 or ISO date; null if it is neither."""
    v = F.regexp_replace(T.strip(value), r"^[A-Za-z]{3},\s*", "")
    formats = ("d MMM yyyy HH:mm:ss zzz", "d MMM yyyy HH:mm:ss xx", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(v, F.lit(f)) for f in formats])


def rss_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of RSS files: (position, id, link, title, published_at, content_text) with guid, url and fingerprint."""
    return _rss(spark.read, path)


def rss_stream(spark: SparkSession, path: str) -> DataFrame:
    """The same of the RSS files as they arrive: each file is read once, also after a restart from the checkpoint."""
    return _rss(spark.readStream, path)


def _rss(reader: DataFrameReader | DataStreamReader, path: str) -> DataFrame:
    rows = reader.format("xml").option("rowTag", "item").option("nullValue", "").schema(RSS_ITEM).load(path)
    return _entries(rows.select(F.col("guid._VALUE").alias("id"), "link", F.col("link").alias("link_alt"), "title", F.col("pubDate").alias("published"), F.lit(None).cast("string").alias("updated"), F.col("description").alias("summary"), F.col("`content:encoded`").alias("content")))


def atom_entries(spark: SparkSession, path: str) -> DataFrame:
    return _atom(spark.read, path)


def atom_stream(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom files as they arrive."""
    return _atom(spark.readStream, path)


def _atom(reader: DataFrameReader | DataStreamReader, path: str) -> DataFrame:
    rows = reader.format("xml").option("rowTag", "entry").schema(ATOM_ENTRY).load(path)
    link = F.get(F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), 0)["_href"]
    return _entries(rows.select("id", link.alias("link"), F.get("link", 0)["_href"].alias("link_alt"), "title", "published", "updated", "summary", "content"))


def _entries(rows: DataFrame) -> DataFrame:
    keyed = entry_keys(rows.withColumn("title", T.fold(F.coalesce("title", F.lit("")))).withColumn("position", F.lit(None).cast("long") if rows.isStreaming else F.monotonically_increasing_id()))
    body = entry_body(F.col("content"), F.col("summary"), F.lit(None).cast("string"))
    return keyed.withColumn("content_text", body).withColumn("published_at", F.coalesce(feed_time(F.col("published")), feed_time(F.col("updated")))).where("guid <> ''")


def page_date(html: Column) -> Column:
    """Publication time of a page from its usual meta tags and time elements."""
    names = "article:published_time|og:published_time|datePublished|date|pubdate|publishdate"
    meta = F.regexp_extract(html, rf"""(?is)<meta[^>]+(?:property|name|itemprop)=["'](?:{names})["'][^>]*content=["']([^"']+)["']""", 1)
    element = F.regexp_extract(html, r"""(?is)<time[^>]+datetime=["']([^"']+)["']""", 1)
    return feed_time(F.coalesce(F.nullif(meta, F.lit("")), F.nullif(element, F.lit(""))))
