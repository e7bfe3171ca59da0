"""Queries over sources, sinks, ingest, entries, markup and boards, most as round trips: a table is written in the form
of an outside source, read by the operator, and must give what SQL takes from the table itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.functions import text as T
from brightloom.functions import urls as U
from brightloom.operators import hot, ingest, publishing
from brightloom.operators import items as lists
from brightloom.plans import base as B
from brightloom.plans.catalog import query
from brightloom.sources import feeds, search, tables
from brightloom.storage import fresh_path

DAY = "DATE '2024-01-01' + (p_partkey % 28)::INT"


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """part as short texts with a day."""
    return B.table(spark, d, "part").select("p_partkey", "p_name", "p_brand", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 28).cast("int")).alias("day"))


def _text_file(rows: DataFrame, column: Column, name: str) -> str:
    path = fresh_path(rows.sparkSession, name)
    rows.select(column.alias("value")).write.text(path)
    return path


def _xml_files(items: DataFrame, column: Column, root: tuple[str, str], name: str) -> str:
    """The items as documents of a root element, a file for each block of 1,000 ids, as responses of sources would be."""
    path = fresh_path(items.sparkSession, name)
    documents = items.groupBy(F.floor(F.col("p_partkey") / 1000)).agg(F.concat(F.lit(root[0]), F.array_join(F.collect_list(column), ""), F.lit(root[1])).alias("value"))
    documents.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


def _joined(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


# ---- feeds ----


@query(f"""SELECT 'https://Shop.example/p?id=' || p_partkey AS guid, 'https://Shop.example/p?id=' || p_partkey AS url, p_name AS title, strftime({DAY}, '%Y-%m-%d') AS day, p_name || ' by ' || p_brand AS body,
  sha256('https://shop.example/p?id=' || p_partkey) AS fingerprint, false AS low_confidence FROM part""")
def rss_entries(spark: SparkSession, d: str) -> DataFrame:
    """Every part as an RSS item: the guid is its link with tracking and fragment, the body is markup."""
    key, rows = F.col("p_partkey").cast("string"), _parts(spark, d)
    link = _joined("https://Shop.example/p?utm_source=feed&amp;id=", key, "#top")
    item = _joined("<item><guid isPermaLink=\"false\">", link, "</guid><link>", link, "</link><title>  ", F.col("p_name"), " </title><pubDate>", F.date_format("day", "dd MMM yyyy"), " 08:00:00 GMT</pubDate><description>&lt;p&gt;", F.col("p_name"), "&lt;/p&gt; by &lt;b&gt;", F.col("p_brand"), "&lt;/b&gt;</description></item>")
    out = feeds.rss_entries(spark, _xml_files(rows, item, ("<rss><channel><title>x</title>", "</channel></rss>"), "rss"))
    return out.select("guid", "url", "title", F.date_format("published_at", "yyyy-MM-dd").alias("day"), F.col("content_text").alias("body"), "fingerprint", "low_confidence")


@query(f"""SELECT 'urn:p:' || p_partkey AS guid, 'https://shop.example/p/' || p_partkey AS url, p_name AS title, strftime({DAY}, '%Y-%m-%d') AS day,
  CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_name END AS body, sha256('https://shop.example/p/' || p_partkey) AS fingerprint FROM part""")
def atom_entries(spark: SparkSession, d: str) -> DataFrame:
    """Every part as an Atom entry: the alternate link counts, and content stands before the summary."""
    key, rows = F.col("p_partkey").cast("string"), _parts(spark, d)
    content = F.when(F.col("p_partkey") % 2 == 0, _joined("<content>", F.col("p_brand"), "</content>")).otherwise("")
    item = _joined("<entry><id>urn:p:", key, '</id><link href="https://shop.example/feed" rel="self"/><link href="https://shop.example/p/', key, '" rel="alternate"/><title>', F.col("p_name"), "</title><updated>", F.date_format("day", "yyyy-MM-dd"), "T08:00:00Z</updated><summary>", F.col("p_name"), "</summary>", content, "</entry>")
    out = feeds.atom_entries(spark, _xml_files(rows, item, ("<feed><title>x</title>", "</feed>"), "atom"))
    return out.select("guid", "url", "title", F.date_format("published_at", "yyyy-MM-dd").alias("day"), F.col("content_text").alias("body"), "fingerprint")


@query("""SELECT page_id, page_id % 6 NOT IN (4, 5) AS xml, CASE page_id % 6 WHEN 0 THEN 'monday,sunday' ELSE '' END AS skip, page_id % 6 = 0 AS rests FROM pages""")
def feed_sniffs(spark: SparkSession, d: str) -> DataFrame:
    """What looks like a feed by its first bytes or its type, and the days on which it rests (2024-01-01 is a Monday)."""
    n = F.col("page_id") % 6
    days = "<skipDays><day> Monday</day><day>Sunday </day></skipDays>"
    body = (
        F.when(n == 0, _joined(f'﻿<?xml version="1.0"?><rss><channel>{days}</channel></rss>', F.col("html"))).when(n == 1, _joined("  <RSS>", F.col("html"))).when(n == 2, "<feed>").when(n == 3, "junk")
        .when(n == 4, F.col("html")).otherwise(_joined(F.lit("x" * 512), "<rss>"))
    )
    rows = B.table(spark, d, "pages").select("page_id", body.alias("body"), F.when(n == 3, "application/XML; charset=utf-8").alias("type"))
    now = F.lit("2024-01-01 10:00:00").cast("timestamp")
    return rows.select("page_id", feeds.looks_like_xml(F.col("body"), F.col("type")).alias("xml"), F.array_join(feeds.skip_days(F.col("body")), ",").alias("skip"), feeds.rests_today(F.col("body"), now).alias("rests"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN strftime(DATE '2024-01-01' + (page_id % 300)::INT, '%Y-%m-%d') || ' 08:00:00' WHEN 1 THEN strftime(DATE '2024-01-01' + (page_id % 300)::INT, '%Y-%m-%d') || ' 00:00:00' WHEN 2 THEN NULL
  WHEN 3 THEN strftime(DATE '2024-01-01' + (page_id % 300)::INT, '%Y-%m-%d') || ' 06:30:00' END AS published FROM pages""")
def page_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates of pages from a meta element, a plain date, an unreadable one and a time element with an offset."""
    n, day = F.col("page_id") % 4, F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 300).cast("int")), "yyyy-MM-dd")
    mark = F.when(n == 0, _joined('<meta property="article:published_time" content="', day, 'T08:00:00Z">')).when(n == 1, _joined("<meta itemprop='datePublished' content='", day, "'>")).when(n == 2, '<meta name="date" content="soon">').otherwise(_joined('<time class="t" datetime="', day, 'T08:30:00+02:00">today</time>'))
    bare = F.regexp_replace("html", "(?is)<(time|meta)[^>]*>", "")
    return B.table(spark, d, "pages").select("page_id", F.date_format(feeds.page_date(F.concat(mark, bare)), "yyyy-MM-dd HH:mm:ss").alias("published"))


@query("""WITH e AS (SELECT n_regionkey, n_name, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS position FROM nation)
SELECT 'https://r.example/' || n_regionkey AS page_url, position::INT AS position, CASE WHEN n_nationkey % 2 = 0 THEN 'https://n.example/' || n_nationkey ELSE 'https://r.example/' || n_regionkey || '#e-' || substr(sha1(n_name), 1, 12) END AS guid, n_name AS title FROM e WHERE position < 3""")
def list_page_entries(spark: SparkSession, d: str) -> DataFrame:
    """The first three entries of a model's answer for each region's page; without a link the title makes the guid."""
    url = F.when(F.col("n_nationkey") % 2 == 0, _joined("https://n.example/", F.col("n_nationkey").cast("string"))).otherwise("")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", F.col("n_name").alias("title"), url.alias("url")))), lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url"), F.lit("s").alias("summary")))
    pages = B.table(spark, d, "nation").groupBy("n_regionkey").agg(F.to_json(listed).alias("entries"))
    rows = pages.select(_joined("https://r.example/", F.col("n_regionkey").cast("string")).alias("url"), "entries")
    return ingest.list_page_entries(rows, limit=3).select("page_url", "position", "guid", "title")


@query("""WITH e AS (SELECT page_id, url, 'teaser ' || page_id AS content_text, 'https://front.example/' AS page_url FROM pages), f AS (
  SELECT page_id AS k, CASE page_id % 3 WHEN 0 THEN html WHEN 1 THEN '  t' || page_id || '  ' ELSE 'teaser ' || page_id END AS full_text FROM pages)
SELECT e.page_id, CASE WHEN length(trim(f.full_text)) > length(e.content_text) THEN f.full_text ELSE e.content_text END AS content_text, length(trim(f.full_text)) > length(e.content_text) AS enriched
FROM e JOIN f ON f.k = e.page_id""")
def enriched_entries(spark: SparkSession, d: str) -> DataFrame:
    """A fetched text replaces a teaser only if it is strictly longer, blanks at its ends not counted."""
    key, own = F.col("page_id").cast("string"), _joined("https://e.example/", F.col("page_id").cast("string"))
    pages = B.table(spark, d, "pages")
    entries = pages.select("page_id", own.alias("url"), _joined("teaser ", key).alias("content_text"), F.lit("https://front.example/").alias("page_url"))
    full = F.when(F.col("page_id") % 3 == 0, F.col("html")).when(F.col("page_id") % 3 == 1, _joined("  t", key, "  ")).otherwise(_joined("teaser ", key))
    return ingest.enriched(entries, pages.select(own.alias("url"), full.alias("full_text"))).select("page_id", "content_text", "enriched")


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'c' || page_id WHEN page_id % 3 = 1 THEN 's' || page_id ELSE 'd' || page_id END AS body,
  CASE page_id % 8 WHEN 0 THEN 'error' WHEN 1 THEN 'not_modified' WHEN 2 THEN 'rate_limited' WHEN 3 THEN 'ok' WHEN 4 THEN 'redirect' WHEN 5 THEN 'fatal' WHEN 6 THEN 'retryable' ELSE 'semantic' END AS outcome FROM pages""")
def entry_bodies_and_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Content stands before summary and description; responses by class, 501 and 408 among what is not tried again."""
    n, key = F.col("page_id"), F.col("page_id").cast("string")
    body = ingest.entry_body(F.when(n % 3 == 0, _joined("<p>c", key, "</p>")).otherwise(""), F.when(n % 3 <= 1, _joined("<i>s", key, "</i>")), _joined("d", key))
    status = F.when(n % 8 == 1, 304).when(n % 8 == 2, 429).when(n % 8 == 3, 204).when(n % 8 == 4, 302).when(n % 8 == 5, F.when(n % 16 == 5, 401).otherwise(403)).when(n % 8 == 6, F.when(n % 16 == 6, 500).otherwise(504)).when(n % 8 == 7, F.when(n % 16 == 7, 501).otherwise(408))
    return B.table(spark, d, "pages").select("page_id", body.alias("body"), ingest.http_outcome(status, F.lit(None).cast("string")).alias("outcome"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN sha256('https://a.example/' || p_partkey) WHEN 1 THEN sha256('https://b.example/' || p_partkey) ELSE 'ttl:' || substr(sha256('A & B ' || p_name), 1, 60) END AS fingerprint,
  p_partkey % 4 >= 2 AS low_confidence, CASE p_partkey % 4 WHEN 0 THEN 'id' || p_partkey WHEN 1 THEN 'https://b.example/' || p_partkey WHEN 2 THEN 'alt' || p_partkey ELSE '' END AS guid FROM part""")
def entry_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """The chain link, guid, title: a title is decoded and folded first and marks the fingerprint as weak."""
    n, key = F.col("p_partkey"), F.col("p_partkey").cast("string")
    link = F.when(n % 4 == 0, _joined("HTTPS://A.example/", key, "?utm_medium=x")).otherwise("")
    entry_id = F.when(n % 4 == 0, _joined(" id", key, " ")).when(n % 4 == 1, _joined("https://b.example/", key, "#f")).otherwise("")
    alt = F.when(n % 4 == 2, _joined("alt", key)).otherwise("")
    rows = B.table(spark, d, "part").select("p_partkey", U.normalize_url(link).alias("link"), U.normalize_guid(entry_id, link, alt).alias("guid"), U.fold_title(_joined("Ａ &amp;  B\n", F.col("p_name"))).alias("t"))
    return rows.withColumn("e", U.entry_fingerprint(F.col("link"), F.col("guid"), F.col("t"))).select("p_partkey", "e.fingerprint", "e.low_confidence", "guid")


@query("""WITH w AS (SELECT unnest([1, 1, 2, 3, 3, 3]) AS g, unnest([1, 2, 3, 4, 5, 6]) AS seq, unnest(['a', 'b', 'c', 'd', 'e', 'f']) AS name)
SELECT n_nationkey AS source_id, w.seq AS position FROM nation, w WHERE w.seq = (SELECT min(x.seq) FROM w x WHERE x.g = w.g) AND NOT (w.g = 2 AND n_nationkey % 2 = 0)""")
def new_feed_entries(spark: SparkSession, d: str) -> DataFrame:
    """Of entries with equal guids the first; none that is known, none without a guid."""
    shown = F.explode(F.array(*[F.struct(F.lit(g).alias("g"), F.lit(s).alias("position")) for s, g in enumerate((1, 1, 2, 3, 3, 3), 1)], F.struct(F.lit(0).alias("g"), F.lit(7).alias("position")))).alias("e")
    rows = B.table(spark, d, "nation").select(F.col("n_nationkey").alias("source_id"), shown).select("source_id", F.when(F.col("e.g") > 0, _joined("g", F.col("e.g").cast("string"))).otherwise("").alias("guid"), "e.position")
    known = B.table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("source_id"), F.lit("g2").alias("guid"))
    return ingest.new_entries(rows, known).select("source_id", "position")


# ---- search ----


@query(f"""SELECT 'k' || (p_partkey % 9) AS source_keyword, 'https://s.example/' || p_partkey AS guid, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN 'long ' || p_brand ELSE p_name END AS body, strftime({DAY}, '%Y-%m-%d %H:%M:%S') AS published FROM part WHERE p_partkey % 5 <> 0""")
def search_objects(spark: SparkSession, d: str) -> DataFrame:
    """Answers of the vendor whose hits are JSON objects, as entries: hits without url go, so do answers with an error."""
    n = F.col("p_partkey")
    hit = F.struct(_joined(" ", F.col("p_name"), " ").alias("name"), F.when(n % 5 == 0, "").otherwise(_joined("https://s.example/", n.cast("string"))).alias("url"), F.col("p_name").alias("snippet"), F.when(n % 2 == 0, _joined("long ", F.col("p_brand"))).alias("summary"), F.date_format("day", "yyyy-MM-dd'T'HH:mm:ss").alias("datePublished"))
    body = F.to_json(F.struct(F.lit(200).alias("code"), F.struct(F.struct(F.collect_list(hit).alias("value")).alias("webPages")).alias("data")))
    answers = _parts(spark, d).groupBy(_joined("k", (n % 9).cast("string")).alias("keyword")).agg(body.alias("body"))
    broken = spark.createDataFrame([("bad", '{"code": 500, "data": {"webPages": {"value": [{"name": "x", "url": "https://x"}]}}}'), ("odd", "no json")], "keyword string, body string")
    out = search.search_entries(search.object_results(answers.unionByName(broken)))
    return out.select("source_keyword", "guid", "title", F.col("content_text").alias("body"), F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published"))


@query("""SELECT 'k' || (p_partkey % 9) AS keyword, p_name AS title, 'https://s.example/' || p_partkey AS url, p_brand AS snippet, least(greatest(ceil(p_partkey % 70 / 10.0) * 10, 10), 50)::INT AS page_size FROM part WHERE p_partkey % 7 <> 0""")
def search_strings(spark: SparkSession, d: str) -> DataFrame:
    """Answers of the vendor whose hits are JSON in strings: unreadable ones are passed over; counts round up to tens."""
    n = F.col("p_partkey")
    hit = F.when(n % 7 == 0, "no json").otherwise(F.to_json(F.struct(F.col("p_name").alias("title"), _joined("https://s.example/", n.cast("string")).alias("url"), F.col("p_brand").alias("passage"))))
    answers = _parts(spark, d).groupBy(_joined("k", (n % 9).cast("string")).alias("keyword")).agg(F.to_json(F.struct(F.struct(F.collect_list(hit).alias("Pages")).alias("Response"))).alias("body"))
    out = search.string_results(answers)
    asked = F.regexp_extract("url", "([0-9]+)$", 1).cast("long") % 70
    return out.select("keyword", "title", "url", "snippet", search.page_size(asked).alias("page_size"))


# ---- tables in and out ----


@query("""SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation WHERE n_nationkey % 3 <> 0""")
def json_lines_reload(spark: SparkSession, d: str) -> DataFrame:
    """A table exported as tagged JSON lines and read back beside a table that holds every third row."""
    rows = B.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    path = fresh_path(spark, "json-lines")
    tables.export_json_lines({"nation": rows, "region": B.table(spark, d, "region")}, path)
    return tables.reload_json_lines(spark, path, "nation", "id INT, name STRING, region INT", rows.where("id % 3 = 0"))


@query("""SELECT p_partkey::VARCHAR AS id, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN '1' ELSE '0' END AS flag, p_name || chr(9) || '\\' || chr(10) || p_brand AS body,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'x' END AS last, CASE WHEN p_partkey % 5 = 0 THEN 3 WHEN p_partkey % 5 = 1 THEN 5 ELSE 4 END::INT AS n_fields FROM part""")
def dump_rows(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a dump's text format: escapes, nulls, booleans, short and long rows."""
    n = F.col("p_partkey")
    flag = F.when(n % 3 == 0, "\\N").when(n % 3 == 1, "t").otherwise("f")
    line = _joined(n.cast("string"), "\t", flag, "\t", F.col("p_name"), "\\t\\\\\\n", F.col("p_brand"), F.when(n % 5 == 0, "").otherwise("\tx"), F.when(n % 5 == 1, "\tmore").otherwise(""))
    path = _text_file(B.table(spark, d, "part"), line, "dump")
    return tables.read_dump_rows(spark, path, [("id", "bigint"), ("flag", "boolean"), ("body", "text"), ("last", "text")])


@query("""SELECT s_suppkey AS path FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey % 10 DESC, s_suppkey) AS k FROM supplier) WHERE k > 7""")
def expired_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots beyond the seven newest."""
    at = F.timestamp_seconds(F.col("s_suppkey") % 10).alias("modified_at")
    return tables.expired_snapshots(B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("path"), at), 7).select("path")


@query("""SELECT n_nationkey, n_name || '你好' || CASE WHEN n_nationkey % 2 = 0 THEN '�' ELSE '' END AS text FROM nation""")
def gbk_decoded(spark: SparkSession, d: str) -> DataFrame:
    """GBK bytes as text; a byte that is none becomes a replacement character."""
    raw = F.concat(F.encode("n_name", "US-ASCII"), F.unhex(F.lit("C4E3BAC3")), F.when(F.col("n_nationkey") % 2 == 0, F.unhex(F.lit("FF"))).otherwise(F.lit("").cast("binary")))
    return B.table(spark, d, "nation").select("n_nationkey", tables.decoded(raw).alias("text"))


@query(f"""WITH {B.VECTORS} SELECT item_id, 1.0::DOUBLE AS norm, round((list_sum(vec) / sqrt(list_inner_product(vec, vec)))::DOUBLE, 6) AS total, (64 * 4 * 3)::BIGINT AS bytes FROM vectors""")
def vector_cache(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written as a cache of unit vectors and read back; three of a kind take so many bytes."""
    from brightloom.functions import vectors as V

    path = fresh_path(spark, "vector-cache")
    tables.vector_cache(B.vectors(spark, d), path)
    total = F.round(F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x), 6)
    return spark.read.parquet(path).select("item_id", F.round(V.norm(F.col("vec")), 9).alias("norm"), total.alias("total"), V.storage_bytes(F.size("vec"), F.lit(3)).alias("bytes"))


@query(f"""WITH {B.ITEMS} SELECT item_id, title, content_text AS body, CASE WHEN trim(regexp_replace(title || chr(10) || content_text, '\\s+', ' ', 'g')) = '' THEN '' ELSE 'en' END AS lang FROM items WHERE item_id % 3 = 0
UNION ALL SELECT page_id, 'p', html, 'zh' FROM pages WHERE length(html) >= 900""")
def corpus_rows(spark: SparkSession, d: str) -> DataFrame:
    """Finished items with their fuller body and its language, and pages of enough length as a second corpus."""
    rows = B.items(spark, d).where("item_id % 3 <= 1").select("item_id", "title", F.when(F.col("item_id") % 2 == 0, F.col("content_text")).alias("full_text"), "content_text", F.when(F.col("item_id") % 3 == 0, "DONE").otherwise("NEW").alias("status"))
    second = B.table(spark, d, "pages").select(F.col("page_id").alias("item_id"), F.lit("p").alias("title"), F.col("html").alias("body"))
    return tables.corpus(rows, second, second_min_chars=900)


@query("""SELECT n_name AS title, 'b' || n_nationkey AS body FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey % 2 = 0""")
def csv_rows(spark: SparkSession, d: str) -> DataFrame:
    """CSV files with a header; rows whose title or body is blank go."""
    n = F.col("n_nationkey")
    rows = B.table(spark, d, "nation").select(F.when(n % 3 == 0, F.col("n_name")).otherwise("  ").alias("title"), F.when(n % 2 == 0, _joined("b", n.cast("string"))).alias("body"))
    path = fresh_path(spark, "csv")
    rows.write.option("header", True).csv(path)
    return tables.read_csv(spark, path, "title STRING, body STRING", body="body")


@query("""SELECT 'K' || k AS key, CASE WHEN k % 2 = 0 THEN 'v' ELSE 'w' END || k AS value FROM (SELECT DISTINCT n_nationkey % 10 AS k FROM nation)""")
def env_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Lines of KEY=value and KEY value; the first of a key counts, comments do not."""
    n, k = F.col("n_nationkey"), (F.col("n_nationkey") % 10).cast("string")
    late = F.when(n >= 10, "late").otherwise("")
    line = F.when(n % 2 == 0, _joined(" K", k, " = v", k, late, " ")).otherwise(_joined("K", k, " w", k, late))
    rows = B.table(spark, d, "nation").select(n.alias("position"), line.alias("line"))
    return tables.env_pairs(rows.unionByName(spark.createDataFrame([(-1, "# K1=no"), (-2, "  "), (-3, "=x")], rows.schema)))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_acctbal WHEN 1 THEN c_nationkey ELSE NULL END AS balance FROM customer""")
def provider_balances(spark: SparkSession, d: str) -> DataFrame:
    """The amount in CNY wherever it stands, else the first one, else none."""
    n, entry = F.col("c_custkey"), lambda c, v: F.struct(F.lit(c).alias("currency"), v.cast("string").alias("total_balance"))
    own = F.when(n % 3 == 0, F.array(entry("USD", F.col("c_nationkey")), entry("CNY", F.col("c_acctbal")))).when(n % 3 == 1, F.array(entry("USD", F.col("c_nationkey")), entry("EUR", F.col("c_acctbal")))).otherwise(F.array().cast("array<struct<currency:string,total_balance:string>>"))
    return B.table(spark, d, "customer").select("c_custkey", tables.balance(F.to_json(F.struct(own.alias("balance_infos")))).alias("balance"))


@query("""SELECT 'Customer' || (o_custkey % 100) || '_' || strftime(o_orderdate, '%Y%m%d') || '_run' || o_orderkey || '_draft.md' AS name,
  '---' || chr(10) || 'author: Customer ' || (o_custkey % 100) || chr(10) || 'write_run: ' || o_orderkey || chr(10) || 'date: ' || strftime(o_orderdate, '%Y-%m-%d') || chr(10) || 'kind: draft' || chr(10) || 'note: ' || o_orderpriority || chr(10) || '---' || chr(10) || chr(10) || o_orderstatus || chr(10) AS text FROM orders""")
def markdown_documents(spark: SparkSession, d: str) -> DataFrame:
    """Drafts as markdown files with a head."""
    rows = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), _joined("Customer ", (F.col("o_custkey") % 100).cast("string")).alias("author"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.lit("draft").alias("kind"), F.col("o_orderpriority").alias("note"), F.col("o_orderstatus").alias("body"))
    return tables.markdown_documents(rows)


# ---- output ----


@query(f"""SELECT p_partkey AS article_id, '<item><title>' || p_name || ' &amp; &lt;b&gt;</title><link>https://b.example/article/' || p_partkey || '</link><guid>https://b.example/article/' || p_partkey || '</guid><pubDate>' || strftime({DAY}, '%d %b %Y') || ' 00:00:00 GMT</pubDate><description>' || p_name || '.</description></item>' AS xml,
  '<url><loc>https://b.example/article/' || p_partkey || '</loc><lastmod>' || strftime({DAY}, '%Y-%m-%d') || '</lastmod></url>' AS url_xml,
  CASE p_partkey % 3 WHEN 0 THEN 'User-agent: *' || chr(10) || 'Disallow: /' || chr(10) ELSE 'User-agent: *' || chr(10) || 'Allow: /' || chr(10) || 'Sitemap: https://b.example/sitemap.xml' || chr(10) END AS robots FROM part""")
def feed_sitemap_robots(spark: SparkSession, d: str) -> DataFrame:
    """Items of the output feed with their first sentence, entries of the sitemap, and robots.txt by public mode."""
    rows = _parts(spark, d).select(F.col("p_partkey").alias("article_id"), _joined(F.col("p_name"), " & <b>").alias("title"), F.col("day").cast("timestamp").alias("created_at"), _joined(F.col("p_name"), ".! more").alias("text"))
    rows = rows.withColumn("text", F.replace("text", F.lit(".!"), F.lit(".\n；"))).withColumn("text", F.regexp_replace("text", "\\.\n；.*", "."))
    mode = F.when(F.col("article_id") % 3 == 0, "x").when(F.col("article_id") % 3 == 1, " b").otherwise("C")
    marks = rows.select("article_id", publishing.robots_text(lists.public_mode(mode), "https://b.example").alias("robots"))
    return publishing.feed_items(rows, "https://b.example").join(publishing.sitemap_urls(rows, "https://b.example").withColumnRenamed("xml", "url_xml"), "article_id").join(marks, "article_id")


@query("""WITH o AS (SELECT n_name AS name, n_regionkey AS v FROM nation WHERE n_nationkey < 15), i AS (SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey ELSE 99 END AS v FROM nation WHERE n_nationkey >= 10)
SELECT coalesce(i.name, o.name) AS name, '{"v":' || coalesce(i.v, o.v) || '}' AS document, CASE WHEN o.name IS NULL THEN 'inserted' WHEN i.name IS NULL THEN 'kept' WHEN i.v = o.v THEN 'same' ELSE 'updated' END AS change FROM o FULL JOIN i USING (name)""")
def author_upserts(spark: SparkSession, d: str) -> DataFrame:
    """Imported documents replace those of the same name."""
    n = F.col("n_nationkey")
    doc = lambda v: _joined('{"v":', v.cast("string"), "}")
    rows = B.table(spark, d, "nation")
    return publishing.upsert_authors(rows.where(n < 15).select(F.col("n_name").alias("name"), doc(F.col("n_regionkey")).alias("document")), rows.where(n >= 10).select(F.col("n_name").alias("name"), doc(F.when(n % 2 == 0, F.col("n_regionkey")).otherwise(99)).alias("document")))


@query("""SELECT n_name AS name, 'b' AS key, n_regionkey::VARCHAR AS before, NULL AS after FROM nation UNION ALL SELECT n_name, 'c', NULL, '1' FROM nation UNION ALL SELECT n_name, 'd', '0', n_nationkey::VARCHAR FROM nation WHERE n_nationkey <> 0""")
def author_differences(spark: SparkSession, d: str) -> DataFrame:
    """Members that differ between two versions of a document: gone, new and changed ones."""
    rows = B.table(spark, d, "nation")
    doc = lambda *pairs: F.to_json(F.struct(*[v.alias(k) for k, v in pairs]))
    same = ("a", F.lit(7))
    before, after = doc(same, ("b", F.col("n_regionkey")), ("d", F.lit(0))), doc(same, ("c", F.lit(1)), ("d", F.col("n_nationkey")))
    return publishing.document_differences(rows.select(F.col("n_name").alias("name"), before.alias("document")), rows.select(F.col("n_name").alias("name"), after.alias("document")))


@query("""SELECT 'source-' || (user_id % 20) AS dedupe_key, CASE user_id % 3 WHEN 0 THEN 'source_recovered' WHEN 1 THEN 'source_suspect' ELSE 'source_hard_fail' END AS category, event_id AS round_id FROM events WHERE event_type = 'error'""")
def alert_events(spark: SparkSession, d: str) -> DataFrame:
    """Changes of sources that are worth a notice."""
    n = F.col("user_id")
    event = F.when(F.col("event_type") == "error", F.when(n % 3 == 0, "recovered").when(n % 3 == 1, "suspect").otherwise("hard_failed"))
    return publishing.alert_events(B.table(spark, d, "events").select((n % 20).alias("source_id"), F.col("event_id").alias("round_id"), event.alias("event")))


@query(f"""WITH {B.USAGE}, d AS (SELECT strftime(created_at, '%Y-%m-%d') AS day, sum(prompt_tokens)::BIGINT AS tokens FROM usage GROUP BY 1)
SELECT 'token_budget' AS category, 'daily-' || day AS dedupe_key FROM d WHERE tokens >= (SELECT floor(avg(tokens)) FROM d) UNION ALL SELECT 'reconcile', 'reconcile-' || d.day FROM d WHERE tokens % 3 = 0""")
def budget_and_reconcile_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Days that used up the mean of all days, and periods whose bill deviates."""
    days = B.usage(spark, d).groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.sum("prompt_tokens").alias("tokens"))
    budget = int(days.agg(F.floor(F.avg("tokens"))).first()[0] or 0)
    return publishing.budget_alerts(days, budget).unionByName(publishing.reconcile_alerts(days.select(F.col("day").alias("month"), (F.col("tokens") % 3 == 0).alias("alert"))))


@query("""SELECT n_name AS key, CASE WHEN n_nationkey IN (1, 3) THEN '' ELSE 'v' || n_nationkey END AS value FROM nation""")
def backup_settings(spark: SparkSession, d: str) -> DataFrame:
    """Settings as a backup holds them."""
    rows = B.table(spark, d, "nation").select(F.col("n_name").alias("key"), _joined("v", F.col("n_nationkey").cast("string")).alias("value"))
    return tables.without_secrets(rows, ["NATION_1", "NATION_3", "none"])


_CALLS = """c AS (SELECT event_id AS call_id, 'p' || (user_id % 5) AS provider, ts, event_type = 'error' AS bad FROM events), m AS (SELECT *, row_number() OVER (PARTITION BY provider, date_trunc('minute', ts) ORDER BY ts, call_id) <= 8 AS a FROM c),
q AS (SELECT *, a AND row_number() OVER (PARTITION BY provider, date_trunc('day', ts), a ORDER BY ts, call_id) <= 200 AS allowed FROM m)"""


def _search_round(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n, bad = F.col("event_id"), F.col("event_type") == "error"
    e = B.table(spark, d, "events")
    calls = e.select(n.alias("call_id"), _joined("p", (F.col("user_id") % 5).cast("string")).alias("provider"), F.col("ts").cast("timestamp").alias("ts"), F.lit("k").alias("keyword"), F.when(bad & (n % 2 == 0), 503).otherwise(F.when(~bad, 200)).alias("http_code"), F.when(bad, "ReadTimeout").alias("error"))
    hit = lambda i: F.struct(F.lit(i).alias("position"), F.when(n % 3 == i, "").otherwise(_joined("https://s.example/", n.cast("string"), f"/{i}")).alias("url"))
    results = e.select(n.alias("call_id"), F.lit("k").alias("keyword"), F.explode(F.array(hit(0), hit(1))).alias("h")).select("call_id", "keyword", "h.position", F.lit("t").alias("title"), "h.url", F.lit("s").alias("snippet"), F.lit("").alias("content"), F.lit(None).cast("timestamp").alias("published_at"))
    return search.search_round(calls, results)


@query(f"""WITH {_CALLS} SELECT 'https://s.example/' || call_id || '/' || i AS guid, 's' AS body FROM q, (SELECT unnest([0, 1]) AS i) WHERE allowed AND NOT bad AND call_id % 3 <> i""")
def search_round_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the calls that the quotas let through."""
    return _search_round(spark, d)[0].select("guid", F.col("content_text").alias("body"))


@query(f"""WITH {_CALLS} SELECT call_id, allowed AND NOT bad AS ok, CASE WHEN NOT allowed THEN 'blocked' WHEN NOT bad THEN '200' WHEN call_id % 2 = 0 THEN '503' ELSE 'ReadTimeout' END AS status FROM q""")
def search_round_log(spark: SparkSession, d: str) -> DataFrame:
    """The log of all calls of a search round, made or blocked."""
    return _search_round(spark, d)[1].select("call_id", "ok", "status")


# ---- boards ----


@query("""WITH t AS (SELECT c_nationkey, c_name, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rank FROM customer WHERE c_custkey % 5 <> 0)
SELECT 'n' || c_nationkey AS platform, rank::INT AS rank, c_name AS title, 'u' || c_custkey AS url, rank <= 20 AS keyword_contrib,
  CASE c_custkey % 5 WHEN 1 THEN c_custkey::DOUBLE WHEN 2 THEN c_custkey + 0.5 WHEN 3 THEN c_custkey / 2.0 ELSE NULL END AS heat FROM t""")
def hot_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Boards of a batch: rows without a title go, ranks follow the position, and the heat is a number or a text that is one."""
    n, key = F.col("c_custkey"), F.col("c_custkey").cast("string")
    extra = F.when(n % 5 == 1, _joined('{"info": ', key, "}")).when(n % 5 == 2, _joined('{"info": true, "hover": " ', key, '.5 "}')).when(n % 5 == 3, _joined('{"info": "', key, '亿热度", "hover": ', (n / 2).cast("string"), "}")).otherwise(_joined('{"info": "about ', key, '"}'))
    entry = F.struct("c_custkey", F.when(n % 5 == 0, " ").otherwise(_joined(" ", F.col("c_name"))).alias("title"), _joined("u", key).alias("url"), extra.alias("extra"))
    body = F.to_json(F.transform(F.array_sort(F.collect_list(entry)), lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url"), x["extra"].alias("extra"))))
    boards = B.table(spark, d, "customer").groupBy("c_nationkey").agg(body.alias("body")).select(F.lit(1).alias("batch"), _joined("n", F.col("c_nationkey").cast("string")).alias("platform"), "body")
    return hot.snapshot(boards).select("platform", "rank", "title", "url", "keyword_contrib", hot.heat(F.col("extra")).alias("heat"))


@query("""WITH t AS (SELECT c_nationkey, c_name, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rank FROM customer)
SELECT 'n' || c_nationkey AS platform, string_agg('[n' || c_nationkey || '#' || rank || '] ' || c_name || CASE c_custkey % 4 WHEN 0 THEN ' (' || c_custkey || ' views and more and more and more and mor' [1:40 - length(c_custkey::VARCHAR)] || ')' WHEN 1 THEN '' WHEN 2 THEN ' (True)' ELSE ' (h' || c_custkey || ')' END, chr(10) ORDER BY rank) AS text FROM t WHERE rank <= 20 GROUP BY c_nationkey""")
def hot_keyword_input(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a keyword request: platform, rank, title and what info or else hover says, cut at 40 characters."""
    n, key = F.col("c_custkey"), F.col("c_custkey").cast("string")
    extra = F.when(n % 4 == 0, _joined('{"info": "', key, ' views and more and more and more and more and more"}')).when(n % 4 == 1, '{"info": 0, "hover": ""}').when(n % 4 == 2, '{"info": true}').otherwise(_joined('{"info": null, "hover": "h', key, '"}'))
    rows = lists.top_per_group(B.table(spark, d, "customer").select(_joined("n", F.col("c_nationkey").cast("string")).alias("platform"), n, F.col("c_name").alias("title"), extra.alias("extra")), ["platform"], [F.col("c_custkey")], 10**6)
    return hot.keyword_input(rows)


@query("""WITH t AS (SELECT event_id AS topic_id, CASE event_type WHEN 'view' THEN 50 WHEN 'click' THEN 40 ELSE 10 END AS s FROM events)
SELECT topic_id, CASE topic_id % 3 WHEN 0 THEN '503' WHEN 1 THEN 'TimeoutError' ELSE 'AVeryLongErrorClassN' END AS status, CASE WHEN topic_id % 2 = 0 THEN 2 ELSE 20 END AS kept FROM t WHERE s >= 40""")
def hot_filters(spark: SparkSession, d: str) -> DataFrame:
    """Topics with a score of at least 40, the status of their calls, and how many keywords of a model's list count."""
    n = F.col("event_id")
    topics = B.table(spark, d, "events").select(n.alias("topic_id"))
    scores = B.table(spark, d, "events").select(n.alias("topic_id"), F.when(F.col("event_type") == "view", 50).when(F.col("event_type") == "click", 40).otherwise(10).alias("rank_score"))
    few, many = '[" a ", "", "b", "  "]', "[" + ", ".join(f'"w{i}"' for i in range(30)) + "]"
    i = F.col("topic_id")
    status = hot.call_status(F.when(i % 3 == 0, 503), F.when(i % 3 == 1, "TimeoutError").otherwise("AVeryLongErrorClassName"))
    return hot.relevant_topics(topics, scores).select("topic_id", status.alias("status"), F.size(hot.model_keywords(F.when(i % 2 == 0, few).otherwise(many))).alias("kept"))


@query()
def fuzzy_titles(spark: SparkSession, d: str) -> DataFrame:
    """Names of a length bucket that resemble each other; tested against a loop."""
    return ingest.fuzzy_title_pairs(B.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title")))


@query()
def rare_title_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Titles that share rare words and resemble each other a little; tested against a loop."""
    rows = B.items(spark, d)
    return ingest.with_resemblance(ingest.title_pairs(rows), rows, 0.35)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'key=***,' || p_name WHEN p_partkey % 3 = 1 THEN p_name ELSE p_brand END AS scrubbed, 'x</document' || chr(8203) || '>' || p_name || '<document' || chr(8203) || ' id="1"><Document>' AS broken,
  CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN 'A heading' WHEN 2 THEN repeat('长', 20) WHEN 3 THEN repeat('x', 40) ELSE '（无题）' END AS title, p_name || ' &lt;b>x&lt;/b> 1 < 2' AS escaped, CASE WHEN p_partkey % 2 = 0 THEN '{"a": {"b": 1}}' END AS json FROM part""")
def text_forms(spark: SparkSession, d: str) -> DataFrame:
    """Secrets, frames, titles of articles, tags and JSON blocks."""
    n, name = F.col("p_partkey"), F.col("p_name")
    title = F.when(n % 5 == 0, _joined("\n\n## ", name, "[^1]\nbody")).when(n % 5 == 1, "  A heading \r\nmore").when(n % 5 == 2, "长" * 20 + "，" + "短" * 30).when(n % 5 == 3, "x" * 60).otherwise(" \n#\n")
    return B.table(spark, d, "part").select(
        "p_partkey", T.scrub(F.when(n % 3 == 0, _joined("key=sk-1,", name)).when(n % 3 == 1, name).otherwise(F.col("p_brand")), ["sk-1", ""]).alias("scrubbed"), T.break_delimiters(_joined("x</document>", name, '<document id="1"><Document>')).alias("broken"),
        T.article_title(title).alias("title"), T.escape_tags(_joined(name, " <b>x</b> 1 < 2")).alias("escaped"), T.json_block(F.when(n % 2 == 0, 'text {"a": {"b": 1}} more').otherwise("} none {")).alias("json"),
    )


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN NULL ELSE true END AS public FROM events""")
def public_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Addresses outside of the reserved ranges."""
    n, low = F.col("event_id"), (F.col("event_id") % 250).cast("string")
    address = F.when(n % 5 == 0, _joined("8.8.8.", low)).when(n % 5 == 1, _joined("172.31.0.", low)).when(n % 5 == 2, _joined("100.127.1.", low)).when(n % 5 == 3, _joined("1.2.3.4", low, "9")).otherwise(_joined("172.32.0.", low))
    return B.table(spark, d, "events").select("event_id", U.ipv4_is_public(F.when(n % 5 == 3, "300.1.1.1").otherwise(address)).alias("public"))
