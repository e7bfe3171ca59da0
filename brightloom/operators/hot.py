"""Trending boards: snapshots, heat, keywords, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.config import DEFAULTS
from brightloom.functions import text as T

# fixed values: words that are no keywords
STOP_WORDS = (
    "的", "了", "和", "是", "在", "上", "中", "与", "及", "或", "等", "对", "为", "被", "把",
    "将", "从", "到", "更", "最", "也", "都", "而", "不", "有", "就", "要", "会", "能", "可",
    "这", "那", "你", "我", "他", "她", "它", "们", "吗", "呢", "吧", "啊", "之", "其", "以",
    "如何", "什么", "怎么", "为何", "为什么", "关于", "通过", "进行", "出现", "成为", "视频",
    "图片", "合集", "直播", "热搜", "榜单", "排行", "the", "and", "for", "with", "from",
    "that", "this", "are", "was", "were", "have", "has", "will", "your", "you",
)
TOKEN = r"[0-9A-Za-z_]+|[一-鿿]{2,}"


def snapshot(boards: DataFrame, contribute: int = DEFAULTS.hot_keywords_per_platform) -> DataFrame:
    """(batch, platform, rank, title, url, keyword_contrib, extra) of JSON boards: rows with a title, ranked by position."""
    schema = "array<struct<title:string,url:string,extra:string>>"
    rows = boards.select("batch", "platform", F.filter(F.from_json("body", schema), lambda r: T.strip(F.coalesce(r["title"], F.lit(""))) != "").alias("rs"))
    rows = rows.select("batch", "platform", F.posexplode("rs").alias("at", "r"))
    return rows.select("batch", "platform", (F.col("at") + 1).alias("rank"), T.strip(F.col("r.title")).alias("title"), "r.url", (F.col("at") < contribute).alias("keyword_contrib"), "r.extra")


def heat(extra: Column) -> Column:
    """The number in ``info``, else in ``hover``, of a topic's JSON: one of JSON or a whole text that is a number.

    Booleans, and texts with anything beside the number, have none.
    """
    def number(name: str) -> Column:
        raw = T.strip(F.get_json_object(extra, f"$.{name}"))
        return F.when(raw.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), raw.try_cast("double"))

    return F.coalesce(number("info"), number("hover"))


def title_tokens(title: Column) -> Column:
    """Keyword candidates in order: lower-cased ASCII words of over one character, bigrams of CJK runs; no numbers and
    no stop words."""
    found = F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(f"({TOKEN})"), F.lit(1))
    ascii_word = lambda s: s.rlike("^[0-9A-Za-z_]+$")
    grams = F.flatten(F.transform(found, lambda s: F.when(s.rlike("^[0-9]+$"), F.array().cast("array<string>")).when(ascii_word(s), F.array(F.lower(s))).otherwise(T.ngrams(s, 2))))
    return F.filter(grams, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))


def keywords(topics: DataFrame, order: list[str], limit: int = 15, by: list[str] | None = None) -> DataFrame:
    """(keyword, n, rank): the most frequent title tokens, ties by first appearance in the given order."""
    by = by or []
    rows = topics.select(*by, F.struct(*order).alias("_at"), F.posexplode(title_tokens(F.col("title"))).alias("_pos", "keyword"))
    counts = rows.groupBy(*by, "keyword").agg(F.count("*").alias("n"), F.min(F.struct("_at", "_pos")).alias("_first"))
    if by:
        w = Window.partitionBy(*by).orderBy(F.desc("n"), "_first")
        return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).drop("_first")
    top = counts.orderBy(F.desc("n"), "_first").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "_first"))).drop("_first")


def keyword_input(topics: DataFrame, per_platform: int = DEFAULTS.hot_keywords_per_platform) -> DataFrame:
    """(platform, text): a line for each of the first topics of a platform, with the text of its heat where there is one.

    The heat is what ``info`` says or else ``hover``, in 40 characters; empty texts, zeros, false and null say nothing.
    """
    def said(name: str) -> Column:
        value, kind = F.try_variant_get(F.try_parse_json("extra"), f"$.{name}", "string"), T.variant_kind(F.try_variant_get(F.try_parse_json("extra"), f"$.{name}", "variant"))
        nothing = (kind == "void") | (value == "") | ((kind == "boolean") & (value == "false")) | (~kind.isin("string", "boolean") & (value.try_cast("double") == 0))
        return F.when(~F.coalesce(nothing, F.lit(False)), F.when(kind == "boolean", "True").otherwise(value))

    shown = F.coalesce(F.concat(F.lit(" ("), F.substring(F.coalesce(said("info"), said("hover")), 1, 40), F.lit(")")), F.lit(""))
    line = F.concat(F.lit("["), F.col("platform"), F.lit("#"), F.col("rank").cast("string"), F.lit("] "), F.col("title"), shown)
    top = topics.where(F.col("rank") <= per_platform)
    return top.groupBy("platform").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))


def model_keywords(answer: Column, limit: int = 20) -> Column:
    """Trimmed keywords of a model's JSON list, without blanks, at most ``limit``."""
    return F.slice(F.filter(F.transform(F.from_json(answer, "array<string>"), T.strip), lambda x: x != ""), 1, limit)


def relevant_topics(topics: DataFrame, scores: DataFrame, minimum: float = 40) -> DataFrame:
    """Topics scored at least ``minimum``; all topics if there is none."""
    hits = scores.where(F.col("rank_score") >= minimum).select("topic_id")
    some = hits.agg(F.count("*").alias("_k"))
    rows = topics.join(hits.distinct().withColumn("_hit", F.lit(True)), "topic_id", "left").join(F.broadcast(some))
    return rows.where(F.col("_hit") | (F.col("_k") == 0)).drop("_hit", "_k")


def batch_counts(topics: DataFrame) -> DataFrame:
    """(batch, total, platforms): topics of each batch and a map of counts by platform."""
    counts = topics.groupBy("batch", "platform").agg(F.count("*").alias("n"))
    return counts.groupBy("batch").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("platform", "n"))).alias("platforms"))


def call_status(http_code: Column, error_class: Column) -> Column:
    return F.substring(F.coalesce(http_code.cast("string"), error_class), 1, 20)
