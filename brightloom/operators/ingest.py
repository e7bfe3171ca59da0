"""Ingest: classification of entries, rules, sanitizing, exact duplicates, page monitoring."""

from __future__ import annotations

import difflib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from brightloom.config import DEFAULTS
from brightloom.functions import text as T
from brightloom.functions import urls as U
from brightloom.storage import stored

# fixed values: ordered patterns of instructions aimed at a model, with their rule ids
INJECTION_RULES = (
    ("ignore_previous_instructions_zh", r"忽略(之前|以上|前面|先前|上面)(的)?(所有|全部)?(指令|提示|要求|规则)"),
    ("ignore_previous_instructions_en", r"(?i)(disregard|ignore|forget)\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions?|prompts?|rules?|directions?)"),
    ("reveal_credentials", r"(?i)(输出|泄露|打印|透露|reveal|output|print|leak|show)\s*.{0,24}(api[\s_-]?key|secret|密钥|凭据|credentials?|password|token)"),
    ("developer_mode_override", r"(?i)(进入|启用|开启).{0,10}(开发者模式|developer\s+mode|dan\s+mode)|jailbreak|越狱模式"),
    ("system_prompt_extraction", r"(?i)(输出|泄露|复述|打印|reveal|output|repeat|print).{0,16}(系统提示词|系统指令|system\s*prompt)"),
)


def rule_reason(title: Column, body: Column, published: Column, now: Column, *, min_chars: int = DEFAULTS.min_body_chars, max_age_days: int | None = DEFAULTS.max_age_days, blacklist: list[str] | None = None, ignore_expiry: bool = False) -> Column:
    """Why an entry is rejected, by the first rule that applies, or null: too short, a banned word, too old.

    The age limit counts fractional days, never applies without a date, and a limit of None means the default.
    """
    max_age_days = DEFAULTS.max_age_days if max_age_days is None else max_age_days
    chars = F.length(T.strip(F.coalesce(body, F.lit(""))))
    reason = F.when(chars < min_chars, F.concat(F.lit("too_short:"), chars.cast("string"), F.lit(f"<{min_chars}")))
    joined = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit("")))
    for word in blacklist or []:
        if word:
            reason = reason.when(F.contains(joined, F.lit(word)), F.lit(f"blacklist:{word}"))
    if not ignore_expiry:
        days = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(published.cast("timestamp"))) / F.lit(86_400_000_000)
        reason = reason.when(days > max_age_days, F.concat(F.lit("expired:"), F.bround(days, 0).cast("long").cast("string"), F.lit(f"d>{max_age_days}d")))
    return reason


#: Words of which a text must hold one for a rule to apply: a search for a few literals spares most pattern runs.
HINTS = {
    "ignore_previous_instructions_zh": ("忽略",), "ignore_previous_instructions_en": ("disregard", "ignore", "forget"), "reveal_credentials": ("key", "secret", "密钥", "凭据", "credential", "password", "token"),
    "developer_mode_override": ("进入", "启用", "开启", "jailbreak", "越狱模式"), "system_prompt_extraction": ("系统提示词", "系统指令", "system"),
}
#: Letters that patterns without case take for i, s or k although their lower case is another one.
ODD_CASE = "[\u0130\u0131\u017f\u212a]"


def injection_reason(title: Column, body: Column) -> Column:
    """The first injection rule that the title or the body meets, or null."""
    joined = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit("")))

    def first(x: Column) -> Column:
        found = []
        for name, pattern in INJECTION_RULES:
            may = reduce(lambda a, b: a | b, [F.contains(x["low"], F.lit(word)) for word in HINTS[name]]) | x["odd"]
            found.append(F.when(may & x["text"].rlike(f"(?U){pattern}"), F.lit(f"injection_pattern:{name}")))
        return F.coalesce(*found)

    return T.bound(F.struct(joined.alias("text"), F.lower(joined).alias("low"), joined.rlike(ODD_CASE).alias("odd")), first)


def keyword_reason(title: Column, body: Column, words: list[str]) -> Column:
    """struct(reason, matched_in) of the first denied word, or null."""
    joined = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit("")))
    found = [F.when(F.contains(joined, F.lit(w)), F.struct(F.lit(f"keyword_deny:{w}").alias("reason"), F.when(F.contains(title, F.lit(w)), "title").otherwise("content").alias("matched_in"))) for w in words if w]
    return F.coalesce(*found) if found else F.lit(None).cast("struct<reason:string,matched_in:string>")


def sanitized(items: DataFrame, deny: list[str] | None = None, enabled: bool = True) -> DataFrame:
    """Adds (sanitize_status, sanitize_reason): the first stage that rejects wins; all pass if it is disabled."""
    if not enabled:
        return items.withColumn("sanitize_status", F.lit("PASSED")).withColumn("sanitize_reason", F.lit(None).cast("string"))
    reason = F.coalesce(injection_reason(F.col("title"), F.col("content_text")), keyword_reason(F.col("title"), F.col("content_text"), deny or [])["reason"])
    return items.withColumn("sanitize_reason", reason).withColumn("sanitize_status", F.when(F.col("sanitize_reason").isNull(), "PASSED").otherwise("REJECTED"))


def exact_origins(items: DataFrame, key: list[str], item_id: str = "item_id") -> DataFrame:
    """Adds duplicate_of: the smallest id of the same key, for rows that are not it. Rows with a null key have none.

    An aggregate and a join rather than a window: a key that a third of all rows share is summed up before the shuffle.
    The keys, often hashes of whole texts, are computed once and stored; only the ids of duplicates meet the rows again.
    """
    keys = stored(items.where(F.col(key[-1]).isNotNull()).select(item_id, *key), "origin-keys")
    # a table of its own: the join reads two plain shuffles, and a key of a third of all rows is split over tasks
    first = stored(keys.groupBy(*key).agg(F.min(item_id).alias("_origin"), F.count("*").alias("_n")).where("_n > 1").drop("_n"), "origins")
    later = keys.join(first, key).where(F.col(item_id) > F.col("_origin")).groupBy(item_id).agg(F.min("_origin").alias("duplicate_of"))
    return items.join(later, item_id, "left")


def new_entries(entries: DataFrame, known: DataFrame, position: str = "position") -> DataFrame:
    """Entries whose (source_id, guid) is neither known nor earlier in the same feed; without a guid they are dropped."""
    w = Window.partitionBy("source_id", "guid").orderBy(position)
    once = entries.where(F.coalesce("guid", F.lit("")) != "").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return once.join(known.select("source_id", "guid"), ["source_id", "guid"], "left_anti")


def classified(entries: DataFrame, known: DataFrame, now: Column, *, first_ingest: bool = False, blacklist: list[str] | None = None, max_age_days: int | None = None) -> DataFrame:
    """One class for each feed entry, inserted, dup_blocked, rule_rejected, failed or archived, with reason and status.

    ``entries`` has (source_id, direction, position, guid, url, title, content_text, published_at, fingerprint);
    ``known`` has (source_id, direction, guid, fingerprint). An entry whose guid the source has, or has had earlier in
    the feed, is blocked and not written. One whose fingerprint the direction has, from ``known`` or from a row written
    before it (by source, then position), is written with fetch_status DUP, whatever the rules say, and counts as
    inserted. On a first import rules run without the age limit, and what is older than the first window is archived.
    """
    blank = F.coalesce("guid", F.lit("")) == ""
    place = F.struct("source_id", "position")
    # rows that lack a guid or fingerprint can match nothing; a key of their own keeps them from meeting in one task
    own = lambda name, lacks: F.when(lacks, F.struct(F.lit(None).cast("string").alias("of"), F.col("source_id").cast("string").alias("s"), F.col("position").cast("string").alias("p"))).otherwise(F.struct(F.col(name).alias("of"), F.lit("").alias("s"), F.lit("").alias("p")))
    key = lambda name: F.struct(F.col(name).alias("of"), F.lit("").alias("s"), F.lit("").alias("p"))
    guids = stored(known.where("guid IS NOT NULL").select("source_id", key("guid").alias("_guid")).distinct().withColumn("_old", F.lit(True)), "known-guids")
    prints = stored(known.where("fingerprint IS NOT NULL").select("direction", key("fingerprint").alias("_print")).distinct().withColumn("_dup", F.lit(True)), "known-fingerprints")
    rows = entries.withColumn("_guid", own("guid", blank)).withColumn("_print", own("fingerprint", F.col("fingerprint").isNull()))
    first_guid = stored(rows.where(~blank).groupBy("source_id", "_guid").agg(F.min("position").alias("_first")), "first-guids")
    rows = rows.join(first_guid, ["source_id", "_guid"], "left").join(guids, ["source_id", "_guid"], "left").join(prints, ["direction", "_print"], "left")
    rows = rows.withColumn("_blocked", ~blank & ((F.col("position") > F.col("_first")) | F.coalesce("_old", F.lit(False))))
    written = rows.where(~blank & ~F.col("_blocked") & F.col("fingerprint").isNotNull()).groupBy("direction", "_print").agg(F.min(place).alias("_origin"))
    rows = rows.join(stored(written, "written-fingerprints"), ["direction", "_print"], "left")
    copied = F.coalesce(F.col("_dup") | (place > F.col("_origin")), F.lit(False))
    reason = rule_reason(F.col("title"), F.col("content_text"), F.col("published_at"), now, blacklist=blacklist, max_age_days=max_age_days, ignore_expiry=first_ingest)
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("published_at").cast("timestamp"))
    archived = F.lit(first_ingest) & (age > DEFAULTS.first_ingest_days * 86400)
    kind = (
        F.when(blank, "failed")
        .when(F.col("_blocked"), "dup_blocked")
        .when(F.col("_copied"), "inserted")
        .when(F.col("_reason").isNotNull(), "rule_rejected")
        .when(archived, "archived")
        .otherwise("inserted")
    )
    status = F.when(F.col("class").isin("failed", "dup_blocked"), None).when(F.col("_copied"), "DUP").when(F.col("class") == "rule_rejected", "REJECTED_RULED").when(F.col("class") == "archived", "ARCHIVED").otherwise("FETCHED")
    marked = rows.withColumn("_reason", reason).withColumn("_copied", copied).withColumn("class", kind).withColumn("reason", F.when(F.col("class") == "rule_rejected", F.col("_reason")))
    return marked.withColumn("fetch_status", status).drop("_guid", "_print", "_first", "_old", "_dup", "_blocked", "_origin", "_copied", "_reason")


def ingest_ledger(entries: DataFrame, by: str = "source_id") -> DataFrame:
    """Counts per class; feed_entries is their sum."""
    classes = ("inserted", "dup_blocked", "rule_rejected", "failed", "archived")
    return entries.groupBy(by).agg(F.count("*").alias("feed_entries"), *[F.count_if(F.col("class") == c).alias(c) for c in classes])


def filter_stats(items: DataFrame) -> DataFrame:
    """(stage, reason, count, share): rejected rows by stage and reason, with their share of all rows, unrounded.

    The reason of a rule is what stands before its colon; that of the sanitizer keeps both parts with a bar between.
    """
    prefix = lambda c: F.coalesce(F.nullif(F.substring_index(c, ":", 1), F.lit("")), F.lit("(none)"))
    rest = F.coalesce(F.nullif(F.substr(F.col("sanitize_reason"), F.length(F.substring_index("sanitize_reason", ":", 1)) + 2), F.lit("")), F.lit(""))
    rule = F.when(F.col("fetch_status") == "REJECTED_RULED", F.struct(F.lit("rule").alias("stage"), prefix(F.col("rule_reason")).alias("reason")))
    clean = F.when(F.col("sanitize_status") == "REJECTED", F.struct(F.lit("sanitize").alias("stage"), F.concat(prefix(F.col("sanitize_reason")), F.lit("|"), rest).alias("reason")))
    counts = items.select(F.explode(F.array(rule, clean)).alias("hit")).where("hit IS NOT NULL").groupBy("hit.stage", "hit.reason").agg(F.count("*").alias("count"))
    total = items.agg(F.count("*").alias("total"))
    return counts.join(F.broadcast(total)).select("stage", "reason", "count", F.try_divide(F.col("count").cast("double"), F.col("total").cast("double")).alias("share"))


def page_changes(snapshots: DataFrame, words: list[str] | None = None) -> DataFrame:
    """Adds (event, guid, hits) to page snapshots (url, seen_at, etag, html): first_fetch, content_changed or unchanged.

    An unchanged etag means unchanged; otherwise the hashes of the html decide. The guid of a change carries the first
    12 digits of the new hash; ``hits`` are the monitored words that the text holds.
    """
    w = Window.partitionBy("url").orderBy("seen_at")
    digest = F.sha2("html", 256)
    before, tag = F.lag(digest).over(w), F.lag("etag").over(w)
    same = (F.col("etag").isNotNull() & (F.col("etag") == tag)) | (digest == before)
    event = F.when(before.isNull(), "first_fetch").when(same, "unchanged").otherwise("content_changed")
    found = F.filter(F.array(*[F.lit(x) for x in words or []]).cast("array<string>"), lambda x: F.contains(T.html_text(F.col("html")), x))
    return snapshots.withColumn("event", event).withColumn("guid", F.when(F.col("event") == "content_changed", F.concat("url", F.lit("#v-"), F.substring(digest, 1, 12))).otherwise(F.col("url"))).withColumn("hits", found)


def list_page_entries(pages: DataFrame, limit: int = 10) -> DataFrame:
    """(page_url, position, guid, title, url) of a model's JSON answer ``entries``: the first ten entries.

    The guid is the entry's link or else the page with the first 12 digits of the title's hash.
    """
    schema = "array<struct<title:string,url:string,summary:string>>"
    rows = pages.select(F.col("url").alias("page_url"), F.posexplode(F.slice(F.from_json("entries", schema), 1, limit)).alias("position", "e"))
    guid = F.coalesce(F.nullif("e.url", F.lit("")), F.concat("page_url", F.lit("#e-"), F.substring(F.sha1("e.title"), 1, 12)))
    return rows.select("page_url", "position", guid.alias("guid"), "e.title", "e.url", "e.summary")


def enriched(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """Takes the fetched full text of an entry's url if it is strictly longer and the url is not the page itself."""
    full = pages.select(F.col("url").alias("_u"), F.col("full_text").alias("_full"))
    joined = entries.join(full, entries["url"] == full["_u"], "left")
    better = (F.length(T.strip(F.col("_full"))) > F.length(T.strip(F.coalesce("content_text", F.lit(""))))) & (F.col("url") != F.coalesce("page_url", F.lit("")))
    marked = joined.withColumn("enriched", F.coalesce(better, F.lit(False)))
    return marked.withColumn("content_text", F.when(F.col("enriched"), F.col("_full")).otherwise(F.col("content_text"))).drop("_u", "_full")


def entry_body(content: Column, summary: Column, description: Column) -> Column:
    """Text of an entry: its content element, else summary, else description."""
    some = lambda c: F.nullif(c, F.lit(""))
    return T.html_text(F.coalesce(some(content), some(summary), some(description), F.lit("")))


def duplicate_title_groups(items: DataFrame, item_id: str = "item_id") -> DataFrame:
    """(title_key, n, first_id) of titles that are equal but for case, blanks and punctuation."""
    keyed = items.select(T.title_key(F.col("title")).alias("title_key"), item_id).where("title_key <> ''")
    return keyed.groupBy("title_key").agg(F.count("*").alias("n"), F.min(item_id).alias("first_id")).where("n > 1")


@F.pandas_udf(DoubleType())
def resemblance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over all characters, by longest matching blocks."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def with_resemblance(pairs: DataFrame, items: DataFrame, least: float, item_id: str = "item_id") -> DataFrame:
    """The pairs (a, b, ...) whose normalized titles resemble each other by ``least`` at least, with the ``ratio``."""
    side = lambda name: items.select(F.col(item_id).alias(name), T.title_key(F.col("title")).alias(f"_{name}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("ratio", resemblance("_a", "_b"))
    return rows.where(F.col("ratio") >= least).drop("_a", "_b")


def _fuzzy_tile(threshold: float, difference: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, token, left, right = key
        rows = rows.sort_values("rep")
        names, reps, sizes = rows["key"].tolist(), rows["rep"].tolist(), rows["key"].str.len().to_numpy()
        side, prefixes = rows["chunk"].to_numpy(), [set(p) for p in rows["prefix"]]
        letters = np.zeros((len(names), 64), dtype=np.int16)
        for i, name in enumerate(names):
            np.add.at(letters[i], [ord(c) % 64 for c in name], 1)
        found = []
        for i, name in enumerate(names):
            # no more characters can match than two titles have in common, in any order
            common = 2 * np.minimum(letters[i], letters[i + 1 :]).sum(axis=1) / (sizes[i] + sizes[i + 1 :])
            near = (common >= threshold) & (np.abs(sizes[i] - sizes[i + 1 :]) <= difference)
            if left != right:
                near &= side[i + 1 :] != side[i]
            for j in np.flatnonzero(near) + i + 1:
                if min(prefixes[i] & prefixes[j]) != token:
                    continue  # the pair is compared where its first shared token is
                ratio = difflib.SequenceMatcher(None, name, names[j]).ratio()
                if ratio >= threshold:
                    found.append((reps[i], reps[j], ratio))
        return pd.DataFrame(found, columns=["a", "b", "ratio"])

    return run


def title_prefixes(items: DataFrame, threshold: float = 0.82, width: int = 12, difference: int = 10, low: int = 8, high: int = 120, item_id: str = "item_id") -> DataFrame:
    """(bucket, key, rep, prefix): the different titles with the rarest of their numbered letters ("e2" is a second e).

    A ratio of ``threshold`` needs so many letters in common that two such titles share one of these: of n letters all
    but the fewest that a partner in the bucket must share, less one. Rare is what few titles of the bucket hold.
    """
    keys = items.select(item_id, T.title_key(F.col("title")).alias("key")).where(F.length("key").between(low, high) & F.col(item_id).isNotNull())
    rows = keys.groupBy("key").agg(F.min(item_id).alias("rep")).withColumn("bucket", F.floor(F.length("key") / width).cast("int"))
    letters = F.filter(F.split("key", ""), lambda c: c != "")
    numbered = T.bound(letters, lambda cs: F.transform(cs, lambda c, i: F.concat(c, F.size(F.filter(F.slice(cs, F.lit(1), i + 1), lambda x: x == c)).cast("string"))))
    tokens = rows.select("bucket", "key", "rep", F.explode(numbered).alias("token"))
    # stored, so that the join with a token that most titles hold can be split
    counts = stored(tokens.groupBy("bucket", "token").agg(F.count("*").alias("n")), "title-tokens")
    rarest = tokens.join(counts, ["bucket", "token"]).groupBy("bucket", "key", "rep").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("t"))
    n = F.length("key")
    shortest = F.greatest(F.lit(low), F.col("bucket") * width, n - difference)
    needed = F.ceil(F.lit(threshold) * (n + shortest) / 2 - 1e-9).cast("int")
    return rarest.select("bucket", "key", "rep", F.transform(F.slice("t", F.lit(1), F.greatest(n - needed + 1, F.lit(0))), lambda x: x["token"]).alias("prefix"))


def title_work(items: DataFrame, **limits) -> DataFrame:
    """(compared, pairs): at most so many pairs of titles meet in ``fuzzy_title_pairs``, and all pairs of the buckets."""
    rows = stored(title_prefixes(items, **limits), "title-prefixes")
    pairs = lambda t, *by: t.groupBy(*by).agg(F.count("*").alias("n")).select(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0)).cast("long").alias("n"))
    met = pairs(rows.select("bucket", F.explode("prefix").alias("token")), "bucket", "token")
    return met.select(F.col("n").alias("compared")).crossJoin(pairs(rows, "bucket").select(F.col("n").alias("pairs")))  # a row each


def fuzzy_title_pairs(items: DataFrame, threshold: float = 0.82, width: int = 12, difference: int = 10, low: int = 8, high: int = 120, tile: int = 512, item_id: str = "item_id") -> DataFrame:
    """(a, b, ratio): different titles of a length bucket that resemble each other; a title stands for its smallest id.

    Titles count without blanks and punctuation, those of ``low`` to ``high`` characters, and only pairs whose lengths
    differ by ``difference`` at most. Titles meet in the lists of their rarest letters, once for each pair. A long list
    is cut into chunks; a task compares two chunks and gives matches only. Rows without an id are left out.
    """
    rows = stored(title_prefixes(items, threshold, width, difference, low, high, item_id), "title-prefixes").withColumn("token", F.explode("prefix"))
    sizes = stored(rows.groupBy("bucket", "token").agg(F.count("*").alias("n")).where("n > 1").select("bucket", "token", F.ceil(F.col("n") / tile).cast("int").alias("chunks")), "title-lists")
    placed = rows.join(sizes, ["bucket", "token"])
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks").cast("long")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    placed = placed.select("bucket", "token", F.least("chunk", "other").alias("left"), F.greatest("chunk", "other").alias("right"), "chunk", "rep", "key", "prefix")
    return placed.groupBy("bucket", "token", "left", "right").applyInPandas(_fuzzy_tile(threshold, difference), "a long, b long, ratio double")


def title_pairs(items: DataFrame, max_df: int = 6, min_shared: int = 2, item_id: str = "item_id") -> DataFrame:
    """(a, b, shared): titles that share at least ``min_shared`` rare words (in at most ``max_df`` titles).

    Only rare words meet, so a word gives at most max_df * (max_df - 1) / 2 pairs.
    """
    words = items.select(item_id, F.explode(F.array_distinct(F.split(F.lower("title"), r"[^\p{L}\p{N}]+"))).alias("word")).where("length(word) > 1")
    df = words.groupBy("word").agg(F.count("*").alias("df")).where(F.col("df").between(2, max_df))
    few = words.join(df, "word")
    a, b = few.select("word", F.col(item_id).alias("a")), few.select("word", F.col(item_id).alias("b"))
    return a.join(b, "word").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= min_shared)


def http_outcome(status: Column, error: Column) -> Column:
    """Class of a response: not_modified, rate_limited, ok, redirect, fatal, retryable or semantic; error without one.

    Redirects are tried again like what is retryable (429, 500, 502, 503, 504); fatal ones are the vendor's account.
    """
    return (
        F.when(status.isNull(), "error").when(status == 304, "not_modified").when(status == 429, "rate_limited").when(status.between(200, 299), "ok")
        .when(status.between(300, 399), "redirect").when(status.isin(401, 402, 403), "fatal").when(status.isin(500, 502, 503, 504), "retryable").otherwise("semantic")
    )


def entry_dates(published: Column, updated: Column) -> Column:
    return F.coalesce(published, updated)


def entry_keys(entries: DataFrame) -> DataFrame:
    """Adds guid, url and fingerprint to parsed entries (id, link, link_alt, title)."""
    keyed = entries.withColumn("guid", U.normalize_guid(F.col("id"), F.col("link"), F.col("link_alt"))).withColumn("url", U.normalize_url(F.col("link")))
    mark = U.entry_fingerprint(F.col("url"), F.col("guid"), U.fold_title(F.col("title")))
    return keyed.withColumn("_f", mark).withColumn("fingerprint", F.col("_f.fingerprint")).withColumn("low_confidence", F.col("_f.low_confidence")).drop("_f")
