"""Lists and candidates over items and their scores: filters, latest rows, semi and anti joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.config import DEFAULTS
from brightloom.functions import text as T
from brightloom.functions import urls as U
from brightloom.operators.evaluation import ID_BLOCK, preceding


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of the largest ``order`` of each key. An aggregate of structs: nothing of a hot key is gathered."""
    rest = [c for c in rows.columns if c not in (*key, order)]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_row"), F.max(order).alias(order)) if rest else rows.groupBy(*key).agg(F.max(order).alias(order))
    return best.select(*key, order, *[F.col(f"_row.{c}").alias(c) for c in rest]) if rest else best


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """Adds ``rank`` from 1 and keeps the first n of each group; Spark prunes each group before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0, clamp: int = 500) -> DataFrame:
    """One page in a total order; the limit is clamped to 1 .. ``clamp``."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, clamp)))


def item_list(items: DataFrame, scores: DataFrame, fan_out: bool = False) -> DataFrame:
    """Items with content_chars and their latest score in their direction; ``fan_out`` gives a row for each score."""
    sized = items.withColumn("content_chars", F.length(F.coalesce("content_text", F.lit("")))).drop("content_text")
    mine = scores if fan_out else latest(scores, ["item_id", "direction"], "score_id")
    return sized.join(mine.withColumnRenamed("direction", "score_direction") if fan_out else mine, ["item_id"] if fan_out else ["item_id", "direction"], "left")


def fetchable_sources(sources: DataFrame, directions: DataFrame) -> DataFrame:
    return sources.where("enabled").join(directions.where("status = 'active'").select("direction_id"), "direction_id", "left_semi")


def expired_directions(directions: DataFrame, now: Column) -> DataFrame:
    """Temporary active directions whose end has come turn to expired."""
    due = F.col("temp") & (F.col("status") == "active") & (F.col("expires_at") <= now)
    return directions.withColumn("status", F.when(due, "expired").otherwise(F.col("status")))


def scoring_candidates(items: DataFrame, scores: DataFrame, sources: DataFrame | None = None, max_age: Column | None = None) -> DataFrame:
    """Fetched, passed items that are no duplicates, of enabled sources, without an OK score in their direction."""
    rows = items.where("fetch_status = 'FETCHED' AND sanitize_status = 'PASSED' AND duplicate_of IS NULL")
    if sources is not None:
        rows = rows.join(sources.where("enabled").select("source_id"), "source_id", "left_semi")
    if max_age is not None:
        rows = rows.where(max_age)
    return rows.join(scores.where("status = 'OK'").select("item_id", "direction"), ["item_id", "direction"], "left_anti")


def expiring_items(items: DataFrame, scores: DataFrame, cutoff: Column) -> DataFrame:
    """EXPIRED score rows for items older than the cutoff that have none yet; an OK score does not matter."""
    old = items.where((F.col("fetch_status") == "FETCHED") & (F.coalesce("published_at", "fetched_at") < cutoff))
    return old.join(scores.where("status = 'EXPIRED'").select("item_id"), "item_id", "left_anti").select("item_id", "direction", F.lit("EXPIRED").alias("status"))


def rescore_candidates(items: DataFrame, scores: DataFrame, version: int, scope: str = "all") -> DataFrame:
    """``all``: items with an OK score but none at this version, and archived items without one; ``failed``: items
    with a failed score and no OK one. One pass over the scores."""
    state = scores.groupBy("item_id").agg(
        F.bool_or(F.col("status") == "OK").alias("ok"), F.bool_or((F.col("status") == "OK") & (F.col("version") == version)).alias("current"), F.bool_or(F.col("status") == "FAILED").alias("failed")
    )
    rows = items.join(state, "item_id", "left")
    ok, failed = F.coalesce("ok", F.lit(False)), F.coalesce("failed", F.lit(False))
    wanted = (ok & ~F.coalesce("current", F.lit(False))) | ((F.col("fetch_status") == "ARCHIVED") & ~ok) if scope == "all" else failed & ~ok
    return rows.where(wanted).select("item_id", "direction")


def batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Adds a batch number from 0 for every ``size`` rows in the order of a whole number; equal ones in any order.

    From counts of rows per block of numbers: blocks are numbered within themselves, and what comes before a block is
    a running sum over one row each, so no task sorts all rows and nothing depends on how they are spread.
    """
    block = F.floor(F.col(order) / F.lit(ID_BLOCK)).alias("_block")
    sizes = rows.groupBy(block).agg(F.count("*").alias("_n"), F.lit(0).alias("_all"))
    before = preceding(sizes, "_all", "_block", "_n", [F.col("_block")]).select(F.col("_block").alias("_b"), "before")
    inside = rows.withColumn("_block", block).withColumn("_at", F.row_number().over(Window.partitionBy("_block").orderBy(order)) - 1)
    joined = inside.join(before, F.col("_block").eqNullSafe(F.col("_b")))
    return joined.withColumn("batch", F.floor((F.col("before") + F.col("_at")) / size).cast("long")).drop("_block", "_b", "_at", "before")


def visible_articles(articles: DataFrame, authors: DataFrame) -> DataFrame:
    """Public articles of visible authors, with the author's name."""
    return articles.where("public").join(authors.where("visible").select("author_id", F.col("name").alias("author_name")), "author_id")


def article_list(articles: DataFrame, authors: DataFrame, author_id: int | None = None, bookmarked: bool | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of articles, newest first, with the author's name, the number of citations and the total of the filter."""
    rows = articles.join(authors.select("author_id", F.col("name").alias("author_name")), "author_id")
    if author_id is not None:
        rows = rows.where(F.col("author_id") == author_id)
    if bookmarked is not None:
        rows = rows.where(F.col("bookmarked") == bookmarked)
    total = rows.agg(F.count("*").alias("total"))
    cited = F.coalesce(F.nullif(F.size("citations"), F.lit(-1)), F.lit(0)).alias("citations")
    shown = page(rows.select("article_id", "author_id", "author_name", "title", "bookmarked", cited), [F.desc("article_id")], limit, offset, clamp=200)
    return shown.join(F.broadcast(total))


def article_reaction_counts(articles: DataFrame, reactions: DataFrame, viewer: str) -> DataFrame:
    """(article_id, likes, dislikes, viewer_reacted) of every article; a visitor has one row an article, and comments
    are no reactions."""
    mine = F.max(F.when((F.col("visitor") == viewer) & F.col("verdict").isin("like", "dislike"), F.col("verdict")))
    counts = reactions.groupBy("article_id").agg(F.count_if(F.col("verdict") == "like").alias("likes"), F.count_if(F.col("verdict") == "dislike").alias("dislikes"), mine.alias("viewer_reacted"))
    return articles.select("article_id").join(counts, "article_id", "left").fillna(0, ["likes", "dislikes"])


def task_list(tasks: DataFrame, authors: DataFrame, kind: str | None = None, limit: int = 50) -> DataFrame:
    """The newest tasks of a kind with the name of the payload's author, and the article of a writing task.

    The page is cut before the names are looked up; an author_id that is no whole number has no name.
    """
    rows = (tasks if kind is None else tasks.where(F.col("kind") == kind)).orderBy(F.desc("task_id")).limit(max(1, min(limit, 200)))
    member = lambda name: F.try_variant_get(F.try_parse_json("payload"), f"$.{name}", "long")
    rows = rows.withColumn("author_id", member("author_id")).withColumn("article_id", F.when(F.col("kind") == "write", member("article_id")))
    return rows.join(authors.select("author_id", F.col("name").alias("author_name")), "author_id", "left")


def memory_list(memory: DataFrame, author_id: int, module: str | None = None) -> DataFrame:
    """An author's entries, of one module if named, newest first."""
    rows = memory.where(F.col("author_id") == author_id)
    return (rows if module is None else rows.where(F.col("module") == module)).orderBy(F.desc("entry_id"))


def memory_counts(memory: DataFrame) -> DataFrame:
    """(author_id, module, n) of memory entries."""
    return memory.groupBy("author_id", "module").agg(F.count("*").alias("n"))


def explore_rows(items: DataFrame, scores: DataFrame, vectors: DataFrame, sources: DataFrame, model_version: str) -> DataFrame:
    """What exploration picks from: fetched items that are no duplicates, with an OK score, a vector of the model and
    the name of their source. The narrow sides are filtered before the joins."""
    rows = items.where("fetch_status = 'FETCHED' AND duplicate_of IS NULL").drop("direction")
    rows = rows.join(scores.where("status = 'OK'").select("item_id", "direction", "relevance", "quality", "passed"), "item_id")
    rows = rows.join(vectors.where(F.col("model_version") == model_version).select("item_id", "vec"), "item_id")
    return rows.join(sources.select("source_id", F.col("name").alias("source_name")), "source_id")


def unscored_entries(items: DataFrame, scores: DataFrame, tasks: DataFrame, now: Column, limit: int = 10) -> DataFrame:
    """Newest items without an OK score in any direction, if a scoring task failed within 24 hours; else none."""
    failed = tasks.where((F.col("kind") == "score") & (F.col("status") == "FAILED") & (F.col("updated_at") >= now - F.expr("INTERVAL 24 HOURS"))).limit(1).select(F.lit(1).alias("_any"))
    rows = items.join(scores.where("status = 'OK'").select("item_id"), "item_id", "left_anti")
    return rows.orderBy(F.desc("item_id")).limit(limit).join(F.broadcast(failed)).drop("_any")


def names_of_directions(authors: DataFrame, directions: DataFrame) -> DataFrame:
    """(author_id, direction_id, threshold, name) of the directions an author reads; a deleted one has no name."""
    wanted = authors.select("author_id", F.explode("readable_directions").alias("d")).select("author_id", "d.direction_id", "d.threshold")
    return wanted.join(directions.select("direction_id", "name"), "direction_id", "left")


def citation_rows(articles: DataFrame, items: DataFrame) -> DataFrame:
    """(article_id, k, item_id, quote, url, title) in the order of the citations, in one join instead of a lookup each."""
    rows = articles.select("article_id", F.posexplode("citations").alias("k", "c")).select("article_id", "k", "c.item_id", "c.quote")
    return rows.join(items.select("item_id", "url", "title"), "item_id", "left")


def public_list(items: DataFrame, scores: DataFrame, directions: DataFrame, limit: int = 50) -> DataFrame:
    """Passed items of public directions by relevance: title, first sentence and url only."""
    rows = items.join(scores.where("status = 'OK' AND passed"), ["item_id", "direction"]).join(directions.where("public").select("direction"), "direction", "left_semi")
    return rows.orderBy(F.desc("relevance"), "item_id").limit(limit).select("item_id", "title", T.first_sentence(F.col("content_text")).alias("summary"), "url", "relevance")


def score_check(answer: Column) -> Column:
    """struct(relevance, quality, band, reason, ok) of a model's JSON: scores 0-100, a known band, a reason.

    Scores are numbers, of which the fraction is cut off, or whole numbers as text; the band counts without case and
    outer blanks; reasons are cut at 300 characters.
    """
    json = F.try_parse_json(T.json_block(answer))
    member = lambda name: F.try_variant_get(json, f"$.{name}", "variant")
    text = lambda name: F.when(T.variant_kind(member(name)) == "void", "None").otherwise(F.try_variant_get(json, f"$.{name}", "string"))

    def number(name: str) -> Column:
        kind, raw = T.variant_kind(member(name)), T.strip(F.try_variant_get(json, f"$.{name}", "string"))
        whole = F.when(raw.rlike(r"^[+-]?\d+$"), raw.try_cast("long"))
        return F.when(kind == "string", whole).when(kind == "boolean", (raw == "true").cast("long")).when(kind != "void", F.try_variant_get(json, f"$.{name}", "double").try_cast("long"))

    relevance, quality, band, reason = number("relevance"), number("quality"), F.lower(T.strip(text("band"))), T.strip(text("reason"))
    ok = relevance.between(0, 100) & quality.between(0, 100) & band.isin("high", "mid", "low") & (reason != "")
    return F.struct(relevance.alias("relevance"), quality.alias("quality"), band.alias("band"), F.substring(reason, 1, 300).alias("reason"), F.coalesce(ok, F.lit(False)).alias("ok"))


def score_rows(attempts: DataFrame) -> DataFrame:
    """Score rows of attempts (item_id, direction, threshold, answer): OK and whether the relevance reaches the
    threshold, or FAILED without scores if the answer does not hold up. Every attempt gives a row."""
    rows = attempts.withColumn("s", score_check(F.col("answer")))
    own = lambda name: F.when(F.col("s.ok"), F.col(f"s.{name}")).alias(name)
    return rows.select("item_id", "direction", F.when(F.col("s.ok"), "OK").otherwise("FAILED").alias("status"), own("relevance"), own("quality"), own("band"), own("reason"), F.when(F.col("s.ok"), F.col("s.relevance") >= F.col("threshold")).alias("passed"))


def prefilter_route(verdict: Column, confidence: Column, upgrade: float = DEFAULTS.upgrade_confidence) -> Column:
    """failed without a verdict; reject or score if confident; upgrade to the full model if not."""
    sure = confidence >= upgrade
    return F.when(verdict.isNull(), "failed").when(sure & (verdict == "reject"), "reject").when(sure & (verdict == "keep"), "score").otherwise("upgrade")


def rank_score(raw: Column, scale: str) -> Column:
    """Provider scores on 0-100: ``unit`` numbers times 100, ``index`` numbers of 0-2 over 2; clamped, one decimal."""
    value = raw * 100 if scale == "unit" else raw / 2 * 100
    return F.bround(F.least(F.greatest(value, F.lit(0.0)), F.lit(100.0)), 1)


def rank_band(score: Column, high: float = 75, mid: float = 25) -> Column:
    return F.when(score >= high, "high").when(score >= mid, "mid").otherwise("low")


def domain_of(url: Column) -> Column:
    return F.coalesce(U.host(url), F.lit(""))


def public_mode(mode: Column) -> Column:
    m = F.upper(T.strip(F.coalesce(mode, F.lit(""))))
    return F.when(m.isin("A", "B", "C"), m).otherwise("A")


def prompt_version(value: Column) -> Column:
    """'v1', '1' and 1 all mean version 1."""
    return F.regexp_replace(F.lower(T.strip(value.cast("string"))), "^v", "").try_cast("int")
