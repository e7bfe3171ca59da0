"""Reading sets, interleaving, boards and samples."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.config import DEFAULTS
from brightloom.functions import text as T
from brightloom.functions import urls as U


def domain_capped(rows: DataFrame, readable: DataFrame, k: int = DEFAULTS.reading_set_k, cap: int = DEFAULTS.domain_cap, pool: int = DEFAULTS.reading_pool, domain: Column | None = None) -> DataFrame:
    """The first k rows by relevance with at most ``cap`` of a domain; adds (place, domain_capped).

    The pool of the best rows is cut before the directions and their thresholds apply; a threshold of 0 or null means
    60; a cap of 0 or less means none. domain_capped counts the rows passed over for their domain before the k-th.
    """
    best = rows.orderBy(F.desc("relevance"), "item_id").limit(pool)
    mine = best.join(F.broadcast(readable.select("direction", "threshold")), "direction").where(F.col("relevance") >= T.or_default(F.col("threshold"), 60))
    mine = mine.withColumn("domain", domain if domain is not None else U.netloc(F.col("url")))
    order = [F.desc("relevance"), F.col("item_id")]
    ranked = mine.withColumn("_in_domain", F.row_number().over(Window.partitionBy("domain").orderBy(*order)))
    kept = F.lit(True) if cap <= 0 else F.col("_in_domain") <= cap
    # at most ``pool`` rows from here on: one task orders them
    ranked = ranked.withColumn("_kept", kept).withColumn("place", F.sum(F.col("_kept").cast("int")).over(Window.orderBy(*order)))
    ranked = ranked.withColumn("domain_capped", F.sum((~F.col("_kept")).cast("int")).over(Window.orderBy(*order)))
    chosen = ranked.where(F.col("_kept") & (F.col("place") <= k))
    total = F.when(F.count("*").over(Window.partitionBy()) < k, F.lit(None)).otherwise(F.max("domain_capped").over(Window.partitionBy()))
    everything = ranked.agg(F.coalesce(F.sum((~F.col("_kept")).cast("int")), F.lit(0)).alias("_all"))
    return chosen.withColumn("_seen", total).join(F.broadcast(everything)).withColumn("domain_capped", F.coalesce("_seen", "_all")).drop("_seen", "_all", "_kept", "_in_domain")


def reranked(pool: DataFrame, ranks: DataFrame, k: int = DEFAULTS.reading_set_k, exclude_below: float = 0.0) -> DataFrame:
    """The pool (item_id, place) in the order of provider scores, without those below the limit: the first k.

    Without any score, or if all are below it, the pool's own order counts; ``fallback`` tells which.
    """
    rows = pool.join(ranks.select("item_id", "rank_score"), "item_id", "left")
    state = rows.agg(F.count("rank_score").alias("n"), F.count_if(F.col("rank_score") >= exclude_below).alias("kept"))
    rows = rows.join(F.broadcast(state)).withColumn("fallback", F.when(F.col("n") == 0, "rank_failed_or_empty").when(F.col("kept") == 0, "all_excluded"))
    rows = rows.where(F.col("fallback").isNotNull() | (F.col("rank_score") >= exclude_below))
    order = [F.when(F.col("fallback").isNull(), -F.col("rank_score")), F.col("place")]
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order))).where(F.col("rank") <= k).drop("n", "kept")


def rank_pool(pool: DataFrame, answers: DataFrame, directions: DataFrame, k: int = DEFAULTS.reading_set_k, exclude_below: float = 0.0) -> DataFrame:
    """The reading set from a pool (item_id, direction, place) and a service's answers (direction, item_id, rank_score).

    A service is asked once for each direction that is there, so an answer counts for its own direction only.
    """
    mine = pool.join(directions.select("direction"), "direction", "left_semi").select("direction", "item_id")
    return reranked(pool, answers.join(mine, ["direction", "item_id"], "left_semi"), k, exclude_below)


def draws(seed: int, n: int) -> list[float]:
    """The first n numbers of a seeded generator, one for each slot of a page."""
    rng = random.Random(seed)
    return [rng.random() for _ in range(n)]


def interleaved(ranked: DataFrame, low: DataFrame, slots: list[float], probability: float = DEFAULTS.interleave_probability) -> DataFrame:
    """(item_id, slot, kind): before each ranked slot whose draw is under the probability comes the next low row.

    ``ranked`` and ``low`` have (item_id, place) from 1. Draws are spent only while low rows are left, so the i-th
    successful slot takes the i-th low row. ``slots`` are the draws of one page.
    """
    spark = ranked.sparkSession
    u = spark.createDataFrame(list(enumerate(slots, 1)), "place int, u double")
    n_low = low.agg(F.count("*").alias("_n"))
    hits = ranked.join(F.broadcast(u), "place").join(F.broadcast(n_low)).withColumn("_hit", (F.col("u") < probability).cast("int"))
    hits = hits.withColumn("_i", F.sum("_hit").over(Window.orderBy("place"))).where((F.col("_hit") == 1) & (F.col("_i") <= F.col("_n")))
    put = hits.select(F.col("_i").alias("place"), F.col("place").alias("slot")).join(low.select("place", "item_id"), "place")
    return ranked.select("item_id", F.col("place").alias("slot"), F.lit("ranked").alias("kind")).unionByName(put.select("item_id", "slot", F.lit("low_interleaved").alias("kind")))


def latest_batch(topics: DataFrame, n: int, group: str = "platform") -> DataFrame:
    """The first n topics by rank of each platform in the newest batch."""
    newest = topics.agg(F.max("batch").alias("batch"))
    w = Window.partitionBy(group).orderBy("rank", "topic_id")
    return topics.join(F.broadcast(newest), "batch", "left_semi").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def board(rows: DataFrame, per_source: int = 20) -> DataFrame:
    """(source_id, items): the best items of each source as an ordered list."""
    w = Window.partitionBy("source_id").orderBy(F.desc("relevance"), "item_id")
    top = rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_source)
    return top.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "item_id", "relevance"))), lambda x: F.struct(x["item_id"], x["relevance"])).alias("items"))


def rank_requests(rows: DataFrame, limit: int = DEFAULTS.rank_max_candidates, chunk: int = 16, chars: int = DEFAULTS.rank_text_chars) -> DataFrame:
    """Candidates of each direction for a ranking service: the first ``limit``, cut texts, in chunks from 1."""
    w = Window.partitionBy("direction").orderBy("place")
    top = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit)
    return top.withColumn("chunk", F.ceil(F.col("_n") / chunk).cast("int")).withColumn("text", F.substring(F.concat_ws("\n", "title", "content_text"), 1, chars)).drop("_n")


def seeded(item_id: str, seed: int) -> Column:
    """A random order of ids that every engine can repeat: the MD5 of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(item_id).cast("string")))


def stratified(rows: DataFrame, band: str, quotas: dict[str, int], seed: int, item_id: str = "item_id") -> DataFrame:
    """So many rows of each band, by a seeded hash of the id."""
    w = Window.partitionBy(band).orderBy(seeded(item_id, seed), item_id)
    want = F.create_map(*[x for k, v in quotas.items() for x in (F.lit(k), F.lit(v))])
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= want[F.col(band)]).drop("_n")


def quota_sample(rows: DataFrame, bucket: str, source: str, quotas: dict[str, int], seed: int, item_id: str = "item_id") -> DataFrame:
    """So many rows of each bucket: first one row of every source, then the others, by a seeded hash."""
    h = seeded(item_id, seed)
    rows = rows.withColumn("_s", F.row_number().over(Window.partitionBy(bucket, source).orderBy(h, item_id)))
    w = Window.partitionBy(bucket).orderBy((F.col("_s") > 1).cast("int"), h, item_id)
    want = F.create_map(*[x for k, v in quotas.items() for x in (F.lit(k), F.lit(v))])
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= want[F.col(bucket)]).drop("_s", "_n")


def recent(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The newest n rows of each key, newest first as ``place``."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def set_difference(base: DataFrame, other: DataFrame) -> DataFrame:
    """(item_id, change): excluded rows of base that other lacks, and added ones."""
    a = base.select("item_id").join(other.select("item_id"), "item_id", "left_anti").withColumn("change", F.lit("excluded"))
    b = other.select("item_id").join(base.select("item_id"), "item_id", "left_anti").withColumn("change", F.lit("added"))
    return a.unionByName(b)


def slices(texts: DataFrame, words: list[str], low: int = 80, high: int = 500, glue: int = 6, per_file: int = 3, total: int = 30) -> DataFrame:
    """Passages of ``low`` to ``high`` characters from up to ``glue`` adjacent paragraphs, the ones with most lexicon words.

    Equal starts of 50 characters count once; at most ``per_file`` of a file and ``total`` in all.
    """
    paragraphs = F.filter(F.transform(F.split("text", r"\n\s*\n"), lambda p: T.fold(p)), lambda p: p != "")
    cut = F.flatten(F.transform(F.sequence(F.lit(1), F.size("ps")), lambda i: F.transform(F.sequence(F.lit(1), F.lit(glue)), lambda n: F.struct(i.alias("i"), n.alias("n"), F.when(i + n - 1 <= F.size("ps"), F.array_join(F.slice("ps", i, n), "\n")).alias("t")))))
    rows = texts.select("file", paragraphs.alias("ps")).where("size(ps) > 0").select("file", F.explode(cut).alias("c")).select("file", "c.i", "c.n", F.col("c.t").alias("passage"))
    score = sum((F.regexp_count("passage", F.lit(w)) for w in words), F.lit(0))
    rows = rows.where(F.length("passage").between(low, high)).withColumn("score", score)
    order = [F.desc("score"), F.col("file"), F.col("i"), F.col("n")]
    once = rows.withColumn("_d", F.row_number().over(Window.partitionBy("file", F.substring("passage", 1, 50)).orderBy(*order))).where("_d = 1")
    mine = once.withColumn("_f", F.row_number().over(Window.partitionBy("file").orderBy(*order))).where(F.col("_f") <= per_file)
    return mine.drop("_d", "_f").orderBy(*order).limit(total)
