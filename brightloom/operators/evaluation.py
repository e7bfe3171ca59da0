"""Evaluation of retrieval and ranking: recall, MRR, AUC, rank correlation, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.functions import vectors as V

#: Bands of scores for each power of e, and ids of a block: how finely the rows of a group are dealt.
BANDS, ID_BLOCK = 1024, 65_536


def retrieval(ranked: DataFrame, positives: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """(query_id, n_positive, recall_k..., mrr): shares over all positives of a query, found or not."""
    hits = positives.join(ranked.select("query_id", "item_id", "rank"), ["query_id", "item_id"], "left")
    return hits.groupBy("query_id").agg(
        F.count("*").alias("n_positive"), *[F.avg(F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0))).alias(f"recall_{k}") for k in ks], F.avg(F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0))).alias("mrr")
    )


def _band(score: Column) -> Column:
    """A whole number that never falls as the score rises: narrow near 0, of any scale; null without a score."""
    size = F.floor(F.log1p(F.abs(score) * BANDS) * BANDS).cast("long")
    return F.when(F.isnan(score), F.lit((1 << 63) - 1)).when(score < 0, -size - 1).otherwise(size)


def preceding(counts: DataFrame, by: str, score: str, n: str, order: list[Column], down: bool = False) -> DataFrame:
    """Adds ``before``: the sum of n over the earlier rows of the group in the order, which begins with the score.

    A group is cut into bands of the score, so one with many scores is many tasks: rows add up within their band, and
    sums of whole bands come from one small row each.
    """
    upto = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = counts.withColumn("_band", _band(F.col(score).cast("double")))
    bands = rows.groupBy(F.col(by).alias("_by"), F.col("_band").alias("_b")).agg(F.sum(n).alias("_n"))
    starts = bands.withColumn("_start", upto(Window.partitionBy("_by").orderBy(F.desc("_b") if down else F.asc("_b")), "_n")).drop("_n")
    inside = rows.withColumn("_in", upto(Window.partitionBy(by, "_band").orderBy(*order), n))
    joined = inside.join(starts, F.col(by).eqNullSafe(F.col("_by")) & F.col("_band").eqNullSafe(F.col("_b")))
    return joined.withColumn("before", F.col("_start") + F.col("_in")).drop("_by", "_b", "_band", "_start", "_in")


def ranked(rows: DataFrame, by: str, score: str, item_id: str, *keep: str) -> DataFrame:
    """Adds ``rank`` from 1 by falling score, ties by id, to every row; (by, score, item_id, *keep, rank).

    From counts per score and block of ids, so neither a large group nor many equal scores are one task.
    """
    rows = rows.select(by, score, item_id, *keep).withColumn("_block", F.floor(F.col(item_id) / ID_BLOCK))
    keys = [by, score, "_block"]
    counts = preceding(rows.groupBy(*keys).agg(F.count("*").alias("_n")), by, score, "_n", [F.desc(score), F.col("_block")], down=True)
    counts = counts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], "before")
    inside = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(item_id)))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]
    return inside.join(counts, same[0] & same[1] & same[2]).select(by, score, item_id, *keep, (F.col("before") + F.col("_at")).alias("rank"))


def auc(rows: DataFrame, score: str = "score", positive: str = "positive", by: str = "query_id") -> DataFrame:
    """(by, auc): probability that a positive scores above a negative, ties by half; null without both.

    From counts per distinct score, so equal scores of any number are one row.
    """
    counts = rows.groupBy(by, score).agg(F.count_if(positive).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    won = preceding(counts, by, score, "n", [F.asc(score)]).withColumn("won", F.col("p") * (F.col("before") + F.col("n") / 2.0))
    return won.groupBy(by).agg(F.try_divide(F.sum("won"), (F.sum("p") * F.sum("n")).cast("double")).alias("auc"))


def spearman(rows: DataFrame, x: str, y: str, by: str, item_id: str, minimum: int = 3) -> DataFrame:
    """(by, n, rho): correlation of ordinal ranks, ties by id; null under ``minimum`` rows.

    Ranks come from counts (``ranked``), so a large group is many tasks.
    """
    up = rows.select(by, item_id, (-F.col(x).cast("double")).alias("_x"), (-F.col(y).cast("double")).alias("_y"))
    first = ranked(up, by, "_x", item_id, "_y").withColumnRenamed("rank", "rx")
    both = ranked(first, by, "_y", item_id, "rx").select(by, F.col("rx").cast("double").alias("rx"), F.col("rank").cast("double").alias("ry"))
    return both.groupBy(by).agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("rho")).select(by, "n", F.when(F.col("n") >= minimum, F.col("rho")).alias("rho"))


def agreement(rows: DataFrame, a: str, b: str, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("int")).alias("agreement"))


def band_means(rows: DataFrame, band: str, value: str) -> DataFrame:
    return rows.groupBy(band).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def mixture(ranked: DataFrame, labels: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, labelled, mixed): of the first k, labelled items and those that belong to another brief."""
    top = ranked.where(F.col("rank") <= k).join(labels.select("item_id", "owner"), "item_id")
    return top.groupBy("query_id").agg(F.count("*").alias("labelled"), F.count_if(F.col("owner") != F.col("query_id")).alias("mixed"))


def rank_summary(ranks: DataFrame, by: str) -> DataFrame:
    return ranks.groupBy(by).agg(F.count("*").alias("n"), F.avg((F.col("rank") == 1).cast("int")).alias("recall_1"), F.avg((F.col("rank") <= 5).cast("int")).alias("recall_5"), F.avg("rank").alias("mean_rank"), F.max("rank").alias("worst_rank"))


def anchor_consistency(rows: DataFrame, a: str, b: str, within: float = 20) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.avg(F.abs(F.col(a) - F.col(b))).alias("mae"), F.count_if(F.abs(F.col(a) - F.col(b)) <= within).alias("within"))


def verdicts(rows: DataFrame, by: str) -> DataFrame:
    """Accuracy of verdicts and of reasons among right verdicts, errors and trap rows."""
    right = F.col("verdict") == F.col("gold_verdict")
    return rows.groupBy(by).agg(
        F.count("*").alias("n"), F.count_if(F.col("verdict").isNull()).alias("errors"), F.avg(F.coalesce(right, F.lit(False)).cast("int")).alias("accuracy"),
        F.avg(F.when(right, (F.col("reason") == F.col("gold_reason")).cast("int"))).alias("reason_accuracy"), F.count_if(F.col("trap") & ~F.coalesce(right, F.lit(False))).alias("trapped"),
    )


def labelled_cascade(rows: DataFrame, classes: list[tuple[str, Column, int]], seed: int, item_id: str = "item_id") -> DataFrame:
    """The first class whose condition holds, and of each class so many rows by a seeded hash."""
    kind = F.lit(None).cast("string")
    for name, condition, _ in reversed(classes):
        kind = F.when(condition, name).otherwise(kind)
    w = Window.partitionBy("class").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(item_id).cast("string"))), item_id)
    want = F.create_map(*[x for name, _, n in classes for x in (F.lit(name), F.lit(n))])
    return rows.withColumn("class", kind).where("class IS NOT NULL").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= want[F.col("class")]).drop("_n")


def pair_similarities(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(kind, a, b, sim) of the gold pairs (kind, a, b) both of whose items have a vector: products of unit vectors."""
    side = lambda name: vectors.select(F.col("item_id").alias(name), F.col("vec").alias(f"_{name}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("kind", "a", "b", V.dot(F.col("_a"), F.col("_b")).alias("sim"))


def roll_up(rows: DataFrame, by: list[str], means: list[str], latency: str) -> DataFrame:
    """Means over the values that are there, to three places, and the median latency, of each group; null without any."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 3).alias(c) for c in means], F.expr(f"percentile({latency}, 0.5)").alias(f"median_{latency}"))


def module_status(reports: DataFrame) -> DataFrame:
    """(module, total, killed, survived, other, score) of mutation runs (module, status); no score without decided ones."""
    done = F.count_if(F.col("status") == "killed"), F.count_if(F.col("status") == "survived")
    return reports.groupBy("module").agg(
        F.count("*").alias("total"), done[0].alias("killed"), done[1].alias("survived"), (F.count("*") - done[0] - done[1]).alias("other"), F.try_divide(done[0].cast("double"), (done[0] + done[1]).cast("double")).alias("score")
    )


def gold_labels(scores: DataFrame) -> DataFrame:
    """(item_id, scores): a map from brief to the last score of the item for it."""
    last = scores.groupBy("item_id", "brief").agg(F.max_by("score", "score_id").alias("score"))
    return last.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("brief", "score"))).alias("scores"))
