"""Vector routing: hit-first order, semantic duplicates, exploration picks, retrieval."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.config import DEFAULTS
from brightloom.functions import text as T
from brightloom.functions import vectors as V
from brightloom.operators import similarity
from brightloom.operators.evaluation import ranked

#: Rows of a direction that one task compares with another such part.
PART = 4096
#: Vectors that one task of a search keeps, and queries that it multiplies with them at once.
SHARD_ROWS, QUERY_ROWS = 32_768, 512


def embed_text(title: Column, body: Column, max_chars: int = DEFAULTS.embed_chars) -> Column:
    """Stripped title and the first characters of the body."""
    return F.concat_ws("\n", F.nullif(T.strip(F.coalesce(title, F.lit(""))), F.lit("")), F.nullif(F.substring(F.coalesce(body, F.lit("")), 1, max_chars), F.lit("")))


def missing_vectors(items: DataFrame, vectors: DataFrame, version: str) -> DataFrame:
    return items.join(vectors.where(F.col("model_version") == version).select("item_id"), "item_id", "left_anti")


def similarities(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Adds ``sim`` to the query of its direction; directions without a query keep their rows without it.

    Queries are one row a direction and small, so the plan joins them by hash; their norms are computed once.
    """
    q = queries.select("direction", F.col("vec").alias("_q"), V.norm(F.col("vec")).alias("_qn"))
    return vectors.join(q, "direction", "left").withColumn("sim", F.when(F.col("vec").isNotNull() & F.col("_q").isNotNull(), V.cosine(F.col("vec"), F.col("_q"), norm_b=F.col("_qn")))).drop("_q", "_qn")


def hit_first(items: DataFrame, vectors: DataFrame, queries: DataFrame, top_k: int = DEFAULTS.retrieval_top_k) -> DataFrame:
    """Adds (sim, position, is_hit): by direction the most similar first, then rows without a vector; no row is lost."""
    rows = similarities(items.join(vectors.select("item_id", "vec"), "item_id", "left"), queries).drop("vec")
    keep = [c for c in rows.columns if c not in ("direction", "sim", "item_id")]
    # positions from counts per similarity: a direction of any size is many tasks
    return ranked(rows, "direction", "sim", "item_id", *keep).withColumnRenamed("rank", "position").withColumn("is_hit", F.col("sim").isNotNull() & (F.col("position") <= top_k))


def routed(items: DataFrame, vectors: DataFrame, queries: DataFrame, directions: DataFrame, threshold: float = DEFAULTS.semantic_dedup_threshold, top_k: int = DEFAULTS.retrieval_top_k) -> DataFrame:
    """(item_id, direction, route, position, is_hit): candidates in the order of scoring; only semantic duplicates go.

    ``directions`` has (direction, enabled, paused, prompt_version, query_vec_version). A direction that is paused (its
    budget is used up), disabled or without a query vector of its prompt's version keeps its candidates in the order of
    their ids, none of them a hit: a route is never a filter.
    """
    ready = (~F.col("paused")) & F.col("enabled") & (F.coalesce("query_vec_version", F.lit(0)) == F.col("prompt_version"))
    state = directions.select("direction", F.when(F.col("paused"), "budget_paused").when(F.coalesce(ready, F.lit(False)), "routed").otherwise("disabled").alias("route"))
    rows = items.select("item_id", "direction").join(state, "direction")
    by_hand = rows.where("route <> 'routed'").withColumn("sim", F.lit(None).cast("double"))
    go = rows.where("route = 'routed'")
    mine = vectors.join(go.select("item_id"), "item_id", "left_semi")
    go = go.join(semantic_duplicates(mine, vectors, threshold).select("item_id"), "item_id", "left_anti")
    hits = hit_first(go, vectors, queries, top_k).select("item_id", "direction", "route", "position", "is_hit")
    rest = ranked(by_hand, "direction", "sim", "item_id", "route").select("item_id", "direction", "route", F.col("rank").alias("position"), F.lit(False).alias("is_hit"))
    return hits.unionByName(rest)


def stale_queries(directions: DataFrame) -> DataFrame:
    """Directions whose query vector is missing or of another version of the prompt: they need a new one."""
    fresh = F.col("query_vec").isNotNull() & (F.coalesce("query_vec_version", F.lit(0)) == F.col("prompt_version"))
    return directions.where(~F.coalesce(fresh, F.lit(False)))


def cached_queries(directions: DataFrame, made: DataFrame) -> DataFrame:
    """The cache (direction, prompt_version, query_vec, query_vec_version) after a round that made vectors (direction,
    vec) for some stale directions; those it failed for stay as they were."""
    new = made.where("vec IS NOT NULL").select("direction", F.col("vec").alias("_v"))
    rows = directions.join(new, "direction", "left")
    fresh = F.col("_v").isNotNull()
    return rows.select("direction", "prompt_version", F.when(fresh, F.col("_v")).otherwise(F.col("query_vec")).alias("query_vec"), F.when(fresh, F.col("prompt_version")).otherwise(F.col("query_vec_version")).alias("query_vec_version"))


def filled(numbered: DataFrame, answers: DataFrame, dims: int) -> DataFrame:
    """(item_id, batch, vec): the vectors that may be kept of a filling in batches.

    ``numbered`` has (item_id, batch), ``answers`` (item_id, vec). A batch failed if a vector is missing or of another
    length than ``dims``; from the first failed batch on nothing counts, and the rest waits for the next round.
    """
    rows = numbered.join(answers, "item_id", "left")
    bad = rows.where(F.coalesce(F.size("vec") != dims, F.lit(True))).agg(F.min("batch").alias("_failed"))
    return rows.join(F.broadcast(bad)).where(F.col("_failed").isNull() | (F.col("batch") < F.col("_failed"))).select("item_id", "batch", "vec")


def _origins(threshold: float):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"item_id": [], "origin": []})
        a, b = (np.stack(x.to_numpy()).astype(np.float64) for x in (left["vec"], right["_vec"]))
        na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
        ia, ib = left["item_id"].to_numpy(), right["_item_id"].to_numpy()
        in_batch = right["_in_batch"].to_numpy(dtype=bool)
        found = np.full(len(a), np.iinfo(np.int64).max)
        for at in range(0, len(a), 512):
            cut = slice(at, at + 512)
            with np.errstate(invalid="ignore", divide="ignore"):
                sim = np.nan_to_num(a[cut] @ b.T / (na[cut, None] * nb[None, :]), nan=0.0)
            allowed = (sim >= threshold) & (ia[cut, None] != ib[None, :]) & (~in_batch[None, :] | (ib[None, :] < ia[cut, None]))
            found[cut] = np.where(allowed, ib[None, :], found[cut, None]).min(axis=1)
        hit = found != np.iinfo(np.int64).max
        return pd.DataFrame({"item_id": ia[hit], "origin": found[hit]})

    return run


def hash_shape(n: int, threshold: float, recall: float, part: int) -> tuple[int, int]:
    """(bits, tables) of sign hashes for n vectors: about ``part`` of them meet in a bucket, and a pair at the threshold
    meets in some table with the probability ``recall``."""
    bits = min(60, max(0, math.ceil(math.log2(max(1, n) / part))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, 1 if bits == 0 else math.ceil(math.log(1 - recall) / math.log(1 - meet))


def sign_keys(vec: Column, bits: int, tables: int, seed: int = 23) -> Column:
    """A key for each table: the signs of the products with ``bits`` random hyperplanes."""
    if bits == 0:
        return F.array(*[F.lit(0).cast("long")] * tables)

    @F.pandas_udf("array<long>")
    def of(vectors: pd.Series) -> pd.Series:
        keys: list = [None] * len(vectors)
        for dim in {len(v) for v in vectors}:
            planes = np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))
            at = [i for i, v in enumerate(vectors) if len(v) == dim]
            signs = np.stack([vectors.iloc[i] for i in at]).astype(np.float64) @ planes > 0
            for i, k in zip(at, signs.reshape(len(at), tables, bits) @ (1 << np.arange(bits, dtype=np.int64)), strict=True):
                keys[i] = k
        return pd.Series(keys)

    return of(vec)


def semantic_duplicates(candidates: DataFrame, pool: DataFrame, threshold: float = DEFAULTS.semantic_dedup_threshold, part: int = PART, recall: float | None = None, shape: tuple[int, int] | None = None) -> DataFrame:
    """(item_id, duplicate_of) of candidates that resemble another item of their direction.

    The origin is the smallest id j with cosine of at least the threshold, where j is no version of a page (guid with
    ``#v-``) and is either outside of the batch or an earlier candidate. A found duplicate can be an origin itself;
    nothing is closed transitively. Both tables have (item_id, direction, guid, vec). Directions are cut into parts
    of bounded size, and each task compares one part of candidates with one part of the pool as matrix products.

    Without ``recall`` the join is exact, and pivots keep apart what cannot reach the threshold (``similarity``); rows
    without an id, and vectors that are null, zero or not finite, are duplicates of nothing. With ``recall`` vectors meet
    only in equal buckets of sign hashes (``hash_shape``, or the given ``shape``): cosines stay exact, and a pair at the
    threshold is found with that probability, nearer ones more surely.
    """
    if recall is None and threshold > 0:
        answers = ~F.contains(F.coalesce("guid", F.lit("")), F.lit("#v-"))
        others = pool.join(candidates.select("item_id"), "item_id", "left_anti")
        sides = [t.select(F.col("item_id").cast("long").alias("item_id"), "direction", "vec", F.lit(mine).alias("asks"), answers.alias("answers"), F.lit(mine).alias("in_batch")) for t, mine in ((candidates, True), (others.where(answers), False))]
        return similarity.least_similar(sides[0].unionByName(sides[1]), threshold, part)
    bits, tables = (0, 1) if recall is None else shape or hash_shape(pool.groupBy("direction").count().agg(F.max("count")).first()[0] or 0, threshold, recall, part)
    batch = candidates.select("item_id", "direction", "vec")
    others = pool.join(candidates.select("item_id"), "item_id", "left_anti").withColumn("in_batch", F.lit(False))
    both = others.unionByName(candidates.withColumn("in_batch", F.lit(True)).select(*others.columns)).where(~F.contains(F.coalesce("guid", F.lit("")), F.lit("#v-")))
    bucket = ["direction", "table", "key"]
    keyed = lambda t, *more: t.where("vec IS NOT NULL").select("item_id", "direction", "vec", *more, F.posexplode(sign_keys(F.col("vec"), bits, tables)).alias("table", "key"))
    both, batch = keyed(both, "in_batch"), keyed(batch)
    parts = lambda t, name: t.groupBy(*bucket).agg(F.ceil(F.count("*") / part).cast("int").alias(name))
    sizes = parts(batch, "na").join(parts(both, "nb"), bucket)
    place = lambda n: F.pmod(F.xxhash64("item_id"), F.col(n).cast("long")).cast("int")
    left = batch.join(sizes, bucket).withColumn("a", place("na")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("item_id", *bucket, "vec", "a", "b")
    right = both.join(sizes, bucket).withColumn("b", place("nb")).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).select("item_id", *bucket, "vec", "in_batch", "a", "b")
    keys = [*bucket, "a", "b"]
    right = right.select(*[F.col(c).alias(f"_{c}") for c in right.columns])  # the tables may be cut from one
    found = left.groupBy(*keys).cogroup(right.groupBy(*[f"_{c}" for c in keys])).applyInPandas(_origins(threshold), "item_id long, origin long")
    return found.groupBy("item_id").agg(F.min("origin").alias("duplicate_of"))


def explore_pool(rows: DataFrame, percentile: float = DEFAULTS.explore_percentile, floor: int = DEFAULTS.explore_floor) -> DataFrame:
    """Rows (direction, item_id, sim, quality, passed) that exploration may pick: not passed, good enough, and at most
    as similar as the percentile (linear interpolation) of all known similarities of the direction."""
    cuts = rows.where("sim IS NOT NULL").groupBy("direction").agg(F.expr(f"percentile(sim, {percentile / 100.0})").alias("cut"))
    return rows.join(cuts, "direction").where((~F.coalesce("passed", F.lit(True))) & (F.coalesce("quality", F.lit(0)) >= floor) & (F.col("sim") <= F.col("cut")))


def explore_picks(rows: DataFrame, quota: int = DEFAULTS.explore_quota, weight: float = DEFAULTS.explore_mmr_lambda, direction_type: str = "string", **limits) -> DataFrame:
    """(direction, item_id, pick): greedy picks far from the query and from each other (maximal marginal relevance).

    Each pick is a round over the pool wherever it lies: the best row of each part, then of all parts. Only the picks
    so far, ``quota`` vectors a direction, come to the driver and go out again. Ties go to the smaller similarity,
    then to the smaller id.
    """
    spark = rows.sparkSession
    pool = explore_pool(rows, **limits).where("vec IS NOT NULL").select("direction", "item_id", "sim", "vec", V.norm(F.col("vec")).alias("_n")).persist()
    kinds = {f.name: f.dataType.simpleString() for f in pool.schema}
    schema = f"direction {kinds['direction']}, item_id {kinds['item_id']}, pick int, vec {kinds['vec']}, n double"
    picks = []
    for at in range(1, quota + 1):
        chosen = spark.createDataFrame(picks, schema).groupBy("direction").agg(F.collect_list(F.struct("item_id", "vec", "n")).alias("_picks"))
        left = pool.join(F.broadcast(chosen), "direction", "left").where(~F.coalesce(F.exists("_picks", lambda p: p["item_id"] == F.col("item_id")), F.lit(False)))
        near = F.coalesce(F.array_max(F.transform("_picks", lambda p: V.cosine(F.col("vec"), p["vec"], F.col("_n"), p["n"]))), F.lit(0.0))
        score = -weight * F.col("sim") - (1 - weight) * near
        best = left.groupBy("direction").agg(F.max(F.struct(score.alias("score"), (-F.col("sim")).alias("sim"), (-F.col("item_id")).alias("id"), "vec", "_n")).alias("b"))
        found = [(r["direction"], -r["b"]["id"], at, r["b"]["vec"], r["b"]["_n"]) for r in best.collect()]
        if not found:
            break
        picks += found
    pool.unpersist()
    return spark.createDataFrame([p[:3] for p in picks], f"direction {direction_type}, item_id long, pick int")


def explore_settings(directions: DataFrame) -> DataFrame:
    """Effective parameters of each direction: its own value, else the site's if not zero, else the default."""
    own = {"floor": DEFAULTS.explore_floor, "percentile": DEFAULTS.explore_percentile, "quota": DEFAULTS.explore_quota}
    return directions.select("direction", *[F.coalesce(F.col("explore_config")[k].try_cast("int"), T.or_default(F.col(f"site_{k}"), v)).alias(k) for k, v in own.items()])


def injected(listed: DataFrame, picks: DataFrame) -> DataFrame:
    """The ranked list, then the picks that it does not hold yet, flagged ``explore``; (item_id, place, flag)."""
    last = listed.agg(F.coalesce(F.max("place"), F.lit(0)).alias("_last"))
    new = picks.join(listed.select("item_id"), "item_id", "left_anti").join(F.broadcast(last))
    return listed.select("item_id", "place", F.lit(None).cast("string").alias("flag")).unionByName(new.select("item_id", (F.col("_last") + F.col("pick")).alias("place"), F.lit("explore").alias("flag")))


def _norms(a: np.ndarray) -> np.ndarray:
    """Norms with the components added in order, so that equal vectors have equal norms to the last bit."""
    return np.sqrt(np.add.accumulate(a * a, axis=1)[:, -1])


def _units(a: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.divide(a, n[:, None], out=np.zeros_like(a), where=n[:, None] > 0)


def _nearest(k: int):
    def best(groups: dict, ids: np.ndarray, block: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for dim, rows in block.groupby("dim", sort=False):
            at, a, na, unit = groups.get(dim, (np.zeros(0, dtype=np.int64), None, None, None)) if dim > 0 else (np.zeros(0, dtype=np.int64), None, None, None)
            if len(at):
                q = np.stack(rows["vec"].to_numpy()).astype(np.float64)
                nq = _norms(q)
                about = _units(q, nq) @ unit.T
            others = np.sort(ids if not len(at) else np.delete(ids, at) if len(at) < k else ids[:0])
            names, hits, all_sims = rows["id"].to_numpy(dtype=np.int64), [], []
            for i in range(len(names)):
                found, sims = np.zeros(0, dtype=np.int64), np.zeros(0)
                if len(at):
                    # products of matrices differ in the last bits from sums in order: those near the k-th are summed again
                    near = np.flatnonzero(about[i] >= np.partition(about[i], -k)[-k] - 1e-9) if len(at) > k else np.arange(len(at))
                    dots, norms = np.add.accumulate(a[near] * q[i], axis=1)[:, -1], na[near] * nq[i]
                    sims = np.divide(dots, norms, out=np.zeros(len(near)), where=norms > 0)
                    order = np.lexsort((ids[at[near]], -sims))[:k]
                    found, sims = ids[at[near]][order], sims[order]
                rest = others[: k - len(found)]
                hits.append(np.concatenate((found, rest)))
                all_sims.append(np.concatenate((sims, np.full(len(rest), np.nan))))  # becomes null
            yield pd.DataFrame({"query_id": np.repeat(names, [len(x) for x in hits]), "item_id": np.concatenate(hits), "sim": np.concatenate(all_sims)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, parts, groups, ids = None, [], None, None
        for batch in batches:
            marks = batch[["shard", "is_query"]].to_numpy(dtype=np.int64)
            starts = np.concatenate(([0], np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1, [len(batch)]))
            for begin, end in zip(starts[:-1], starts[1:], strict=True):
                number, is_query = marks[begin]
                rows = batch.iloc[begin:end]
                if number != shard:
                    shard, parts, groups = number, [], None
                if not is_query:
                    parts.append(rows[["id", "dim", "vec"]])
                    continue
                if groups is None:
                    if not parts:
                        continue
                    all_rows = pd.concat(parts, ignore_index=True)
                    ids, groups, parts = all_rows["id"].to_numpy(dtype=np.int64), {}, []
                    for dim, mine in all_rows.groupby("dim", sort=False):
                        if dim > 0:
                            a = np.stack(mine["vec"].to_numpy()).astype(np.float64)
                            groups[dim] = (mine.index.to_numpy(), a, n := _norms(a), _units(a, n))
                for at in range(0, len(rows), QUERY_ROWS):
                    made = list(best(groups, ids, rows.iloc[at : at + QUERY_ROWS]))
                    yield pd.concat(made, ignore_index=True)

    return run


def ranked_matches(queries: DataFrame, vectors: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, item_id, sim, rank): the k most similar vectors of each query, ties by id.

    Vectors are dealt by a hash into shards of bounded size, and every query is sent to every shard: a task keeps one
    shard as a matrix and streams the queries past it in blocks, giving each query's best k of the shard. So neither
    side has to be small. Ids are whole numbers; rows without an id take no part. Similarities are sums in the order
    of the components; a zero vector has 0. Vectors that are null, empty or not finite, and those of another length
    than the query, have none (null) and come last.
    """
    n = V.norm(F.col("vec"))
    dim = F.when(n < float("inf"), F.size("vec")).otherwise(-1).alias("dim")  # null and NaN are not below it
    shards = max(2 * vectors.sparkSession.sparkContext.defaultParallelism, -(-vectors.count() // shard_rows))
    side = lambda rows, name: rows.where(F.col(name).isNotNull()).select(F.col(name).cast("long").alias("id"), dim, "vec")
    left = side(vectors, "item_id").withColumn("shard", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(shards)).cast("int")).withColumn("is_query", F.lit(0))
    right = side(queries, "query_id").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("is_query", F.lit(1))
    placed = left.unionByName(right).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "is_query")
    found = placed.mapInPandas(_nearest(k), "query_id long, item_id long, sim double")
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "item_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
