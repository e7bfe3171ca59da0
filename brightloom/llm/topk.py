"""Exact top-k search by integer inner product: tiled matrix products, partial selection, tree merging.

Candidates are dealt into shards of bounded size by a hash. Every query is sent to every shard, as blocks: a task
keeps one shard as a matrix and streams the queries past it, one product per Arrow batch, and gives each query's best
k of the shard. The lists are merged in levels, FAN shards at a time, so no group grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.llm.common import stored
from brightloom.llm.embeddings import finite

K, SCALE, EVERY = 5, 256, 50
SHARD_ROWS, QUERY_ROWS, FAN = 32_768, 512, 16
#: Products of doubles are exact integers while sums stay below this.
EXACT = float(2**53)
#: Products of longs stay longs below this, with a margin for the rounding of the bound.
LONGS = float(2**63 - 2**20)


def quantised(vectors: pd.Series, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of every component, as doubles that hold whole numbers."""
    return np.floor(np.stack(vectors.to_numpy()).astype(np.float64) * float(scale))


def inner_products(block: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of both, as longs; one that leaves the longs is an error.

    Doubles are exact while no sum can reach 2^53, longs while none can reach 2^63; other tiles use Python's integers.
    """
    most = float(np.abs(matrix).max(initial=0)) * float(np.abs(block).max(initial=0)) * matrix.shape[1]
    if most < EXACT:
        return (block @ matrix.T).astype(np.int64)
    if most < LONGS:
        return block.astype(np.int64) @ matrix.astype(np.int64).T
    whole = [[[int(x) for x in row] for row in rows.tolist()] for rows in (block, matrix)]
    scores = np.array(whole[0], dtype=object) @ np.array(whole[1], dtype=object).T
    if scores.size and (scores.max() >= 2**63 or scores.min() < -(2**63)):
        raise OverflowError("an inner product leaves the range of a long")
    return scores.astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, mine: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of the k best candidates of each row, ties to the smaller id; a row's own id is left out.

    ``ids`` ascend. The whole block is selected at once; only rows with more than k hits, by ties, are cut one by one.
    """
    own = ids[None, :] == mine[:, None]
    if own.any():  # all rows of the own id, however many, go before the selection
        scores = np.where(own, np.iinfo(np.int64).min, scores)
    if k < scores.shape[1]:
        floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    else:
        floor = np.full(len(scores), np.iinfo(np.int64).min)
    hits = (scores >= floor[:, None]) & ~own
    for i in np.flatnonzero(hits.sum(axis=1) > k):
        above = np.flatnonzero((scores[i] > floor[i]) & hits[i])
        level = np.flatnonzero((scores[i] == floor[i]) & hits[i])[: k - len(above)]
        hits[i] = False
        hits[i, above] = hits[i, level] = True
    row, at = np.nonzero(hits)
    order = np.lexsort((ids[at], ~scores[row, at], row))
    row, at = row[order], at[order]
    return row, ids[at], scores[row, at]


def _search(k: int, scale: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, parts, matrix, ids = None, [], None, None
        for batch in batches:
            marks = batch[["dim", "shard", "is_query"]].to_numpy(dtype=np.int64)
            starts = np.concatenate(([0], np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1, [len(batch)]))
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                dim, number, is_query = marks[a]
                rows = batch.iloc[a:b]
                numbers = quantised(rows["q"], scale)
                if (dim, number) != shard:
                    shard, parts, matrix = (dim, number), [], None
                if not is_query:
                    parts.append((rows["vec_id"].to_numpy(dtype=np.int64), numbers))
                    matrix = None
                    continue
                if not parts:
                    continue
                if matrix is None:
                    ids, matrix = (np.concatenate(x) for x in zip(*parts, strict=True))
                    order = np.argsort(ids, kind="stable")
                    ids, matrix = ids[order], matrix[order]
                    parts = [(ids, matrix)]
                for at in range(0, len(numbers), QUERY_ROWS):
                    block, mine = numbers[at : at + QUERY_ROWS], rows["vec_id"].to_numpy(dtype=np.int64)[at : at + QUERY_ROWS]
                    scores = inner_products(block, matrix)
                    row, vec, score = _best(scores, ids, mine, k)
                    yield pd.DataFrame({"query_id": mine[row], "shard": number, "vec_id": vec, "score": score})

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k candidates of highest integer inner product.

    Both tables have (vec_id, embedding). Defined cases: rows with a null vec_id, and vectors that are null, empty or
    hold null or non-finite components, take no part on either side; a vector of another length is no candidate of a
    query. A row is no candidate of a query of its own vec_id. Rows that repeat a vec_id are candidates each; a
    repeated query is answered once, for its smallest vector. Scores are exact to the ends of the long range; an inner
    product beyond it is an error. Fewer than k candidates give fewer rows. Ties go to the smaller vec_id. Extra columns
    are not read.
    """
    ok = F.col("vec_id").isNotNull() & finite(F.col("embedding"))
    pick = [F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dim"), F.col("embedding").alias("q")]
    candidates = stored(vectors.where(ok).select(*pick), "candidates")
    n = candidates.count()
    shards = max(2 * vectors.sparkSession.sparkContext.defaultParallelism, -(-n // shard_rows))
    left = candidates.withColumn("shard", F.pmod(F.xxhash64("vec_id", "q", F.lit(3)), F.lit(shards)).cast("int")).withColumn("is_query", F.lit(0))
    asked = queries.where(ok).select(*pick).groupBy("vec_id").agg(F.min(F.struct("dim", "q")).alias("x")).select("vec_id", "x.dim", "x.q")
    right = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("is_query", F.lit(1))
    placed = left.unionByName(right).repartitionById(shards, F.col("shard")).sortWithinPartitions("dim", "shard", "is_query")
    found = placed.select("vec_id", "dim", "q", "shard", "is_query").mapInPandas(_search(k, scale), "query_id long, shard int, vec_id long, score long")
    while True:
        found = found.withColumn("shard", F.floor(F.col("shard") / FAN).cast("int"))
        best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
        merged = found.groupBy("query_id", "shard").agg(best.alias("best"))
        shards = -(-shards // FAN)
        if shards == 1:
            return merged.select("query_id", F.posexplode("best").alias("at", "hit")).select(
                "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.s")).alias("score")
            )
        found = merged.select("query_id", "shard", F.explode("best").alias("hit")).select("query_id", "shard", "hit.vec_id", (-F.col("hit.s")).alias("score"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The K best of every EVERY-th vector; cases as in ``top_k``."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::DOUBLE) AS q FROM embeddings),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
