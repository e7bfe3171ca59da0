"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosine, connected components.

1. Equal vectors of a label form a class; only its smallest id takes part in the hashing.
2. A table keys a vector by the signs of its products with random hyperplanes. The bits of a key grow with the
   logarithm of the number of vectors, so buckets keep their size; the number of tables follows from the bits and the
   recall wanted at the threshold. Buckets of more than a tile are split into pairs of chunks.
3. A tile computes all its cosines as one matrix product in double precision. A pair is counted in the first table
   that brings it together and in no other, so link counts add up without a list of pairs.
4. Each tile gives a spanning forest of its links; distributed components join them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.llm.common import stored
from brightloom.llm.components import connected_components
from brightloom.llm.tiles import tiled

THRESHOLD, RECALL, BUCKET, TILE, SEED = 0.93, 0.9999, 256, 1024, 17
CHUNK = 256


def finite(vector: Column) -> Column:
    """Not null, not empty, and without null, NaN or infinite components."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & ok, F.lit(False))


def shape_of(n: int, threshold: float, recall: float, bucket: int) -> tuple[int, int]:
    """(bits, tables) for n vectors: about ``bucket`` vectors a bucket, and ``recall`` of pairs at the threshold."""
    bits = max(2, min(60, math.ceil(math.log2(max(1, n) / bucket)) if n > bucket else 2))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def float_kind(rows: DataFrame) -> tuple[str, str]:
    """(SQL type, bytes) in which the components of ``embedding`` are carried: single precision only if the table has no more."""
    return ("array<float>", "<f4") if rows.schema["embedding"].dataType.simpleString() == "array<float>" else ("array<double>", "<f8")


def _unit(vectors: pd.Series, kind: str) -> tuple[np.ndarray, np.ndarray]:
    rows = np.stack([np.frombuffer(x, dtype=kind) for x in vectors]).astype(np.float64)
    return rows, np.sqrt((rows * rows).sum(axis=1))


def hash_keys(classes: DataFrame, bits: int, tables: int, seed: int = SEED) -> DataFrame:
    """Adds ``keys``, one number per table, and the vector as bytes."""
    kind = float_kind(classes)[1]

    @F.pandas_udf("keys array<long>, vector binary")
    def of(vectors: pd.Series) -> pd.DataFrame:
        keys: list = [None] * len(vectors)
        for dim in {len(v) for v in vectors}:
            planes = np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))
            at = [i for i, v in enumerate(vectors) if len(v) == dim]
            rows = np.stack([vectors.iloc[i] for i in at]).astype(np.float64)
            rows /= np.sqrt((rows * rows).sum(axis=1, keepdims=True))
            signs = (rows @ planes > 0).reshape(len(at), tables, bits)
            for i, k in zip(at, signs @ (1 << np.arange(bits, dtype=np.int64)), strict=True):
                keys[i] = k
        return pd.DataFrame({"keys": keys, "vector": [np.asarray(v, dtype=kind).tobytes() for v in vectors]})

    return classes.withColumn("hashed", of("embedding")).select("rep", "mark", "label", "weight", F.size("embedding").alias("dim"), "hashed.keys", "hashed.vector")


def _tile_links(threshold: float, kind: str):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, _, table, _, left, right = key
        own = rows["chunk"].to_numpy() == left
        rows = pd.concat([rows[own], rows[~own]], ignore_index=True)
        n_left, n = int(own.sum()), len(rows)
        vectors, norms = _unit(rows["vector"], kind)
        keys = np.stack(rows["keys"].to_numpy())[:, :table]
        reps, marks, weights = (rows[c].to_numpy(dtype=np.int64) for c in ("rep", "mark", "weight"))
        first_b = 0 if left == right else n_left
        counts, linked = np.zeros(n, dtype=np.int64), np.zeros((n, n), dtype=bool)
        for a in range(0, n_left, CHUNK):
            b = min(a + CHUNK, n_left)
            cosine = vectors[a:b] @ vectors[first_b:].T / (norms[a:b, None] * norms[None, first_b:])
            near = cosine >= threshold
            if left == right:
                near[np.arange(b - a), np.arange(a, b)] = False
            linked[a:b, first_b:] = near
            for t in range(table):
                near &= keys[a:b, t][:, None] != keys[first_b:, t][None, :]
            counts[a:b] += near @ weights[first_b:]
            if left != right:
                counts[first_b:] += weights[a:b] @ near
                linked[first_b:, a:b] = linked[a:b, first_b:].T
        root = np.full(n, -1)
        for i in np.lexsort((marks, reps)):
            if root[i] < 0:
                root[i], frontier = i, np.array([i])
                while len(frontier):
                    frontier = np.flatnonzero(linked[frontier].any(axis=0) & (root < 0))
                    root[frontier] = i
        out = pd.DataFrame({"rep": reps, "mark": marks, "found": counts, "root_rep": reps[root], "root_mark": marks[root]})
        return out[(out["found"] > 0) | (root != np.arange(n))]

    return run


def link_tiles(classes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET, tile: int = TILE) -> DataFrame:
    """(rep, mark, found, root_rep, root_mark) of every tile: links counted for a class there, and the smallest class
    that it reaches there. A class is named by its smallest id and, as ids may repeat, a hash."""
    bits, tables = shape_of(classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0, threshold, recall, bucket)
    hashed = stored(hash_keys(classes, bits, tables), "vector-keys")
    keyed = hashed.select("rep", "mark", "label", "dim", F.posexplode("keys").alias("table", "key"))
    ids = ["label", "dim", "table", "key"]
    with_vectors = tiled(keyed, ids, "mark", tile).join(hashed.select("rep", "mark", "weight", "keys", "vector"), ["rep", "mark"])
    groups = with_vectors.groupBy(*ids, "left_chunk", "right_chunk")
    return groups.applyInPandas(_tile_links(threshold, float_kind(classes)[1]), "rep long, mark long, found long, root_rep long, root_mark long")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label).

    Defined cases: a row with a null label or vec_id, and a vector that is null, empty, zero or holds null or
    non-finite components, links with nothing; neither do vectors of different lengths. Rows that repeat a vec_id
    count as vectors of their own. kept is null where vec_id is. Extra columns are not read; an empty table gives
    no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast(float_kind(vectors)[0]).alias("embedding"))
    usable = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0))
    hashes = [F.xxhash64("embedding").alias("e1"), F.xxhash64(F.lit(9), "embedding").alias("e2")]
    mark = F.xxhash64("label", "e1", "e2").alias("mark")
    usable = usable.select("*", *hashes)
    classes = stored(usable.groupBy("label", "e1", "e2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("embedding").alias("embedding")).select("*", mark), "vector-classes")
    tiles = stored(link_tiles(classes.select("label", "rep", "mark", "weight", "embedding"), threshold, recall), "vector-links")
    counts = tiles.groupBy("rep", "mark").agg(F.sum("found").alias("found"))
    ends = [F.struct(F.col(f"{x}rep").alias("rep"), F.col(f"{x}mark").alias("mark")).alias(name) for x, name in (("", "src"), ("root_", "dst"))]
    moved = connected_components(tiles.select(*ends)).where("node <> component").select("node.rep", "node.mark", F.col("component.rep").alias("component"))
    final = classes.select("label", "e1", "e2", "rep", "mark", "weight").join(counts, ["rep", "mark"], "left").join(moved, ["rep", "mark"], "left")
    final = final.select("label", "e1", "e2", (F.col("weight") - 1 + F.coalesce("found", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    good = usable.select("vec_id", "label", "e1", "e2").join(final, ["label", "e1", "e2"]).select("vec_id", "n_links", "component_id")
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("embedding")) & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    alone = rows.where(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and group of every vector of embeddings; cases as in ``near_vectors``."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) AS (
  SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT v.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(l.b, v.vec_id)) AS component_id,
       v.vec_id <= coalesce(l.b, v.vec_id) AS kept
FROM v LEFT JOIN counts c ON c.a = v.vec_id LEFT JOIN least l ON l.a = v.vec_id
"""
