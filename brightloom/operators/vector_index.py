"""A stored index for exact vector search: shards kept as matrix blocks, written once and searched by blocks of queries.

A shard is one row: its vectors of one length as a matrix of the source's floats, their ids, in ascending order, and their
norms, as bytes. Reading it costs no conversion of arrays, and a task holds one shard and one block of queries at a time.
Queries go as blocks too, one row each, so that a query is sent to a shard as a piece of a matrix and not as a row of its
own. A block's products with a shard are one matrix product; what comes near the k-th best is computed again in double
precision, component by component in order, so that results do not depend on how a product is summed up.

The index is a table in a folder: it can be opened by another session, and by any number of them at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.storage import fresh_path

#: Bytes of a shard's matrix at most, and queries of a block.
SHARD_BYTES, BLOCK = 8 << 20, 2048
SHARD = "shard long, dim int, n int, kind string, ids binary, norms binary, matrix binary"
#: Bytes of queries that go to all executors at once; more of them meet the shards by a shuffle.
SPREAD_BYTES = 64 << 20
#: Room for the rounding of products in single precision, of unit vectors.
SLACK = 1e-4
#: Products of a block and a part of a shard that are held at once, and components that are multiplied again at once.
TILE = 1 << 20


def norms_of(matrix: np.ndarray) -> np.ndarray:
    """Norms in double precision, summed up in the order of the components."""
    total = np.zeros(len(matrix))
    for j in range(matrix.shape[1]):
        column = matrix[:, j].astype(np.float64)
        total += column * column
    return np.sqrt(total)


def _rows(batch: pa.RecordBatch, kind: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids, matrix) of the usable vectors of a batch, for each length."""
    vectors, ids = batch.column("vec"), batch.column("id").to_numpy(zero_copy_only=False)
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == dim)
        matrix = flat[starts[at][:, None] + np.arange(dim)].astype(kind, copy=False)
        yield dim, ids[at], matrix


def _packed(kind: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, list] = {}
        numbers = count(TaskContext.get().partitionId() << 32)

        def row(dim: int) -> pa.RecordBatch:
            ids, matrix = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            order = np.argsort(ids, kind="stable")
            ids, matrix = ids[order], np.ascontiguousarray(matrix[order])
            return pa.RecordBatch.from_pylist([{"shard": next(numbers), "dim": dim, "n": len(ids), "kind": kind, "ids": ids.tobytes(), "norms": norms_of(matrix).tobytes(), "matrix": matrix.tobytes()}], schema=schema)

        schema = pa.schema([("shard", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()), ("norms", pa.binary()), ("matrix", pa.binary())])
        for batch in batches:
            for dim, ids, matrix in _rows(batch, kind):
                room = max(1, most // (dim * matrix.itemsize))
                for at in range(0, len(ids), room):
                    held.setdefault(dim, []).append((ids[at : at + room], matrix[at : at + room]))
                    if sum(len(x) for x, _ in held[dim]) >= room:
                        yield row(dim)
        for dim in list(held):
            yield row(dim)

    return run


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, norms, matrix) of a shard or a block of queries; the bytes are not copied."""
    return np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["norms"]), np.frombuffer(row["matrix"], dtype=row["kind"]).reshape(row["n"], row["dim"])


def best(shard: tuple, block: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, similarity) of the k best of a shard for each query of a block, ties to the smaller id.

    The shard is gone over in parts, so that what is held does not grow with it; the k best so far bound the next part.
    """
    ids, norms, matrix = shard
    queries, query_norms, wanted = block
    rows, at, sims = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    floor, wide = np.full(len(queries), -np.inf), max(1, TILE // max(len(queries), 1))
    for begin in range(0, len(ids), wide):
        part = slice(begin, begin + wide)
        new_rows, new_at = _near(norms[part], matrix[part], query_norms, wanted, k, floor)
        new_at += begin
        rows, at, sims = np.concatenate([rows, new_rows]), np.concatenate([at, new_at]), np.concatenate([sims, _exact(shard, block, new_rows, new_at)])
        order = np.lexsort((ids[at], -sims, rows))
        rows, at, sims = rows[order], at[order], sims[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        full = rank == k - 1
        floor[rows[full]] = sims[full] - SLACK
        rows, at, sims = rows[rank < k], at[rank < k], sims[rank < k]
    return queries[rows], ids[at], sims


def _near(norms: np.ndarray, matrix: np.ndarray, query_norms: np.ndarray, wanted: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query's place, vector's place) of what may be among the k best of a part of a shard and reaches the floor of its query."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        about = (wanted @ matrix.T).astype(np.float64) / query_norms[:, None] / norms[None, :]
    about = np.nan_to_num(about, copy=False, nan=0.0, posinf=0.0, neginf=0.0)
    n = about.shape[1]
    if k < n:
        floor = np.maximum(floor, np.partition(about, n - k, axis=1)[:, n - k] - SLACK)
    return np.nonzero(about >= floor[:, None])


def _exact(shard: tuple, block: tuple, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Similarities in double precision, component by component in order."""
    _, norms, matrix = shard
    _, query_norms, wanted = block
    sims, step = np.empty(len(rows)), max(1, TILE // matrix.shape[1])
    for begin in range(0, len(rows), step):
        part = slice(begin, begin + step)
        products = matrix[at[part]].astype(np.float64) * wanted[rows[part]].astype(np.float64)
        dots, over = np.add.accumulate(products, axis=1)[:, -1], norms[at[part]] * query_norms[rows[part]]
        sims[part] = np.divide(dots, over, out=np.zeros(len(dots)), where=over > 0)
    return sims


def _search(k: int):
    fields = [("query_id", pa.int64()), ("item_id", pa.int64()), ("sim", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cells = {c: batch.column(c)[row].as_buffer() if c.rpartition("_")[2] in ("ids", "norms", "matrix") else batch.column(c)[row].as_py() for c in batch.schema.names}
                shard, block = (unpacked({c.removeprefix(side): v for c, v in cells.items() if c.startswith(side)}) for side in ("s_", "q_"))
                found = best(shard, block, k)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(found, fields, strict=True)], names=[n for n, _ in fields])

    return run


class VectorIndex:
    """The index in a folder of the shared storage.

    Vectors that are null, empty or hold null or non-finite components are not in it, nor are rows without an id; a zero
    vector is, with the similarity 0 to all. A query of such a kind, or of a length that no vector has, finds nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.dim = spark, path, None

    @staticmethod
    def _side(rows: DataFrame, name: str, most: int, kind: str) -> DataFrame:
        ok = F.col(name).isNotNull() & F.coalesce((F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        vec = F.col("vec").cast("array<float>" if kind == "<f4" else "array<double>")
        return rows.where(ok).select(F.col(name).cast("long").alias("id"), vec.alias("vec")).mapInArrow(_packed(kind, most), SHARD)

    @classmethod
    def build(cls, vectors: DataFrame, path: str | None = None, shards: int | None = None, shard_bytes: int = SHARD_BYTES) -> VectorIndex:
        """Writes the index of vectors (item_id, vec) in about ``shards`` shards, one a core unless that is too large."""
        spark = vectors.sparkSession
        path = path or fresh_path(spark, "vector-index")
        kind = "<f4" if vectors.schema["vec"].dataType.simpleString() == "array<float>" else "<f8"
        parts = shards or spark.sparkContext.defaultParallelism
        dealt = vectors.repartition(parts, F.xxhash64("item_id", "vec"))  # a repeated id does not fill a shard
        # the floats of vectors do not compress, and a shard is read whole
        cls._side(dealt, "item_id", shard_bytes, kind).write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)
        return cls(spark, path)

    def shards(self) -> DataFrame:
        return self.spark.read.schema(SHARD).parquet(self.path)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, item_id, sim, rank): the k most similar vectors of each query (query_id, vec), ties by id.

        Every block of queries meets every shard of its length, and the k best of each are merged by query. Queries up to
        SPREAD_BYTES are sent to the shards, which stay where they are; more are paired with the shards' numbers first.
        """
        kind, width = ("<f4", 4) if queries.schema["vec"].dataType.simpleString() == "array<float>" else ("<f8", 8)
        if self.dim is None:
            self.dim = self.shards().agg(F.max("dim")).first()[0] or 0
        n, dim = queries.count(), self.dim  # counting reads no vectors
        queries = queries.where(F.size("vec") <= dim)  # longer ones find nothing
        few = n * dim * width <= SPREAD_BYTES
        rows = queries.repartition(-(-n // BLOCK) or 1) if few else queries
        blocks = self._side(rows, "query_id", BLOCK * max(dim, 1) * width, kind).drop("shard")
        blocks = blocks.select(*[F.col(c).alias(f"q_{c}") for c in blocks.columns])
        shards = self.shards().select(*[F.col(c).alias(f"s_{c}") for c in self.shards().columns])
        if few:
            pairs = shards.join(F.broadcast(blocks), F.col("s_dim") == F.col("q_dim"))
        else:
            at = shards.select(F.col("s_shard").alias("q_shard"), F.col("s_dim").alias("_dim"))
            blocks = blocks.join(F.broadcast(at), F.col("_dim") == F.col("q_dim")).drop("_dim")  # 16 bytes a shard of 64 MB
            pairs = shards.join(blocks, F.col("s_shard") == F.col("q_shard")).drop("q_shard")
        found = pairs.drop("s_shard").mapInArrow(_search(k), "query_id long, item_id long, sim double")
        hits = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("s"), "item_id", "sim"))).alias("hits"))
        return hits.select("query_id", F.posexplode(F.slice("hits", 1, k)).alias("at", "hit")).select("query_id", "hit.item_id", "hit.sim", (F.col("at") + 1).cast("int").alias("rank"))
