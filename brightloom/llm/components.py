"""Connected components of a graph of links, by alternating large-star and small-star rounds.

Each round is two group-bys and two joins of pairs of nodes; its result is written to the shared folder,
so plans stay short and lost executors cost one round. The number of rounds grows with the logarithm of the
longest path.

A hub, a node with more than one in HUBS of all rows, is not dealt by its key: there are at most HUBS of them, so
their minima are broadcast and their rows stay where they are. The group-bys combine before they shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.llm.common import fresh_path, removed

#: Bound on the number of hubs; a node is one if it has over a HUBS-th of the rows, and at least LEAST of them.
HUBS, LEAST = 2000, 4


def _with_least(rows: DataFrame, least: DataFrame, n_rows: int) -> DataFrame:
    """rows (u, v) with the m of u in ``least`` (u, m, n), n being the rows of u; every u of rows is in it."""
    limit = max(LEAST, n_rows // HUBS)
    hubs = least.where(F.col("n") > limit).select(F.col("u").alias("hub"), F.col("m").alias("hub_m"))
    marked = rows.join(F.broadcast(hubs), F.col("u") == F.col("hub"), "left")  # at most HUBS rows
    few = marked.where("hub IS NULL").select("u", "v").join(least.where(F.col("n") <= limit).select("u", "m"), "u")
    return marked.where("hub IS NOT NULL").select("u", "v", F.col("hub_m").alias("m")).unionByName(few.select("u", "v", "m"))


def _large_star(edges: DataFrame, n_edges: int) -> DataFrame:
    """For every node u with neighbourhood minimum m: (v, m) for each neighbour v > u."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _with_least(both, least, 2 * n_edges).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, n_edges: int) -> DataFrame:
    """For every node u with smaller neighbours of minimum m: (v, m) for each of them, and (u, m)."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _with_least(down, least, n_edges).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Returns (node, component): for every node of an edge, the smallest node that its links reach.

    Nodes are of any type with an order. Loops, repeated edges and edges with a null end are ignored; without edges the
    result is empty.
    """
    spark, n, last = edges.sparkSession, 0, None
    path = fresh_path(spark, "components")
    first = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v").distinct()
    first.write.parquet(path)
    for _ in range(max_rounds + 1):
        now = spark.read.schema(first.schema).parquet(path)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last or state[0] == 0:
            break
        last, n = state, state[0]
        where = fresh_path(spark, "components")
        _small_star(_large_star(now, n), n).write.parquet(where)
        removed(spark, path)
        path = where
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
