"""Splits large buckets of a blocking key into pairs of bounded chunks, so no task holds a whole bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.llm.common import stored


def tiled(rows: DataFrame, keys: list[str], spread: str, tile: int) -> DataFrame:
    """Adds (chunk, left_chunk, right_chunk) to rows of buckets with two or more rows; the others go.

    A bucket of at most ``tile`` rows is the one tile (0, 0). A larger one is dealt by a hash of ``spread`` into
    chunks of about ``tile`` rows, and every row is sent to each pair of chunks that holds its own: any two rows
    of a bucket meet in a tile, and a tile holds about twice ``tile`` rows at most. The counts are a table of their own,
    so that the join with them reads two plain shuffles and a bucket that holds a third of the rows is split over tasks.
    """
    sizes = stored(rows.groupBy(*keys).agg(F.count("*").alias("_size")).where("_size > 1"), "bucket-sizes")
    chunks = F.ceil(F.col("_size") / F.lit(tile)).cast("int")
    mine = F.pmod(F.xxhash64(F.col(spread), F.lit(11)), F.col("_chunks").cast("long")).cast("int")
    return (
        rows.join(sizes, keys)
        .withColumn("_chunks", chunks)
        .withColumn("chunk", mine)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
        .withColumn("left_chunk", F.least("chunk", "_other"))
        .withColumn("right_chunk", F.greatest("chunk", "_other"))
        .drop("_size", "_chunks", "_other")
    )
