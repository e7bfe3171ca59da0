"""Mixing sources to target weights by Poisson replication, with DataFrame operations only.

Every document is repeated k times, k from a Poisson distribution whose mean is its source's target repetition
rate: (target share of the source) x (rows wanted) / (rows of the source). k is the inverse of the distribution at a
uniform number hashed from (seed, doc_id), so no state is kept, any part can be computed again with the same result,
and the hot source needs no gathering. The copies are then dealt out and sorted by a hash: a random permutation
without a sampling pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.llm.common import dealt, packed, unpacked

#: Shares of the sources are their row counts to this power: 1 keeps the corpus as it is, 0 gives equal shares.
ALPHA = 0.5
EPOCHS = 1.0
SEED = "mix-1"
#: Means above it are split into a sum of equal independent Poisson variables, which keeps exp(-mean) a normal number.
MAX_MEAN = 16.0
#: The table of rates goes to all executors if it has at most so many sources (about 100 bytes and 60 doubles each).
BROADCAST_SOURCES = 20_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits, from the MD5 of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson_cdf(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... up to a tail below double precision for means of at most MAX_MEAN."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("all"))
    step = lambda acc, k: F.struct(
        (acc["p"] * mean / k).alias("p"), (acc["c"] + acc["p"] * mean / k).alias("c"),
        F.concat(acc["all"], F.array(acc["c"] + acc["p"] * mean / k)).alias("all"),
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(72)), start, step, lambda acc: acc["all"])


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, epochs: float = EPOCHS) -> DataFrame:
    """(source, n_docs, rate): mean copies of a document of each source; null is a source of its own.

    ``weights`` are target shares by source (they are divided by their sum; sources left out get none); without them
    shares are proportional to n_docs ** alpha. The expected number of rows is epochs x the number of documents.
    """
    counts = docs.groupBy("source").agg(F.count("*").alias("n_docs"))
    if weights is None:
        raw = F.pow(F.col("n_docs").cast("double"), F.lit(alpha))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        raw = F.coalesce(F.create_map(*pairs)[F.col("source")], F.lit(0.0)) if pairs else F.lit(0.0)
    counts = counts.withColumn("raw", raw)
    totals = counts.agg(F.sum("n_docs").alias("all_docs"), F.sum("raw").alias("all_raw"))
    rate = F.when(F.col("all_raw") > 0, F.col("raw") / F.col("all_raw") * F.col("all_docs") * F.lit(float(epochs)) / F.col("n_docs")).otherwise(F.lit(0.0))
    return counts.join(F.broadcast(totals)).select("source", "n_docs", rate.alias("rate"))


def replicated(docs: DataFrame, rates: DataFrame, seed: str = SEED) -> DataFrame:
    """(row, mix_copy, mix_key): each document, as the struct ``row``, once per copy."""
    parts = F.greatest(F.ceil(F.col("rate") / F.lit(MAX_MEAN)), F.lit(1)).cast("int")
    table = rates.select(F.col("source").alias("of"), parts.alias("parts"), poisson_cdf(F.col("rate") / parts).alias("cdf"))
    if table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    doc = F.col("doc")
    draw = lambda total, j: total + F.size(F.filter("cdf", lambda c: c <= uniform(F.lit(seed), j.cast("string"), doc)))
    one = F.size(F.filter(F.col("cdf"), lambda c: c <= F.col("u")))
    many = F.aggregate(F.sequence(F.lit(1), F.col("parts") - 1), F.lit(0), draw)
    rows = packed(docs, F.col("source").alias("source"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("doc"))
    joined = rows.join(table, F.col("source").eqNullSafe(F.col("of")))
    counted = joined.withColumn("u", uniform(F.lit(seed), F.lit("0"), doc)).withColumn("n", one + F.when(F.col("parts") > 1, many).otherwise(0))
    copies = counted.where("n > 0").select("row", "doc", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("mix_copy"))
    return copies.select("row", "mix_copy", F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), doc, F.col("mix_copy").cast("string"))).alias("mix_key"))


def shuffled(copies: DataFrame) -> DataFrame:
    """A random permutation: dealt out by the hashed key, then sorted by it in every partition."""
    return copies.repartition("mix_key").sortWithinPartitions("mix_key")


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """The documents, repeated to the target weights and shuffled, with mix_copy (from 1) and mix_key.

    Defined cases: null sources form one source; a null doc_id draws as the text "null"; rows that repeat a doc_id
    draw the same number of copies each; texts are never read; extra columns are carried along, columns named
    mix_copy or mix_key are replaced; an empty table, and weights that sum to nothing, give an empty table.
    """
    copies = shuffled(replicated(docs, source_rates(docs, weights, alpha, epochs), seed))
    return unpacked(copies, docs, mix_copy=F.col("mix_copy"), mix_key=F.col("mix_key"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents repeated to the default weights of their sources; cases as in ``mixed``."""
    docs = dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text"))
    out = mixed(docs)
    return out.select("doc_id", "source", "mix_copy", "mix_key", "lang", "n_chars", "text")


OP2_SQL = """
WITH RECURSIVE counts AS (
  SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.5::DOUBLE) AS raw FROM documents GROUP BY source
), rates AS (
  SELECT source, raw / sum(raw) OVER () * sum(n) OVER () * 1.0::DOUBLE / n AS rate FROM counts
), cdf(source, rate, k, p, c) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < 72
), tables AS (SELECT source, list(c) AS cs FROM cdf GROUP BY source),
drawn AS (
  SELECT d.*, len(list_filter(t.cs, lambda c: c <= ('0x' || substr(md5('mix-1:0:' || d.doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)) AS k
  FROM documents d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source
), copies AS (SELECT doc_id, source, lang, n_chars, text, unnest(range(1, k + 1))::INT AS mix_copy FROM drawn)
SELECT doc_id, source, mix_copy, md5('mix-1:order:' || doc_id || ':' || mix_copy) AS mix_key, lang, n_chars, text FROM copies
"""
