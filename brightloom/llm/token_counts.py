"""Token counts kept up to date by deltas: totals by source, language and tokenizer version.

A batch is a table of changes: upserts (a new or revised text) and deletes. It is turned into signed rows against the
ledger of what each document counts now: an insert adds +n, a delete adds the document's -n, a revision adds both.
Signed rows are summed per (source, lang, tokenizer) and written as the batch's own folder of the rollup, beside its
ledger rows. Totals are sums over committed folders, so they are additive and hot sources are summed before any
shuffle. A batch is committed by one entry of a manifest, written last: a batch that was lost half way is written
again, and a batch that comes twice changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.llm import bpe
from brightloom.llm.common import Manifest, dealt, fresh_path, removed

LEDGER = "doc_id long, source string, lang string, tokenizer string, n_tokens long, n_docs long"
TOTALS = "source string, lang string, tokenizer string, n_tokens long, n_docs long"
KEYS = ["source", "lang", "tokenizer"]
#: Folders of a rollup that are summed up into one.
COMPACT_AFTER = 16


def word_counts(docs: DataFrame, version: str = "words-1") -> DataFrame:
    """Adds (tokenizer, n_tokens): runs of other than ASCII white space, counted by SQL functions."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer"), words.cast("long").alias("n_tokens"))


def bpe_counts(docs: DataFrame, version: str = "byte_bpe_50k", path: str | None = None) -> DataFrame:
    """Adds (tokenizer, n_tokens) by the byte-level BPE of this package; only counts leave the Python workers."""
    shared = bpe.share(docs.sparkSession, path)

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = bpe.codec_of(shared)
        for batch in texts:
            yield pd.Series([len(codec.encode(x)) // 4 for x in batch], dtype="int64")

    return docs.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer"), count(F.col("text")).alias("n_tokens"))


class TokenRollup:
    """The rollup in one folder of the shared storage; a second object on the same folder sees the same batches.

    Its manifest names the committed batches and the folders whose rows count. Two writers at once: the second to
    commit gets a ``Conflict``, nothing of it counts, and it can commit again. Every ``compact_after`` batches the
    folders are summed up into one.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, compact_after: int = COMPACT_AFTER):
        self.spark, self.path, self.compact_after = spark, path or fresh_path(spark, "token-rollup"), compact_after
        self.manifest = Manifest(spark, self.path)

    def _state(self) -> tuple[int, dict]:
        number, state = self.manifest.read()
        return number, state or {"batches": [], "folders": []}

    def committed(self) -> list[str]:
        """Ids of the committed batches."""
        return self._state()[1]["batches"]

    def _read(self, folders: list[str], kind: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{folder}/{kind}" for folder in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def current(self, of: DataFrame | None = None) -> DataFrame:
        """The ledger: what each document counts now, a row for each (doc_id, source, lang, tokenizer) of any weight.

        With ``of`` (doc_id) only of those documents: the others are left out before anything is summed up.
        """
        rows = self._read(self._state()[1]["folders"], "ledger", LEDGER)
        return _summed(rows if of is None else rows.join(of, "doc_id", "left_semi"), ["doc_id", *KEYS])

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) of the groups that hold documents now."""
        return _summed(self._read(self._state()[1]["folders"], "totals", TOTALS), KEYS).select(*KEYS, "n_docs", "n_tokens")

    def signed(self, upserts: DataFrame | None, deletes: DataFrame | None) -> DataFrame:
        """The signed rows of a batch. A revision replaces a document's count under the same tokenizer version."""
        parts, gone = [], []
        if upserts is not None:
            fresh = upserts.select(F.col("doc_id").cast("long").alias("doc_id"), *KEYS, "n_tokens")
            parts.append(fresh.groupBy("doc_id", *KEYS).agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs")))
        if self.committed():
            if upserts is not None:
                changed = upserts.select(F.col("doc_id").cast("long").alias("doc_id"), "tokenizer").distinct()
                gone.append(self.current(changed.select("doc_id").distinct()).join(changed, ["doc_id", "tokenizer"], "left_semi"))
            if deletes is not None:
                dropped = self.current(deletes.select(F.col("doc_id").cast("long").alias("doc_id")).distinct())
                gone.append(dropped.join(changed, ["doc_id", "tokenizer"], "left_anti") if gone else dropped)
        for old in gone:
            parts.append(old.select("doc_id", *KEYS, (-F.col("n_tokens")).alias("n_tokens"), (-F.col("n_docs")).alias("n_docs")))
        rows = parts[0] if parts else self.spark.createDataFrame([], LEDGER)
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return rows.select("doc_id", *KEYS, "n_tokens", "n_docs")

    def _put(self, signed: DataFrame) -> str:
        """Writes ledger rows and their sums as a folder, which counts once a commit names it."""
        folder = f"part-{uuid.uuid4().hex}"
        signed.write.parquet(f"{self.path}/{folder}/ledger")
        rows = self._read([folder], "ledger", LEDGER)
        rows.groupBy(*KEYS).agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_docs").alias("n_docs")).write.parquet(f"{self.path}/{folder}/totals")
        return folder

    def commit(self, batch_id: str, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> bool:
        """Applies a batch once. ``upserts`` has (doc_id, source, lang, tokenizer, n_tokens), ``deletes`` (doc_id).

        Returns False, and does nothing, if the batch is committed already. A document in both counts as revised.
        """
        number, state = self._state()
        if batch_id in state["batches"]:
            return False
        folder = self._put(self.signed(upserts, deletes))
        self.manifest.write(number, {"batches": [*state["batches"], batch_id], "folders": [*state["folders"], folder]})
        if len(state["folders"]) + 1 > self.compact_after:
            self.compact()
        return True

    def compact(self) -> None:
        """Sums the folders up into one; documents that no longer count leave the ledger."""
        number, state = self._state()
        whole = self._put(self.current())
        self.manifest.write(number, state | {"folders": [whole]})
        for folder in state["folders"]:
            removed(self.spark, f"{self.path}/{folder}")


def _summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    sums = rows.groupBy(*keys).agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_docs").alias("n_docs"))
    return sums.where("n_docs <> 0 OR n_tokens <> 0")


def _count_changes(spark: SparkSession, sf_dir: str, counter) -> DataFrame:
    """Loads all documents, revises those with numbers of four digits (all digits go) and takes the toxic ones down.

    The three batches are sent twice over. What is revised shows in the text itself, so no text is shuffled.
    """
    docs = dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    numbers = docs.where(F.col("text").rlike("[0-9]{4}")).withColumn("text", F.regexp_replace("text", "[0-9]", ""))
    rollup = TokenRollup(spark)
    for _ in range(2):
        rollup.commit("load", upserts=counter(docs))
        rollup.commit("revise", upserts=counter(numbers))
        rollup.commit("takedown", deletes=labels.where("toxic = 1").select("doc_id"))
    return rollup.totals()


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after all documents were loaded, those with numbers revised and the toxic ones deleted, each batch twice.

    Defined cases: a null text has no tokens but counts as a document; a null source or lang is a group of its own; a
    null doc_id is counted and cannot be deleted or revised; rows that repeat a doc_id in one batch add up, and go
    together; an id to delete that is unknown changes nothing; extra columns are not read; empty tables give no rows.
    """
    return _count_changes(spark, sf_dir, bpe_counts)


def token_counts_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the word tokenizer, which SQL can express."""
    return _count_changes(spark, sf_dir, word_counts)


WORDS_SQL = r"""
WITH revised AS (
  SELECT source, lang, CASE WHEN regexp_matches(text, '[0-9]{4}') THEN regexp_replace(text, '[0-9]', '', 'g') ELSE text END AS text
  FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
)
SELECT source, lang, 'words-1' AS tokenizer, count(*)::BIGINT AS n_docs,
       sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS n_tokens
FROM revised GROUP BY source, lang
"""
