"""Line dedup over a growing corpus: levelled sorted runs of line hashes.

A run holds, sorted by hash, a row for each distinct line of one or more batches: its two 64-bit hashes, the
number of documents that hold it and the largest id among them. A new batch is aggregated to such rows and merge-
anti-joined with the runs: lines never seen before are new in the batch's run, the others are additions to lines of
older runs. When a level holds ``fanout`` runs they are merged into one run of the next level. Totals are the new
lines of all runs, each of which is in one run only, with the additions summed up. Runs are bucketed and sorted
tables: merging or joining them shuffles no run again.

All work here is DataFrame operations.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.llm.common import Manifest, ascii_lower, ascii_strip, dealt, fresh_path, packed, removed, stored, unpacked

MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 40, 5, 4, 2
RUN = "h1 BIGINT, h2 BIGINT, n_docs BIGINT, max_doc BIGINT, is_new BOOLEAN"


def text_lines(text: Column) -> Column:
    """The lines of a text between \\n; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hash(line: Column) -> Column:
    """128 bits of a line's key: stripped of ASCII white space and with A-Z lower-cased by the caller."""
    key = ascii_strip(line)
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(77), key).alias("h2"))


def document_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, mark, h1, h2, at, is_first): each line of each document whose key has at least ``min_chars`` code points,
    by its place in the text. ``mark`` tells texts of one doc_id apart; of equal keys of a text one is the first.

    A text's lines are sorted by hash, so that equal keys are neighbours: a long text costs n log n.
    """
    lowered = F.split(F.coalesce(ascii_lower(F.col("text")), F.lit("")), "\n", -1)
    placed = F.transform(lowered, lambda x, i: F.struct(F.when(F.length(ascii_strip(x)) >= min_chars, line_hash(x)).alias("h"), i.alias("at")))
    rows = docs.select("doc_id", text_mark(F.col("text")), F.sort_array(F.filter(placed, lambda x: x["h"].isNotNull())).alias("lines"))
    marked = F.transform("lines", lambda x, i: F.struct(x["h"].alias("h"), x["at"].alias("at"), (~x["h"].eqNullSafe(F.get("lines", i - 1)["h"])).alias("is_first")))
    return rows.select("doc_id", "mark", F.explode(marked).alias("x")).select("doc_id", "mark", "x.h.h1", "x.h.h2", "x.at", "x.is_first")


def text_mark(text: Column) -> Column:
    return F.xxhash64(text).alias("mark")


class LineRuns:
    """The runs of one corpus, in a folder of the shared storage; a second object on the folder sees the same runs.

    A row of a run is a line hash with the documents that its batches add to it. Those of a hash that no older run holds
    have ``is_new``: so each line of the corpus is new in exactly one run, and all other rows are additions to it.
    Committing a batch id twice changes nothing. Two writers at once: one gets a ``Conflict`` and can commit again.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.root = spark, path or fresh_path(spark, "line-runs")
        self.manifest, self.made = Manifest(spark, self.root), set()
        number, state = self.manifest.read()
        self.fanout = state.get("fanout", fanout)
        self.buckets = state.get("buckets") or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _state(self) -> tuple[int, dict]:
        number, state = self.manifest.read()
        return number, state or {"fanout": self.fanout, "buckets": self.buckets, "done": [], "levels": []}

    def _write(self, rows: DataFrame) -> str:
        """A run: one file a bucket, with the additions first, then the new lines, both sorted by hash."""
        name = f"line_run_{uuid.uuid4().hex}"
        (
            rows.select("h1", "h2", "n_docs", "max_doc", "is_new").repartition(self.buckets, "h1", "h2")
            .write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("is_new", "h1", "h2")
            .option("path", f"{self.root}/{name}").saveAsTable(name)
        )
        self.made.add(name)
        return name

    def _run(self, name: str) -> DataFrame:
        """A run as a bucketed table, which this session's catalog may not know yet."""
        if name not in self.made:
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {name} ({RUN}) USING parquet CLUSTERED BY (h1, h2) SORTED BY (is_new, h1, h2) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{name}'"
            )
            self.made.add(name)
        return self.spark.table(name)

    def _forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.made.discard(name)
            removed(self.spark, f"{self.root}/{name}")

    def runs(self) -> list[str]:
        """Names of the runs, the oldest batches first."""
        return [name for level in reversed(self._state()[1]["levels"]) for name in level]

    def committed(self) -> list[str]:
        return self._state()[1]["done"]

    def unseen(self, lines: DataFrame) -> DataFrame:
        """The rows whose (h1, h2) no run holds as a line, by merge joins with the runs."""
        for name in self.runs():
            lines = lines.join(self._run(name).where("is_new").select("h1", "h2"), ["h1", "h2"], "left_anti")
        return lines

    def add(self, batch_id: str, lines: DataFrame) -> bool:
        """Commits the (doc_id, h1, h2) rows of a batch: its unseen lines are new in its run, the others additions."""
        number, state = self._state()
        if batch_id in state["done"]:
            return False
        own = lines.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc"))
        if self.runs():
            path = fresh_path(self.spark, "batch-lines")
            own.write.parquet(path)
            own = self.spark.read.schema("h1 long, h2 long, n_docs long, max_doc long").parquet(path)
            fresh = self.unseen(own.select("h1", "h2")).withColumn("is_new", F.lit(True))
            name = self._write(own.join(fresh, ["h1", "h2"], "left").withColumn("is_new", F.coalesce("is_new", F.lit(False))))
            removed(self.spark, path)
        else:
            name = self._write(own.withColumn("is_new", F.lit(True)))
        levels, merged, at = [list(x) for x in state["levels"]] or [[]], [], 0
        levels[0].append(name)
        while len(levels[at]) >= self.fanout:
            merged += levels[at]
            whole = self._write(merge_runs([self._run(x) for x in levels[at]]))
            levels[at], at = [], at + 1
            levels += [[]] if at == len(levels) else []
            levels[at].append(whole)
        self.manifest.write(number, state | {"done": [*state["done"], batch_id], "levels": levels})
        self._forget(merged)
        return True

    def totals(self) -> DataFrame:
        """(h1, h2, n_docs, max_doc) over all batches: every run's new lines with all the additions to them."""
        names, keys = self.runs(), ["h1", "h2"]
        if not names:
            return self.spark.createDataFrame([], "h1 long, h2 long, n_docs long, max_doc long")
        # read by path: Spark 4.1 takes a union of bucketed tables for dealt by hash although it reads them unbucketed
        rows = self.spark.read.schema(RUN).parquet(*[f"{self.root}/{name}" for name in names])
        more = rows.where("NOT is_new").groupBy(*keys).agg(F.sum("n_docs").alias("more"), F.max("max_doc").alias("max_more"))
        out = None
        for name in names:
            joined = self._run(name).where("is_new").join(more, keys, "left")
            part = joined.select(*keys, (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("max_doc", "max_more").alias("max_doc"))
            out = part if out is None else out.unionByName(part)
        return out

    def drop(self) -> None:
        """Deletes the runs and their folder."""
        self._forget(self.runs())
        removed(self.spark, self.root)


def merge_runs(runs: list[DataFrame]) -> DataFrame:
    """Merge-joins runs, each of which holds a hash once, adding up the rows of equal hash; a line new in one of them
    is new in the merged run.

    A full outer join and no group-by of a union: Spark 4.1 takes a union of bucketed tables for partitioned by hash
    although it reads them unbucketed, and then leaves equal hashes apart.
    """
    merged = runs[0]
    for run in runs[1:]:
        a, b = merged.alias("a"), run.alias("b")
        merged = a.join(b, (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2")), "full_outer").select(
            F.coalesce("a.h1", "b.h1").alias("h1"), F.coalesce("a.h2", "b.h2").alias("h2"),
            (F.coalesce("a.n_docs", F.lit(0)) + F.coalesce("b.n_docs", F.lit(0))).alias("n_docs"), F.greatest("a.max_doc", "b.max_doc").alias("max_doc"),
            (F.coalesce("a.is_new", F.lit(False)) | F.coalesce("b.is_new", F.lit(False))).alias("is_new"),
        )
    return merged


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """(doc_id, mark, drops): for each text that loses lines, the places of those lines in ascending order.

    A key of at least ``min_chars`` code points held by at least ``min_docs`` documents stays only in the largest
    doc_id that holds it. The lines of all documents go through ``LineRuns`` in ``batches`` batches.
    """
    spark = docs.sparkSession
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).alias("batch")
    path = fresh_path(spark, "document-lines")
    document_lines(docs, min_chars).select("*", batch).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("doc_id long, mark long, h1 long, h2 long, at int, is_first boolean, batch int").parquet(path)
    runs = LineRuns(spark)
    for n in range(batches):
        runs.add(f"batch-{n}", lines.where((F.col("batch") == n) & F.col("is_first")).select("doc_id", "h1", "h2"))
    common = stored(runs.totals().where(F.col("n_docs") >= min_docs).select("h1", "h2", "max_doc"), "common-lines")
    runs.drop()
    lost = lines.join(common, ["h1", "h2"]).where("doc_id < max_doc")
    drops = stored(lost.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("at")).alias("drops")), "dropped-lines")
    removed(spark, path)
    return drops


def without_lines(lines: Column, drops: Column) -> Column:
    """``lines`` without those at the ascending places ``drops``: the stretches between them, one behind the other."""
    start = lambda j: F.coalesce(F.get(drops, j - 1) + 1, F.lit(0))
    stretch = lambda j: F.slice(lines, start(j) + 1, F.coalesce(F.get(drops, j), F.size(lines)) - start(j))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(drops)), stretch))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """The documents, with all their columns, without their repeated lines; text_n_lines and text_n_dropped are added.

    Defined cases: a null or empty text is one empty line and stays as it is. Rows that repeat a doc_id count as
    separate documents and lose the same lines. A row without doc_id counts towards the number of documents and
    keeps all its lines. Extra columns are carried along, whatever their names; columns named text_n_lines or
    text_n_dropped are replaced. An empty table gives an empty table.
    """
    own = F.col("doc_id").cast("long").alias("doc_id")
    drops = dropped_lines(docs.select(own, F.col("text").cast("string").alias("text")), min_chars, min_docs, batches)
    text = F.col("row").getField("text").cast("string")  # not a column beside the row: the join would shuffle it twice
    lines, loses = text_lines(text), F.col("drops").isNotNull()
    # the same join at every size: a broadcast of few drops would spare the shuffle in small tables only
    found = packed(docs, own, text_mark(F.col("text").cast("string"))).join(drops.hint("merge"), ["doc_id", "mark"], "left")
    found = found.withColumn("lines", F.when(loses, lines)).withColumn("kept", F.when(loses, without_lines(F.col("lines"), F.col("drops"))))
    n_lines = F.size(lines).cast("long")
    return unpacked(
        found, docs, text=F.when(loses, F.array_join("kept", "\n")).otherwise(text),
        text_n_lines=n_lines, text_n_dropped=F.when(loses, F.size("drops")).otherwise(F.lit(0)).cast("long"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, lost lines and the digest of what stays of every text; cases as in ``dedup_lines``."""
    docs = dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    out = dedup_lines(docs)
    return out.select("doc_id", F.col("text_n_lines").alias("n_lines"), F.col("text_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT y.doc_id, y.pos, y.line, (c.k IS NOT NULL AND y.doc_id <> c.keeper) AS gone
  FROM keyed y LEFT JOIN common c ON y.k = c.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
