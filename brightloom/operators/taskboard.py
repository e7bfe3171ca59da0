"""Tasks that several workers claim at once: optimistic commits on a table, each a compare and set.

A commit is a folder with the rows that it changes and a numbered entry of the manifest, which only one writer can take.
A worker reads the last commit, decides on its rows and tries to take the next number; if another one was faster, its
decision is void, and it reads and decides again. So a task is won once, whatever the workers do. A task's row is that of
its last commit; after ``compact_after`` commits all rows are written anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.operators import limits
from brightloom.storage import Conflict, Manifest, fresh_path, removed

#: Tries of a change before it is given up, and commits between two compactions.
TRIES, COMPACT_AFTER = 50, 16
TASK = "task_id long, kind string, status string, attempts int, updated_at timestamp, owner string, last_error string"


class TaskBoard:
    """The tasks in a folder of the shared storage, for any number of workers and sessions."""

    def __init__(self, spark: SparkSession, path: str | None = None, compact_after: int = COMPACT_AFTER):
        self.spark, self.path, self.compact_after = spark, path or fresh_path(spark, "task-board"), compact_after
        self.manifest = Manifest(spark, self.path)

    def _rows(self, state: dict) -> DataFrame:
        """The current rows of a state: of each task that of its last commit."""
        if not state.get("folders"):
            return self.spark.createDataFrame([], TASK)
        rows = self.spark.read.schema(f"{TASK}, version long").parquet(*[f"{self.path}/{x}" for x in state["folders"]])
        last = rows.groupBy("task_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("task_id", "version")]), "version").alias("row"))
        return last.select("task_id", "row.*")

    def tasks(self) -> DataFrame:
        return self._rows(self.manifest.read()[1])

    def change(self, decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Commits the rows that ``decide`` gives for the current ones, and returns them; tried again after a conflict."""
        for _ in range(TRIES):
            number, state = self.manifest.read()
            folders, version = state.get("folders", []), number + 1
            name = fresh_path(self.spark, "x").rpartition("/")[2].replace("x-", "commit-")
            now = self._rows(state)
            decide(now).select(*now.columns).withColumn("version", F.lit(version).cast("long")).write.parquet(f"{self.path}/{name}")
            kept = [*folders, name]
            if len(kept) > self.compact_after:
                rows = self.spark.read.schema(f"{TASK}, version long").parquet(*[f"{self.path}/{x}" for x in kept])
                last = rows.groupBy("task_id").agg(F.max_by(F.struct(*rows.columns), "version").alias("row")).select("row.*")
                last.write.parquet(f"{self.path}/{name}-whole")
                kept = [f"{name}-whole"]
            try:
                self.manifest.write(number, {"folders": kept})
            except Conflict:
                for gone in {name, *kept} - set(folders):
                    removed(self.spark, f"{self.path}/{gone}")
                continue
            return self.spark.read.schema(TASK).parquet(f"{self.path}/{name}")
        raise Conflict(f"{TRIES} tries at {self.path} were overtaken")

    def put(self, tasks: DataFrame) -> DataFrame:
        """Adds tasks (task_id, kind), which wait; those that the board has stay as they are."""
        fresh = tasks.select(
            F.col("task_id").cast("long").alias("task_id"), F.col("kind"), F.lit("PENDING").alias("status"), F.lit(0).alias("attempts"),
            F.lit(None).cast("timestamp").alias("updated_at"), F.lit(None).cast("string").alias("owner"), F.lit(None).cast("string").alias("last_error"),
        )
        return self.change(lambda now: fresh.where("task_id IS NOT NULL").dropDuplicates(["task_id"]).join(now.select("task_id"), "task_id", "left_anti"))

    def claim(self, worker: str, n: int, now: Column, kind: str | None = None) -> DataFrame:
        """The up to ``n`` waiting tasks of the smallest ids, which run for this worker from now on, and for no other."""

        def decide(rows: DataFrame) -> DataFrame:
            waits = rows.where((F.col("status") == "PENDING") & (F.lit(kind is None) | (F.col("kind") == F.lit(kind))))
            return limits.claimed(rows, waits.orderBy("task_id").limit(n).select("task_id"), now).where("won").withColumn("owner", F.lit(worker))

        return self.change(decide)

    def finish(self, worker: str, results: DataFrame, now: Column) -> DataFrame:
        """Ends this worker's running tasks by ``results`` (task_id, result, error); late ones change nothing."""

        def decide(rows: DataFrame) -> DataFrame:
            done = limits.finished(rows.where(F.col("owner") == worker), results, now)
            return done.join(results.select("task_id").distinct(), "task_id", "left_semi").where("NOT late")

        return self.change(decide)

    def drop(self) -> None:
        removed(self.spark, self.path)
