"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Commits of a manifest that stay readable; older ones are deleted.
KEPT = 32


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; in local mode a temporary one if it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="brightloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Paths handed out while a scope is open, innermost last, and the folders that are swept when Python ends.
_OPEN: list[list[str]] = []
_SWEPT: set[str] = set()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the application's folder, which is deleted with all tables in it when the application ends.

    What is to outlive the application is given a path by its caller.
    """
    folder = f"{shared_folder(spark)}/run-{spark.sparkContext.applicationId}"
    if folder not in _SWEPT:
        _SWEPT.add(folder)
        atexit.register(_sweep, spark, folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    for made in _OPEN[-1:]:
        made.append(path)
    return path


def _sweep(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the session's JVM may be gone, and the folder with it
        removed(spark, folder)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> tuple[DataFrame, str]:
    """The rows that ``make`` gives as a stored table, and its path; all tables that were stored on the way are deleted."""
    made: list[str] = []
    _OPEN.append(made)
    try:
        rows = make()
        path = fresh_path(spark, name)
        rows.write.parquet(path)
    finally:
        _OPEN.remove(made)
    for other in made:
        if other != path:
            removed(spark, other)
    for outer in _OPEN[-1:]:
        outer.append(path)
    return spark.read.schema(rows.schema).parquet(path), path


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Writes the rows and reads them back: what is costly is computed once, and a lost executor costs no more."""
    path = fresh_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def dealt(rows: DataFrame) -> DataFrame:
    """rows over at least as many partitions as there are cores; tables of more partitions stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def parts_of(rows: DataFrame, each: int) -> int:
    """Number of partitions of about ``each`` rows, one a core at least: so what one task holds does not grow with the table."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // each))


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder that no plan reads any more."""
    files, where = file_system(spark, path)
    files.delete(where, True)


class Conflict(RuntimeError):
    """Another writer has committed since the state was read."""


class Manifest:
    """The committed state of a folder of tables, as numbered JSON files of which the last one counts.

    A number is taken by creating its file, which must not exist: of two writers that start from the same state one
    gets a Conflict and has to read again. The file system must create exclusively (HDFS and local ones do). A file
    cut short by a crash stops readers with an error that names it; it can be deleted, as nothing was committed.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, f"{root.rstrip('/')}/commits"

    def read(self) -> tuple[int, dict]:
        """(number, state) of the last commit; (0, {}) before the first."""
        files, where = file_system(self.spark, self.root)
        names = sorted(x.getPath().getName() for x in files.listStatus(where)) if files.exists(where) else []
        names = [x for x in names if x.endswith(".json") and not x.startswith(".")]
        if not names:
            return 0, {}
        stream = files.open(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{names[-1]}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return int(names[-1].removesuffix(".json")), json.loads(text)
        except ValueError as e:
            raise RuntimeError(f"{self.root}/{names[-1]} is no whole commit") from e

    def write(self, number: int, state: dict) -> None:
        """Commits ``state`` as the successor of commit ``number``, which must be the last one."""
        from py4j.protocol import Py4JJavaError

        if self.read()[0] != number:
            raise Conflict(f"commit {number} of {self.root} is not the last one any more")
        files, where = file_system(self.spark, f"{self.root}/{number + 1:012d}.json")
        try:
            stream = files.create(where, False)
        except Py4JJavaError as e:
            if files.exists(where):
                raise Conflict(f"commit {number + 1} of {self.root} is taken") from e
            raise
        try:
            stream.write(bytearray(json.dumps(state).encode()))
        finally:
            stream.close()
        if number >= KEPT:
            files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{number + 1 - KEPT:012d}.json"), False)
