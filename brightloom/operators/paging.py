"""Deep pages of a list by a zone index: a page reads the files that hold it, and no others.

The table is written in the order of its id, newest first, in files of ranges; the index has the number of rows and the
range of each file. A page of any depth finds its files by the sums of rows before them, one row a file. Rows of one
key are ordered by their other columns, so that pages neither share rows nor lose any, however the rows were dealt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brightloom.storage import fresh_path


class PagedTable:
    """A table in a folder of the shared storage, ordered by ``key`` from the largest to the smallest, then by the other
    columns likewise (those that can be ordered)."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path, key
        self.rows = spark.read.parquet(f"{path}/rows")

    @classmethod
    def build(cls, rows: DataFrame, key: str, path: str | None = None, files: int | None = None) -> PagedTable:
        """Writes the rows in about ``files`` files and their zones. Rows without a key are on no page."""
        spark = rows.sparkSession
        path = path or fresh_path(spark, "paged-table")
        some = rows.where(F.col(key).isNotNull())
        ranged = some.repartitionByRange(files, F.desc(key)) if files else some.repartitionByRange(F.desc(key))
        ranged.sortWithinPartitions(F.desc(key)).write.parquet(f"{path}/rows")
        table = spark.read.parquet(f"{path}/rows")
        zones = table.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
        before = F.sum("n").over(Window.orderBy(F.desc("high"), F.desc("low"), "file")) - F.col("n")  # a row for each file
        zones.withColumn("before", before).coalesce(1).write.parquet(f"{path}/zones")
        return cls(spark, path, key)

    def zones(self) -> DataFrame:
        """(file, n, low, high, before) of every file; ``before`` counts the rows of larger keys."""
        return self.spark.read.parquet(f"{self.path}/zones")

    def total(self) -> int:
        return self.zones().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def files_of(self, offset: int, limit: int) -> list[tuple[str, int]]:
        """(file, rows before it) of those that hold a part of a page."""
        hit = self.zones().where((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset))
        return [(r.file, r.before) for r in hit.orderBy("before").select("file", "before").collect()]

    def page(self, offset: int, limit: int) -> DataFrame:
        """The rows from ``offset`` on, up to ``limit``, in descending order of the key; past the end there are none."""
        files = self.files_of(offset, limit) if limit > 0 else []
        if not files:
            return self.rows.limit(0)
        part = self.spark.read.schema(self.rows.schema).parquet(*[name for name, _ in files])
        kinds = {f.name: f.dataType.simpleString() for f in self.rows.schema if f.name != self.key}
        ties = [F.desc(name) for name, kind in kinds.items() if "map<" not in kind and "variant" not in kind]
        return part.orderBy(F.desc(self.key), *ties).offset(offset - files[0][1]).limit(limit)
