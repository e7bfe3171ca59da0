"""An index of fingerprints that is kept between rounds of ingest: bucketed runs, merged in levels.

A run holds a row for each key, such as (direction, fingerprint), with the smallest id that it has been seen with. A
round adds the keys that no run holds, or holds with greater ids only; it meets the runs by merge joins on their buckets,
so that no text of an earlier round is read or hashed again and no run is shuffled. When a level holds ``fanout`` runs
they become one run of the next level: a key is rewritten once a level, and a round meets as many runs as there are levels,
times the fanout. What counts is the list of runs of the last commit; a round that is committed twice changes nothing, and
of two writers one gets a Conflict and can add its round again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.storage import Manifest, fresh_path, removed, stored

FANOUT = 4
KEY, ID = ("direction", "fingerprint"), "item_id"


class FingerprintIndex:
    """The index in a folder of the shared storage; a second object on the folder, in any session, sees the same runs."""

    def __init__(self, spark: SparkSession, path: str | None = None, key: tuple[str, ...] = KEY, item_id: str = ID, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.path, self.key, self.item_id = spark, path or fresh_path(spark, "fingerprint-index"), list(key), item_id
        self.manifest, self.known = Manifest(spark, self.path), set()
        number, state = self.manifest.read()
        self.fanout, self.buckets = state.get("fanout", fanout), state.get("buckets") or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _state(self) -> tuple[int, dict]:
        number, state = self.manifest.read()
        return number, state or {"fanout": self.fanout, "buckets": self.buckets, "rounds": [], "levels": [], "schema": ""}

    def rounds(self) -> list[str]:
        return self._state()[1]["rounds"]

    def runs(self) -> list[str]:
        """Names of the runs, the largest first."""
        return [name for level in reversed(self._state()[1]["levels"]) for name in level]

    def _write(self, rows: DataFrame) -> str:
        name = f"fingerprint_run_{uuid.uuid4().hex}"
        rows.select(*self.key, "first_id").repartition(self.buckets, *self.key).write.format("parquet").bucketBy(self.buckets, *self.key).sortBy(*self.key).option("path", f"{self.path}/{name}").saveAsTable(name)
        self.known.add(name)
        return name

    def _run(self, name: str, schema: str) -> DataFrame:
        """A run as a bucketed table, which this session's catalog may not know yet."""
        if name not in self.known:
            keys = ", ".join(self.key)
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
            self.known.add(name)
        return self.spark.table(name)

    def _forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.known.discard(name)
            removed(self.spark, f"{self.path}/{name}")

    def _matches(self, a: DataFrame, b: DataFrame):
        return [F.col(f"a.{k}") == F.col(f"b.{k}") for k in self.key]

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """One run of several, with the least id of each key, by merge joins of their buckets."""
        out = runs[0]
        for run in runs[1:]:
            a, b = out.alias("a"), run.alias("b")
            out = a.join(b, self._matches(a, b), "full_outer").select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in self.key], F.least("a.first_id", "b.first_id").alias("first_id"))
        return out

    def add(self, round_id: str, rows: DataFrame) -> bool:
        """Commits the keys of a round's rows (key, id); False if the round is committed already.

        Rows with a null in the key or without an id have no part.
        """
        number, state = self._state()
        if round_id in state["rounds"]:
            return False
        have = [F.col(c).isNotNull() for c in (*self.key, self.item_id)]
        own = rows.where(have[0])
        for more in have[1:]:
            own = own.where(more)
        own = own.groupBy(*self.key).agg(F.min(self.item_id).cast("long").alias("first_id"))
        for name in self.runs():
            a, b = own.alias("a"), self._run(name, state["schema"]).alias("b")
            own = a.join(b, [*self._matches(a, b), F.col("b.first_id") <= F.col("a.first_id")], "left_anti")
        schema = state["schema"] or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
        levels, gone, at = [list(x) for x in state["levels"]] or [[]], [], 0
        levels[0].append(self._write(own))
        while len(levels[at]) >= self.fanout:
            gone += levels[at]
            whole = self._write(self._merged([self._run(x, schema) for x in levels[at]]))
            levels[at], at = [], at + 1
            levels += [[]] if at == len(levels) else []
            levels[at].append(whole)
        self.manifest.write(number, state | {"rounds": [*state["rounds"], round_id], "levels": levels, "schema": schema})
        self._forget(gone)
        return True

    def firsts(self, keys: DataFrame) -> DataFrame:
        """(key, first_id) of the keys that the index holds, as a stored table."""
        state = self._state()[1]
        found = keys.select(*self.key).distinct().withColumn("first_id", F.lit(None).cast("long"))
        for name in self.runs():
            a, b = found.alias("a"), self._run(name, state["schema"]).alias("b")
            found = a.join(b, self._matches(a, b), "left").select(*[F.col(f"a.{k}").alias(k) for k in self.key], F.least("a.first_id", "b.first_id").alias("first_id"))
        return stored(found.where("first_id IS NOT NULL"), "first-ids")

    def duplicates(self, rows: DataFrame) -> DataFrame:
        """(id, duplicate_of) of the rows whose key the index holds with a smaller id.

        Distinct keys meet the index; the rows meet what was found, as two plain tables, so that a hot key is split.
        """
        rows = stored(rows.select(self.item_id, *self.key), "index-rows")
        return rows.join(self.firsts(rows), self.key).where(F.col(self.item_id) > F.col("first_id")).select(self.item_id, F.col("first_id").alias("duplicate_of"))

    def drop(self) -> None:
        """Deletes the index."""
        self._forget(self.runs())
        removed(self.spark, self.path)
