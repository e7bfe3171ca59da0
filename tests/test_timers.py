"""The health machine with alarms: literal cases, and the stream with restarts and late rounds against the batch."""

import random

import pytest
from pyspark.sql import functions as F

from brightloom.operators import health

DAY = 86400.0
SCHEMA = f"source_id long, round_id long, kind string, now double, {health.ROUND}"


def a_round(source, n, now, error=None, status=None, limited=False, wait=None, entries=1, inserted=1, kind="rss"):
    return (source, n, kind, now, error, status, entries, inserted, False, limited, wait, False, False)


def told(rows):
    return [(r.at / DAY, r.round_id, r.notice) for r in sorted(rows, key=lambda r: (r.at, r.notice is None, r.notice or "", r.round_id or 0))]


def test_alarms(spark):
    gone = [a_round(2, n, n * DAY, "http 404", 404, entries=0) for n in range(1, 4)]
    rows = [a_round(1, 1, DAY, limited=True, wait=DAY / 2), a_round(1, 2, 2 * DAY), a_round(1, 3, 40 * DAY), *gone, a_round(3, 1, None), a_round(None, 1, DAY)]
    got = health.health_timeline(spark.createDataFrame(rows, SCHEMA), 50 * DAY).collect()
    assert told(r for r in got if r.source_id == 1) == [(1.0, 1, None), (1.5, None, "rate_limit_over"), (2.0, 2, None), (32.0, None, "dropped"), (40.0, 3, None)]
    dead = next(r.round_id for r in got if r.source_id == 2 and r.event == "hard_failed" and r.notice is None)
    assert told(r for r in got if r.source_id == 2) == [(1.0, 1, None), (2.0, 2, None), (3.0, 3, None), (dead + 7.0, None, "probe_due"), (33.0, None, "dropped")]
    assert told(r for r in got if r.source_id is None) == [(1.0, 1, None), (31.0, None, "dropped")] and not [r for r in got if r.source_id == 3]
    anew = next(r for r in got if r.source_id == 1 and r.round_id == 3)
    assert (anew.rate_limited_until, anew.rate_level) == (None, 0)
    assert health.health_timeline(spark.createDataFrame([], SCHEMA), DAY).count() == 0
    early = health.health_timeline(spark.createDataFrame(rows, SCHEMA), 1.6 * DAY).where("source_id = 1").collect()
    assert told(early) == [(1.0, 1, None), (1.5, None, "rate_limit_over")]


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def test_stream_as_batch(spark, tmp_path, rocksdb):
    from brightloom.streaming.rounds import health_timeline_stream

    rng = random.Random(7)
    rows, n = [], 0
    for source in range(1, 7):
        now = DAY
        for _ in range(25):
            now += rng.choice([900.0, 5400.0, DAY, 6 * DAY, 33 * DAY * (source % 2)]) + rng.randint(1, 999) / 8
            n += 1
            error, search = rng.choice([None, "http 404", "http 404", "non_xml_response"]), source == 6
            error, limited, gained = (None, False, 0) if search else (error, rng.random() < 0.3, rng.randint(0, 1))
            rows.append(a_round(source, n, now, error, 404 if error == "http 404" else None, limited, rng.choice([None, 300.0, 7000.0]), rng.randint(0, 2), gained, "search" if search else "rss"))
    rows.append(a_round(1, 2**60 + 1, 1.5 * DAY + 0.5))
    # rounds come up to an hour late, which puts some of them into a later file
    rows.sort(key=lambda r: r[3] + rng.random() * 3599)
    end = max(r[3] for r in rows) + 100 * DAY
    parts = [rows[:50], rows[50:110], rows[110:] + [a_round(2, 7777, 1.25 * DAY)], [a_round(999, 1, end)], [a_round(999, 2, end + 1)]]

    def run(part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = health_timeline_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert query.awaitTermination(200) and query.exception() is None

    for part in parts:
        run(part)
    keep = F.col("source_id") != 999
    cols = [F.col(c) for c in spark.read.parquet(str(tmp_path / "out")).columns]
    got = sorted(map(repr, spark.read.parquet(str(tmp_path / "out")).where(keep).select(*cols).collect()))
    want = sorted(map(repr, health.health_timeline(spark.createDataFrame(rows, SCHEMA), end - 3600).where(keep).select(*cols).collect()))
    assert (sorted(set(got) - set(want)), sorted(set(want) - set(got))) == ([], []) and len(got) == len(want)
    assert len({r.notice for r in health.health_timeline(spark.createDataFrame(rows, SCHEMA), end).collect()}) == 5
