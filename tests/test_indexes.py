"""The pruned similarity join, the stored vector index, the fingerprint index, and folds with null keys."""

import datetime as dt
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightloom.operators import health, ingest, ledger, limits, routing, similarity
from brightloom.operators.fingerprints import FingerprintIndex
from brightloom.operators.paging import PagedTable
from brightloom.operators.taskboard import TaskBoard
from brightloom.operators.vector_index import VectorIndex
from brightloom.storage import KEPT, Conflict, Manifest


def clustered(seed, clusters, each, dim, spread, directions=2):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((clusters, dim))
    vectors = np.repeat(centers, each, axis=0) + rng.standard_normal((clusters * each, dim)) * spread
    return [(i, f"d{i % directions}", "g#v-1" if i % 11 == 0 else "g", v.tolist()) for i, v in enumerate(vectors)]


def slow_duplicates(rows, batch, threshold):
    unit = np.array([r[3] for r in rows])
    unit = unit / np.sqrt((unit * unit).sum(1))[:, None]
    sims, out = unit @ unit.T, {}
    for n, (i, d, _, _) in enumerate(rows):
        near = [j for m, (j, e, g, _) in enumerate(rows) if i in batch and e == d and j != i and "#v-" not in g and (j not in batch or j < i) and sims[n, m] >= threshold]
        if near:
            out[i] = min(near)
    return out


VECTORS = "item_id long, direction string, guid string, vec array<double>"


@pytest.mark.parametrize(("part", "threshold"), [(4096, 0.92), (40, 0.92), (15, 0.8), (60, 0.99)])
def test_pruned_join_loses_nothing(spark, part, threshold):
    """Against all pairs, with few and with many pivots, cells of one vector and cells cut into parts."""
    rows = clustered(part, 12, 40, 10, 0.15)
    table = spark.createDataFrame(rows, VECTORS)
    got = {r.item_id: r.duplicate_of for r in routing.semantic_duplicates(table.where("item_id % 2 = 0"), table, threshold=threshold, part=part).collect()}
    want = slow_duplicates(rows, {r[0] for r in rows if r[0] % 2 == 0}, threshold)
    assert got == want and len(want) > 20


def test_pruned_join_work(spark):
    """On clustered vectors under half of the pairs meet, and no planted copy is lost."""
    rows = clustered(5, 30, 60, 24, 0.1, directions=1)
    rows += [(10_000 + r[0], r[1], "g", (np.array(r[3]) * 3 + 1e-3).tolist()) for r in rows[::7]]
    table = spark.createDataFrame(rows, VECTORS)
    sides = table.select("item_id", "direction", "vec", F.lit(True).alias("asks"), F.lit(True).alias("answers"), F.lit(True).alias("in_batch"))
    done = similarity.work(sides, 0.92, part=64).first()
    assert done.all_pairs == len(rows) ** 2 and done.compared < 0.25 * done.all_pairs
    got = {r.item_id: r.duplicate_of for r in similarity.least_similar(sides, 0.92, part=64).collect()}
    assert got == slow_duplicates([(r[0], r[1], "g", r[3]) for r in rows], {r[0] for r in rows}, 0.92) and all(10_000 + r[0] in got for r in rows[: 30 * 60 : 7])


def test_pruned_join_odd_rows(spark):
    """Null, zero and infinite vectors, null ids and other lengths match nothing; many equal vectors share a cell."""
    rows = [(i, "d", "g", [1.0, 2.0]) for i in range(300)] + [(2**60 + 1, "d", "g", [2.0, 4.0]), (None, "d", "g", [1.0, 2.0]), (500, "d", "g", None), (501, "d", "g", [0.0, 0.0]), (502, "d", "g", [float("inf"), 1.0]), (503, "d", "g", [1.0, 2.0, 0.0]), (504, None, "g", [1.0, 2.0]), (505, "d", "g", [float("nan"), 1.0]), (506, "d", None, [1.0, 2.0])]
    table = spark.createDataFrame(rows, VECTORS)
    got = {r.item_id: r.duplicate_of for r in routing.semantic_duplicates(table, table, threshold=0.9, part=32).collect()}
    assert got == {i: 0 for i in [*range(1, 300), 506, 2**60 + 1]}
    assert routing.semantic_duplicates(table.limit(0), table).count() == 0 and routing.semantic_duplicates(table.limit(0), table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        similarity.least_similar(table, 0.0)


# ---- stored vector index ----


@pytest.mark.parametrize(("kind", "few"), [("float", True), ("double", True), ("float", False)])
def test_vector_index_as_search(spark, tmp_path, monkeypatch, kind, few):
    from brightloom.operators import vector_index

    if not few:
        monkeypatch.setattr(vector_index, "SPREAD_BYTES", 0)
    rng = random.Random(4)
    vecs = [[rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(3)] for _ in range(400)]
    rows = [*enumerate(vecs), (7, [9.0, 9.0, 1.0]), (400, None), (401, [float("nan")] * 3), (402, [1.0]), (403, []), (None, [1.0, 1.0, 1.0]), (2**60 + 1, [5.0, 0.0, 0.1]), (404, [float("inf"), 0.0, 0.0])]
    table = spark.createDataFrame(rows, f"item_id long, vec array<{kind}>")
    VectorIndex.build(table, f"file://{tmp_path}/index", shards=3, shard_bytes=600)
    index = VectorIndex(spark, f"file://{tmp_path}/index")
    queries = table.where("item_id < 40 OR item_id >= 400").withColumnRenamed("item_id", "query_id")
    got = sorted((r.query_id, r["rank"], r.item_id, round(r.sim, 12)) for r in index.search(queries.where("query_id <> 7"), 4).collect())
    good = [(i, np.array(v, dtype=np.float32).astype(float) if kind == "float" else np.array(v)) for i, v in rows if i is not None and v and all(np.isfinite(v))]
    want = []
    for q, v in good:
        if (q < 40 or q >= 400) and q != 7:
            scored = sorted((-(float(v @ w / n) if (n := np.sqrt(v @ v) * np.sqrt(w @ w)) > 0 else 0.0), i) for i, w in good if len(w) == len(v))[:4]
            want += [(q, n + 1, i, round(-s, 12)) for n, (s, i) in enumerate(scored)]
    assert [x[0] for x in got] == [x[0] for x in sorted(want)] and [x[3] for x in got] == [x[3] for x in sorted(want)]
    assert sum(a == b for a, b in zip(got, sorted(want), strict=True)) >= 0.97 * len(want)  # equal but for the last bits of ties
    assert index.search(queries.limit(0), 4).count() == 0 and max(r.n for r in index.shards().collect()) <= 50


# ---- fingerprints between rounds ----


def items(n, seed):
    rng = random.Random(seed)
    return [(i if i % 50 else None, rng.choice(["a", "a", "b", None]), rng.choice([None, "hot", "hot", *map(str, range(n // 4))])) for i in range(n)]


def test_fingerprint_rounds_equal_one_batch(spark, tmp_path):
    rows = items(900, 1)
    table = spark.createDataFrame(rows, "item_id long, direction string, fingerprint string")
    index = FingerprintIndex(spark, f"file://{tmp_path}/index", fanout=2, buckets=3)
    for n in (2, 0, 3, 1, 4):
        assert index.add(f"r{n}", table.where(F.col("item_id") % 5 == n))
    before, held = index.runs(), sorted(map(tuple, index.firsts(table).collect()))
    assert not index.add("r3", table) and index.runs() == before and index.rounds() == ["r2", "r0", "r3", "r1", "r4"]
    first = {}
    for i, d, p in rows:
        if None not in (i, d, p):
            first[d, p] = min(i, first.get((d, p), i))
    assert held == sorted((d, p, i) for (d, p), i in first.items()) and len(before) < 5
    got = sorted(map(tuple, index.duplicates(table).collect()))
    assert got == sorted((i, first[d, p]) for i, d, p in rows if None not in (i, d, p) and i > first[d, p])
    one = ingest.exact_origins(table.where("direction IS NOT NULL AND item_id IS NOT NULL"), ["direction", "fingerprint"]).where("duplicate_of IS NOT NULL")
    assert got == sorted(map(tuple, one.select("item_id", "duplicate_of").collect()))
    for name in before:
        spark.sql(f"DROP TABLE {name}")  # as in a new session, whose catalog knows no run
    again = FingerprintIndex(spark, f"file://{tmp_path}/index")
    assert again.buckets == 3 and sorted(map(tuple, again.duplicates(table).collect())) == got
    again.drop()


def test_fingerprint_lookup_does_not_shuffle_runs(spark, tmp_path):
    table = spark.range(4000).select(F.col("id").alias("item_id"), (F.col("id") % 3).cast("string").alias("direction"), F.sha2((F.col("id") % 1000).cast("string"), 256).alias("fingerprint"))
    index = FingerprintIndex(spark, f"file://{tmp_path}/index", buckets=4)
    index.add("r0", table.where("item_id < 2000"))
    state = index._state()[1]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run = index._run(index.runs()[0], state["schema"])
        plan = table.alias("a").join(run.alias("b"), index._matches(table, run), "left")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan
    index.drop()


def test_manifest_keeps_its_last_commits(spark, tmp_path):
    one = Manifest(spark, f"file://{tmp_path}/m")
    for n in range(KEPT + 5):
        one.write(n, {"n": n})
    assert one.read() == (KEPT + 5, {"n": KEPT + 4}) and len(list(tmp_path.glob("m/commits/*.json"))) <= KEPT
    with pytest.raises(Conflict):
        one.write(3, {"n": "late"})
    assert one.read()[1] == {"n": KEPT + 4}


def test_hot_fingerprint_is_split(spark):
    """A fingerprint of half of the rows: the join with the origins is a skew join."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.shuffle.partitions": "20"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(40_000).select(F.col("id").alias("item_id"), F.lit("d").alias("direction"), F.sha2(F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id") % 9000).cast("string"), 256).alias("fp"))
        out = ingest.exact_origins(rows.repartition(8), ["direction", "fp"])
        found = out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "SortMergeJoin(skew=true)" in plan and sum(r.duplicate_of == 0 for r in found) == 19_999


# ---- null keys beside ids ----


def test_folds_with_null_keys(spark):
    at = dt.datetime(2024, 3, 1, 12)
    rows = [(2**60 + 1, 1, "v", at), (2**60 + 1, 2, "v", at), (None, 3, "v", at), (None, 4, "v", at), (None, 5, "w", at)]
    out = limits.reactions(spark.createDataFrame(rows, "article_id long, feedback_id long, visitor string, ts timestamp").coalesce(1)).collect()
    assert sorted(((r.article_id, r.feedback_id, r.outcome) for r in out), key=lambda r: r[1]) == [(2**60 + 1, 1, "counted"), (2**60 + 1, 2, "already_counted"), (None, 3, "counted"), (None, 4, "already_counted"), (None, 5, "counted")]
    out = limits.throttled(spark.createDataFrame([(None, 1.0, 2**60 + 1), (None, 1.0, 2**60 + 2), ("h", 1.0, None)], "netloc string, at double, request_id long"), gap_s=2.0, max_wait_s=60.0).collect()
    assert sorted((str(r.netloc), str(r.request_id), r.wait) for r in out) == [("None", str(2**60 + 1), 0.0), ("None", str(2**60 + 2), 2.0), ("h", "None", 0.0)]
    schema = f"source_id long, round_id long, kind string, now double, {health.ROUND}"
    rounds = [(s, 2**60 + n, "rss", float(n), None, 200, 0, 0, False, False, None, False, False) for s in (None, 2**60 + 1) for n in range(3)]
    got = {(r.source_id, r.round_id): r.empty_rounds for r in health.health_after(spark.createDataFrame(rounds, schema).coalesce(1), every=True).collect()}
    assert got == {(s, 2**60 + n): n + 1 for s in (None, 2**60 + 1) for n in range(3)}
    last = {r.source_id: (r.round_id, r.empty_rounds) for r in health.health_after(spark.createDataFrame(rounds, schema)).collect()}
    assert last == {None: (2**60 + 2, 3), 2**60 + 1: (2**60 + 2, 3)}


# ---- tasks, pages, percentiles ----


def test_two_workers_win_each_task_once(spark, tmp_path):
    path, now = f"file://{tmp_path}/board", F.lit("2024-03-01 12:00:00").cast("timestamp")
    TaskBoard(spark, path).put(spark.range(24).select(F.col("id").alias("task_id"), F.lit("score").alias("kind")))
    won: dict[str, list[int]] = {"a": [], "b": []}
    failed = []

    def work(name):
        try:
            board = TaskBoard(spark, path, compact_after=3)
            while mine := [r.task_id for r in board.claim(name, 4, now).collect()]:
                won[name] += mine
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=work, args=(x,)) for x in won]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and sorted(won["a"] + won["b"]) == list(range(24))
    rows = TaskBoard(spark, path).tasks().collect()
    assert all(r.attempts == 1 and r.status == "RUNNING" and r.task_id in won[r.owner] for r in rows) and len(rows) == 24


def test_board_ends_only_own_tasks(spark, tmp_path):
    board, now = TaskBoard(spark, f"file://{tmp_path}/board", compact_after=2), F.lit("2024-03-01 12:00:00").cast("timestamp")
    tasks = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y"), (3, "x"), (None, "x")], "task_id long, kind string")
    board.put(tasks)
    assert board.put(tasks).count() == 0
    assert [r.task_id for r in board.claim("a", 5, now, kind="x").orderBy("task_id").collect()] == [1, 3]
    results = spark.createDataFrame([(1, "DONE", None), (2, "DONE", None), (3, "FAILED", "boom")], "task_id long, result string, error string")
    assert board.finish("b", results, now).count() == 0
    assert {r.task_id: r.status for r in board.finish("a", results, now).collect()} == {1: "DONE", 3: "FAILED"}
    assert board.finish("a", results, now).count() == 0 and board.claim("b", 5, now, kind="z").count() == 0
    assert {r.task_id: (r.status, r.owner, r.last_error) for r in board.tasks().collect()} == {1: ("DONE", "a", None), 2: ("PENDING", None, None), 3: ("FAILED", "a", "boom")}
    assert len(board.manifest.read()[1]["folders"]) <= 2


def test_deep_pages_read_their_files_only(spark, tmp_path):
    ids = [3 * i for i in range(5000)]
    rows = spark.createDataFrame([(i, f"t{i}") for i in ids] + [(None, "no id")], "id long, title string").repartition(7)
    table = PagedTable.build(rows, "id", f"file://{tmp_path}/t", files=20)
    want = sorted(ids, reverse=True)
    for offset, limit in ((0, 20), (2480, 20), (4990, 20), (0, 5000), (777, 1), (5000, 20), (9000, 5), (10, 0)):
        assert [r.id for r in table.page(offset, limit).collect()] == want[offset : offset + limit]
    assert table.total() == 5000 and len(table.zones().collect()) >= 15 and len(table.files_of(2480, 20)) <= 2
    page = PagedTable(spark, f"file://{tmp_path}/t", "id").page(2480, 20)
    assert len(page.inputFiles()) == len(table.files_of(2480, 20))  # what the plan scans
    empty = PagedTable.build(rows.limit(0), "id", f"file://{tmp_path}/e")
    assert empty.total() == 0 and empty.page(0, 10).count() == 0


def test_pages_of_repeated_keys_do_not_depend_on_how_rows_were_dealt(spark, tmp_path):
    want = sorted(((i // 5, i * 37 % 101) for i in range(1000)), reverse=True)
    for n, seed in enumerate((3, 8)):
        rows = list(want)
        random.Random(seed).shuffle(rows)
        table = PagedTable.build(spark.createDataFrame(rows, "id long, v long").repartition(n + 2), "id", f"file://{tmp_path}/t{n}", files=6)
        for offset, limit in ((0, 7), (7, 7), (498, 3), (993, 7)):
            assert [(r.id, r.v) for r in table.page(offset, limit).collect()] == want[offset : offset + limit]


@pytest.mark.parametrize("kind", ["distinct", "ties", "one", "double", "small"])
def test_percentiles_in_two_passes(spark, kind):
    rng = random.Random(7)
    values = {"distinct": rng.sample(range(10**9), 30_000), "ties": [rng.choice([1, 1, 1, 5, 9]) for _ in range(20_000)], "one": [7], "double": [rng.gauss(0, 1) for _ in range(20_000)], "small": [3, 1, 2]}[kind]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], f"v {'double' if kind == 'double' else 'long'}").repartition(6)
    shares = [0.0, 0.001, 0.25, 0.5, 0.9, 0.99, 0.9999, 1.0]
    for accuracy in (50, 10_000):
        got = {r.share: r.value for r in ledger.nearest_rank(rows, "v", shares, accuracy).collect()}
        assert got == {p: sorted(values)[min(int(len(values) * p), len(values) - 1)] for p in shares}
    assert ledger.nearest_rank(rows.where("v IS NULL"), "v", shares).count() == 0


def test_settled_removes_what_was_stored_on_the_way(spark):
    from pathlib import Path

    from brightloom import storage

    def make():
        rows = storage.stored(spark.range(10), "inner")
        deeper, _ = storage.settled(spark, lambda: storage.stored(rows.where("id > 3"), "inner"), "outer")
        return deeper.where("id < 8")

    rows, path = storage.settled(spark, make, "result")
    assert sorted(r.id for r in rows.collect()) == [4, 5, 6, 7] and not storage._OPEN
    folder = Path(path.removeprefix("file://")).parent
    assert not list(folder.glob("inner-*")) and not list(folder.glob("outer-*")) and list(folder.glob("result-*"))


@pytest.mark.parametrize("k", [1, 5, 700])
def test_products_of_a_block_and_a_shard_are_held_in_parts(k):
    import tracemalloc

    from brightloom.operators import vector_index

    rng = np.random.default_rng(3)
    matrix, wanted = rng.integers(-3, 4, (60_000, 6)).astype("<f4"), rng.integers(-3, 4, (512, 6)).astype("<f4")
    matrix[7], wanted[3] = 0, 0
    shard = (np.arange(60_000) * 2, vector_index.norms_of(matrix), matrix)
    block = (np.arange(512), vector_index.norms_of(wanted), wanted)
    tracemalloc.start()
    queries, ids, sims = vector_index.best(shard, block, k)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(queries) == 512 * k and peak < (200 << 20)
    for q in (0, 3, 11):
        dots = np.add.accumulate(matrix.astype(float) * wanted[q].astype(float), axis=1)[:, -1]
        over = shard[1] * block[1][q]
        all_sims = np.divide(dots, over, out=np.zeros(len(dots)), where=over > 0)
        want = np.lexsort((shard[0], -all_sims))[:k]
        assert ids[queries == q].tolist() == shard[0][want].tolist() and sims[queries == q].tolist() == all_sims[want].tolist()


def test_citation_rows_deal_lines_by_their_number(spark, data, monkeypatch):
    from brightloom.plans import catalog

    monkeypatch.setattr(catalog, "LINES_A_TASK", 100, raising=False)
    rows = catalog.citation_rows(spark, data)
    lines = spark.read.parquet(f"{data}/lineitem.parquet").count()
    assert rows.rdd.getNumPartitions() >= lines / 100 > 10
    assert rows.agg(F.sum("n")).first()[0] == lines
