"""Behaviours of single operators, by literals and by plain Python."""

import difflib
import random

from pyspark.sql import functions as F

from brightloom.functions import dates as D
from brightloom.functions import text as T
from brightloom.functions import urls as U
from brightloom.functions import vectors as V
from brightloom.operators import gates, health, limits, routing
from brightloom.operators.publishing import _markup
from brightloom.sources import feeds, tables


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_text(spark):
    got = one(spark, T.strip(F.lit("\t a　\n")), T.fold(F.lit(" a　 b\n")), T.norm(F.lit("A　b C")), T.ngrams(F.lit("a😀中"), 2), T.ngrams(F.lit("a"), 2), T.ngrams(F.lit(None).cast("string"), 2))
    assert list(got) == ["a", "a b", "abc", ["a😀", "😀中"], [], []]
    got = one(spark, T.or_default(F.lit(0), 60), T.or_default(F.lit(5), 60), T.detect_lang(F.lit("今天天气很好")), T.detect_lang(F.lit("カタカナ")), T.detect_lang(F.lit("plain")), T.detect_lang(F.lit("  ")))
    assert list(got) == [60, 5, "zh", "ja", "en", ""]


def test_pieces_hold_all_ngrams(spark):
    text = "".join(random.Random(1).choice("abcä") for _ in range(1700))
    for n in (2, 8, 40):
        got = spark.range(1).select(F.explode(T.pieces(F.lit(text), n, 128)).alias("p")).select(F.explode(T.ngrams(F.col("p"), n)).alias("g"))
        assert sorted(r.g for r in got.collect()) == sorted(text[i : i + n] for i in range(len(text) - n + 1))


def test_dice(spark):
    for a, b in (("abcd", "abce"), ("a", "a"), ("a", "b"), ("aaaa", "aa"), ("", "")):
        ga, gb = ({x[i : i + 2] for i in range(len(x) - 1)} for x in (a, b))
        want = float(a == b) if min(len(a), len(b)) < 2 else 2 * len(ga & gb) / (len(ga) + len(gb))
        assert one(spark, T.bigram_dice(F.lit(a), F.lit(b)))[0] == want


def test_first_sentence_and_rhythm(spark):
    assert one(spark, T.first_sentence(F.lit("好。下一句")))[0] == "好。"
    assert one(spark, T.first_sentence(F.lit("x" * 130)))[0] == "x" * 120 + "…"
    assert abs(one(spark, T.population_stddev(F.array(*[F.lit(x) for x in (2, 4, 4, 4, 5, 5, 7, 9)])))[0] - 2.0) < 1e-12
    assert one(spark, T.rhythm_stddev(F.lit("ab。cd。")))[0] is None


def test_urls(spark):
    u = F.lit("HTTPS://Example.com/Path?utm_source=x&b=1&a=&REF=2#part")
    got = one(spark, U.normalize_url(u), U.canonical_url(u), U.normalize_url(F.lit("no scheme ")), U.host(F.lit("http://A.b:80/x")), U.netloc(F.lit("http://A.b:80/x")))
    assert list(got) == ["HTTPS://Example.com/Path?b=1&a=", "https://example.com/Path?b=1&a=", "no scheme", "a.b", "A.b:80"]
    got = one(spark, *[U.ipv4_is_public(F.lit(x)) for x in ("8.8.8.8", "10.1.2.3", "172.31.0.1", "256.1.1.1")])
    assert list(got) == [True, False, False, None]
    assert [r[0] for r in spark.createDataFrame([("::1",), ("::ffff:10.0.0.1",), ("2606:4700::1",), ("x",)], "a string").select(U.address_is_public("a")).collect()] == [False, False, True, None]


def test_dates(spark):
    at = F.lit("2024-03-01 16:30:00").cast("timestamp")
    got = one(spark, D.local_day_start(at, "Asia/Shanghai").cast("string"), D.local_date_key(at, "Asia/Shanghai"), D.retry_after_seconds(F.lit("120"), at), D.retry_after_seconds(F.lit("Fri, 01 Mar 2024 16:31:00 GMT"), at), D.retry_after_seconds(F.lit("soon"), at))
    assert list(got) == ["2024-03-01 16:00:00", "2024-03-02", 120, 60, None]
    assert D.resolve_zone("No/Where") == "UTC"


def test_semantic_duplicates_as_loop(spark):
    rng = random.Random(3)
    rows = [(i, "d%d" % (i % 2), "g#v-1" if rng.random() < 0.2 else "g", [rng.choice([0.0, 1.0, 1.0]) for _ in range(3)]) for i in range(60)]
    batch = {i for i in range(60) if i % 3 == 0}
    pool = spark.createDataFrame(rows, "item_id long, direction string, guid string, vec array<double>")

    def cos(a, b):
        na, nb = sum(x * x for x in a) ** 0.5, sum(x * x for x in b) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / na / nb if na and nb else 0.0

    want = {}
    for i, d, _, v in rows:
        found = [j for j, e, g, w in rows if i in batch and j != i and e == d and "#v-" not in g and (j not in batch or j < i) and cos(v, w) >= 0.9]
        if found:
            want[i] = min(found)
    got = routing.semantic_duplicates(pool.where("item_id % 3 = 0"), pool, threshold=0.9, part=7)
    assert {r.item_id: r.duplicate_of for r in got.collect()} == want


def test_semantic_duplicates_by_hashes(spark):
    """With sign hashes, cut into small parts, nearly all of the exact result is found and nothing else."""
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 16))
    vectors = np.concatenate([base, *(base + rng.standard_normal(base.shape) * s for s in (0.05, 0.1, 0.2, 0.3))])
    pool = spark.createDataFrame([(i, "d%d" % (i % 2), "g", v.tolist()) for i, v in enumerate(vectors)], "item_id long, direction string, guid string, vec array<double>")
    exact = {r.item_id: r.duplicate_of for r in routing.semantic_duplicates(pool, pool).collect()}
    got = {r.item_id: r.duplicate_of for r in routing.semantic_duplicates(pool, pool, part=9, recall=0.9999, shape=(4, 24)).collect()}
    assert len(exact) > 100 and sum(got.get(i) == j for i, j in exact.items()) >= 0.99 * len(exact) and set(got) <= set(exact)
    assert routing.hash_shape(100, 0.92, 0.9999, 4096) == (0, 1) and routing.hash_shape(4096 * 8, 0.92, 0.9999, 4096)[0] == 3


def test_ranked_matches_as_loop(spark):
    rng = random.Random(4)
    vecs = [[rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(3)] for _ in range(400)]
    rows = spark.createDataFrame([*enumerate(vecs), (400, None), (401, [float("nan")] * 3), (402, [1.0])], "item_id long, vec array<float>")
    queries = rows.where("item_id % 20 = 0").withColumnRenamed("item_id", "query_id")
    pairs = rows.crossJoin(queries.select("query_id", F.col("vec").alias("q"))).where("query_id < 400 AND item_id < 400")
    want = {}
    for r in pairs.select("query_id", "item_id", V.cosine(F.col("vec"), F.col("q")).alias("sim")).collect():
        want.setdefault(r.query_id, []).append((-r.sim, r.item_id))
    ranked = routing.ranked_matches(queries, rows, 5, shard_rows=10)
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Join" not in plan  # the queries are not folded into one row
    got = {}
    for r in ranked.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.item_id, r.sim))
    assert sorted(got) == list(range(0, 401, 20))
    assert {q: [(i, s) for _, i, s in sorted(x)] for q, x in got.items() if q < 400} == {q: [(i, -s) for s, i in sorted(x)[:5]] for q, x in want.items()}
    assert [x[1:] for x in sorted(got[400])] == [(i, None) for i in range(5)]


def test_cosine_topk_asks_a_twentieth(spark, data):
    from brightloom.plans.catalog import QUERIES

    ids = {r.vec_id for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id").collect()}
    assert {r.query_id for r in QUERIES["cosine_topk_every20"](spark, data).collect()} == {i for i in ids if i % 20 == 0}


def test_evaluation_ranks_all_rows(spark, tmp_path):
    import numpy as np

    from brightloom.plans.catalog import QUERIES

    n = 1_100_000  # item 0 is the query; the others fall in similarity, three by three alike
    vec = F.array(F.lit(1.0), F.floor(F.col("id") / 3) / 1e4)
    spark.range(n).select(F.col("id").alias("vec_id"), F.lit(7).alias("label"), vec.alias("embedding")).write.parquet(str(tmp_path / "embeddings.parquet"))
    ranks = np.arange(0, n, 3) + 1.0
    got = QUERIES["recall_at_k"](spark, str(tmp_path)).collect()
    assert [(r.query_id, r.n_positive, r.best) for r in got] == [(7, len(ranks), 1)]
    assert abs(got[0].recall_5 * len(ranks) - 2) < 1e-6 and abs(got[0].recall_10 * len(ranks) - 4) < 1e-6
    assert abs(QUERIES["mrr_by_query"](spark, str(tmp_path)).first().mrr / (1 / ranks).mean() - 1) < 1e-9
    negatives = np.bincount(np.arange(n)[np.arange(n) % 3 > 0] // 3, minlength=len(ranks))
    below = negatives[::-1].cumsum()[::-1] - negatives / 2
    assert abs(QUERIES["auc_by_query"](spark, str(tmp_path)).first().auc / (below.sum() / len(ranks) / negatives.sum()) - 1) < 1e-12


def test_ranked_as_window(spark):
    from pyspark.sql import Window

    from brightloom.operators import evaluation

    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), i * 30_000, rng.choice([None, float("nan"), 0.0, -0.5, 0.5, float("inf"), rng.uniform(-1, 1)])) for i in range(300)]
    table = spark.createDataFrame(rows, "q string, item_id long, s double")
    want = table.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "item_id")))
    got = evaluation.ranked(table, "q", "s", "item_id")
    assert {(r.q, r.item_id): r["rank"] for r in got.collect()} == {(r.q, r.item_id): r["rank"] for r in want.collect()}


def test_semantic_dup_all_finds_every_pair(spark, tmp_path):
    from brightloom.plans.catalog import QUERIES

    rows = [(1, 0, [1.0, 0.0, 0.0]), (2, 0, [1.0, 0.1, 0.0]), (3, 0, [1.0, 1.0, 0.0]), (4, 1, [1.0, 0.0, 0.0]), (5, 0, [0.0, 0.0, 1.0]), (7, 0, [0.0, 0.1, 1.0]), (9, 0, [0.0, 1.0, 0.0]), (10, 0, [0.0, 1.0, 0.1])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.item_id: r.duplicate_of for r in QUERIES["semantic_dup_all"](spark, str(tmp_path)).collect()}
    assert got == {2: 1, 7: 5}  # 3 is too far, 4 is of another direction, 9 is a version of a page


def test_explore_picks_as_loop(spark):
    rng = random.Random(8)
    unit = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    rows = [(i, "d%d" % (i % 2), rng.uniform(-1, 1), [rng.uniform(-1, 1) for _ in range(4)], 60, False) for i in range(80)]
    table = spark.createDataFrame(rows, "item_id long, direction string, sim double, vec array<double>, quality int, passed boolean")
    want = set()
    for d in ("d0", "d1"):
        left, taken = [r for r in rows if r[1] == d], []
        for at in range(1, 5):
            near = lambda r: max((sum(x * y for x, y in zip(unit(r[3]), unit(p[3]))) for p in taken), default=0.0)  # noqa: B023, E731
            best = max(left, key=lambda r: -0.3 * r[2] - 0.7 * near(r))  # noqa: B023
            left.remove(best)
            taken.append(best)
            want.add((d, best[0], at))
    picks = routing.explore_picks(table, quota=4, percentile=100)
    assert set(map(tuple, picks.collect())) == want
    assert "FlatMapGroupsInPandas" not in picks._jdf.queryExecution().optimizedPlan().toString()
    assert routing.explore_picks(table.limit(0)).count() == 0


def test_score_summary(spark):
    from brightloom.operators import ledger

    rows = spark.createDataFrame([("a", 10, 5), ("a", 20, 9), ("a", 30, 7), ("a", 40, 7), ("a", 600, None), ("b", 0, 3)], "band string, chars int, relevance int")
    out = ledger.score_summary(rows, [0, 500])
    assert {(r.band, r.bucket): (r.n, r["mean"], r.median) for r in out.collect()} == {("a", 0): (4, 7.0, 7), ("a", 500): (1, None, None), ("b", 0): (1, 3.0, 3)}
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_throttle_and_quota(spark):
    rows = spark.createDataFrame([("h", 0.0, 1), ("h", 0.0, 2), ("h", 0.0, 3), ("h", 10.0, 4)], "netloc string, at double, request_id long")
    got = {r.request_id: (r.wait, r.accepted) for r in limits.throttled(rows, gap_s=3.0, max_wait_s=4.0).collect()}
    assert got == {1: (0.0, True), 2: (3.0, True), 3: (6.0, False), 4: (0.0, True)}


def test_health_machine():
    base = {"error": None, "http_status": None, "feed_entries": 3, "inserted": 1, "not_modified": False, "rate_limited": False, "retry_after": None, "skip_day": False, "quota_blocked": False, "kind": "rss", "now": 0.0}
    h = health.Health()
    for n in range(3):
        h = health.advance(h, base | {"error": "http 404", "http_status": 404, "feed_entries": 0, "now": float(n)})
    assert (h.failure_level, h.event, h.backoff_failures) == ("hard_failed", "hard_failed", 3)
    h = health.advance(h, base | {"now": 9.0})
    assert (h.failure_level, h.event, h.backoff_failures) == ("none", "recovered", 0)
    h = health.advance(h, base | {"rate_limited": True, "retry_after": 120.0, "now": 10.0})
    assert h.rate_limited_until == 130.0


def test_health_stream_as_batch(spark, tmp_path):
    from brightloom.streaming.rounds import health_stream

    rng = random.Random(5)
    rows = [(s, i, "rss", float(i), rng.choice([None, "http 404"]), 404, rng.randint(0, 2), rng.randint(0, 1), False, rng.random() < 0.2, None, False, False) for i in range(40) for s in (1, 2)]
    schema = f"source_id long, round_id long, kind string, now double, {health.ROUND}"
    table = spark.createDataFrame(rows, schema)
    table.write.parquet(str(tmp_path / "in"))
    stream = health_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("rounds_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    cols = ["source_id", "round_id", "failure_level", "rate_level", "backoff_failures", "zero_gain_level"]
    assert sorted(map(tuple, spark.table("rounds_out").select(*cols).collect())) == sorted(map(tuple, health.health_after(table, every=True).select(*cols).collect()))


def test_longest_common(spark):
    rows = spark.createDataFrame([("abcdefgh", "xxcdefyy"), ("", "a"), (None, "a"), ("same", "same")], "a string, b string")
    assert [r[0] for r in rows.select(gates.longest_common(F.col("a"), F.col("b"))).collect()] == [4, 0, 0, 4]


def test_longest_common_as_loop(spark):
    """Random texts with planted stretches, empty and null ones, repetitions, and characters of one to four bytes."""
    rng, pairs = random.Random(9), [("", ""), ("a", "a"), ("a", "b"), (None, "x"), ("aaaa" * 40, "aaa" * 30), ("é中😀x" * 9, "中😀x" * 5), ("x" * 1000 + "needle", "needle" + "y" * 700)]
    for _ in range(120):
        k = rng.choice(["ab", "abcdefgh", "abé中😀"])
        a, b = ("".join(rng.choices(k, k=rng.randint(0, 90))) for _ in range(2))
        shared = "".join(rng.choices(k, k=rng.randint(0, 70)))
        pairs.append((a + shared + a[:7], b[:9] + shared + b))
    got = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i long, a string, b string").select("i", gates.longest_common(F.col("a"), F.col("b")).alias("n"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    want = {i: difflib.SequenceMatcher(None, a or "", b or "", autojunk=False).find_longest_match().size for i, (a, b) in enumerate(pairs)}
    assert {r.i: r.n for r in got.collect()} == want and "Python" not in plan


def test_echo_uses_every_anchor(spark, tmp_path):
    from brightloom.plans.catalog import QUERIES

    anchors = [(100 + i * 3, chr(0x4E00 + i) * (i + 1)) for i in range(90)]  # each shares only its own character
    spark.createDataFrame(anchors, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    talk = "".join(text for _, text in anchors)
    spark.createDataFrame([(i, 0, talk) for i in range(180)], "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = QUERIES["echo_lengths"](spark, str(tmp_path)).collect()
    assert {r.conv_id: r.echo_max_chars for r in got} == {i: i % 90 + 1 for i in range(180)} and len(got) == 180


def test_markup_escapes():
    out = _markup("# A <b>\n\n[x](javascript:alert(1)) [y](https://e.com)\n\n- one\n- two")
    assert "<b>" not in out and "javascript" not in out.replace("javascript:alert(1)", "") and 'href="https://e.com"' in out and out.count("<li>") == 2


def test_feed_and_dump(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><guid>g1</guid><link>http://a.com/x?utm_source=q</link><title> T </title><pubDate>Fri, 01 Mar 2024 16:31:00 GMT</pubDate><description>Body</description></item><item><title>none</title></item></channel></rss>")
    rows = feeds.rss_entries(spark, str(tmp_path / "f.xml")).collect()
    assert [(r.guid, r.title, r.content_text, str(r.published_at)) for r in rows] == [("g1", "T", "Body", "2024-03-01 16:31:00")]
    (tmp_path / "d.txt").write_text("1\tt\ta\\nb\n2\t\\N\tc\\x41\textra\n3\n")
    got = sorted(map(tuple, tables.read_dump_rows(spark, str(tmp_path / "d.txt"), [("id", "integer"), ("ok", "boolean"), ("body", "text")]).collect()))
    assert got == [("1", "1", "a\nb", 3), ("2", None, "cA", 4), ("3", None, None, 1)]


def test_vectors(spark):
    a, z = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert list(one(spark, V.cosine(a, a), V.cosine(a, z), V.l2_normalize(a))) == [1.0, 0.0, [0.6, 0.8]]
    rows = spark.createDataFrame([([1.5, -2.0],), (None,)], "v array<float>")
    assert [r[0] for r in rows.select(V.from_blob(V.to_blob("v"))).collect()] == [[1.5, -2.0], None]


def test_anti_join_plans(spark, data):
    from brightloom.plans.catalog import QUERIES

    plan = QUERIES["scoring_candidates_anti"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "Cartesian" not in plan
