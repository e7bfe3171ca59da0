"""Periodic runs and the Merkle manifest against brute-force versions, with odd rows and texts."""

import hashlib
import random
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightloom.llm import merkle, passages, periods
from tests.llm.test_cases import clashing, kept_whole
from tests.llm.test_llm import DOCS, docs_of
from tests.oracle import duck, same

# ---- periodic runs ----


def slow_runs(ids, least=24, times=3):
    out = []
    for q in range(1, len(ids) // times + 1):
        i = 0
        while i + q < len(ids):
            j = i
            while j + q < len(ids) and ids[j] == ids[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, times * q) and not any(all(ids[k] == ids[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out)


def some_words(rng):
    n, k = rng.randint(0, 160), rng.choice([1, 2, 2, 3, 5, 30])
    ids = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randint(0, 4) if n > 30 else 0):
        a, p = rng.randrange(n - 20), rng.randint(1, 14)
        for i in range(a + p, min(n, a + rng.randint(10, 100))):
            ids[i] = ids[i - p]
    return ids


def test_runs_as_brute_force():
    rng, found = random.Random(1), 0
    for _ in range(400):
        ids = some_words(rng)
        want = slow_runs(ids)
        assert periods.runs_of(np.array(ids, dtype=np.int64)) == want, ids
        found += len(want)
    assert found > 200


@pytest.mark.parametrize("heavy", [0.0, 2.5, 1e9])
def test_lag_matches(monkeypatch, heavy):
    """The same counts whether all words, some or none are counted by FFT."""
    monkeypatch.setattr(periods, "HEAVY", heavy)
    for n, k in ((1, 1), (30, 2), (700, 3), (3000, 40)):
        ids = np.random.default_rng(n).integers(0, k, n)
        most = n // 3
        assert periods.lag_matches(ids, most).tolist() == [0] + [int((ids[:-q] == ids[q:]).sum()) for q in range(1, most + 1)]


def test_runs_of_very_long_texts():
    began = time.monotonic()
    n = 300_000
    assert periods.runs_of(np.zeros(n, dtype=np.int64)) == [(0, n, 1)]
    mixed = np.random.default_rng(0).zipf(1.3, n) % 5000
    mixed[1000:200_000] = mixed[np.arange(1000, 200_000) % 777]
    assert (1000, 199_000, 777) in [(s + max(0, 1000 - s), e - max(0, 1000 - s), p) for s, e, p in periods.runs_of(np.unique(mixed, return_inverse=True)[1])]
    assert time.monotonic() - began < 120


def slow_query(doc_id, text):
    words = [w for w in (text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(words)
    best = sorted(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))[:1]
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    start, length, period = best[0] if best else (None,) * 3
    milli = length * 1000 // period if best else None
    return doc_id, len(runs), start, length, period, milli, sha("".join(f"{s},{x},{q}\n" for s, x, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def test_op12_as_brute_force(spark, tmp_path):
    rng = random.Random(4)
    texts = [rng.choice([" ", "\t", " \n", "\x0b"]).join(["wörd", "b", "C", "c\x85d", "x\xa0y", *map(str, range(40))][i] for i in some_words(rng)) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate([*texts, None, "", " \n ", "a " * 5000, "a b " * 3000 + "c " * 40])] + [(None, "a " * 30), (3, texts[5]), (3, texts[5]), (2**60 + 1, "x y z " * 20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    out = periods.op12_periods(spark, f"file://{tmp_path}")
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted((slow_query(*r) for r in rows), key=str)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, t in rows) > 5


def test_periods_odd_tables(spark):
    docs = clashing(spark, ["a " * 40, "one two", None, ""])
    kept_whole(periods.with_runs(docs), docs)
    assert periods.with_runs(spark.createDataFrame([], DOCS)).count() == 0
    row = periods.with_runs(docs_of(spark, ["x " + "a b " * 15])).where("doc_id = 0").first()
    assert [tuple(r) for r in row.runs] == [(1, 30, 2)] and row.collapsed == "x a b" and row.n_words == 31


# ---- Merkle manifest ----


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slow_leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def slow_tree(digests, fanout):
    """The root, and each leaf's siblings as (left, right) a level."""
    ways, at, nodes = [[] for _ in digests], list(range(len(digests))), digests
    while len(nodes) > 1:
        for i, place in enumerate(at):
            run = nodes[place // fanout * fanout :][:fanout]
            ways[i].append((run[: place % fanout], run[place % fanout + 1 :]))
            at[i] = place // fanout
        nodes = [sha("".join(nodes[k : k + fanout])) for k in range(0, len(nodes), fanout)]
    return nodes[0], ways


def slow_manifest(rows, tamper, fanout=2):
    low, out = lambda x: (x is not None, x.encode() if isinstance(x, str) else x or 0), []
    langs = sorted({r[2] for r in rows}, key=low)
    trees = {}
    for lang in langs:
        mine = sorted([r for r in rows if r[2] == lang], key=lambda r: (low(r[0]), slow_leaf(r)))
        trees[lang] = (mine, *slow_tree([slow_leaf(r) for r in mine], fanout))
    root, upper = slow_tree([trees[lang][1] for lang in langs], fanout)
    for lang, above in zip(langs, upper, strict=True):
        mine, subroot, ways = trees[lang]
        for r, way in zip(mine, ways, strict=True):
            fold = slow_leaf(tamper(r))
            for left, right in way + above:
                fold = sha("".join([*left, fold, *right]))
            proof = [x for left, right in way + above for x in left + right]
            out.append((r[0], slow_leaf(r), subroot, root, sha("".join(proof)), fold, fold == root))
    return sorted(out, key=str)


def tampered(r):
    hit = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
    return (*r[:3], r[3] + 1, r[4]) if hit else r


def manifest_rows():
    rng = random.Random(2)
    rows = [(i, f"s{i % 3}", rng.choice(["en"] * 6 + ["dé", "zz", None]), i * 3, f"text {i} é" * (i % 4)) for i in range(700)]
    rows += [(None, None, "en", None, None), (None, "a", None, 3, "x"), (14, None, "lone", None, ""), (5, "s", "en", 1, "again"), (5, "s", "en", 1, "again"), (2**60 + 1, "s", "", 5, "-")]
    return rows


@pytest.mark.parametrize(("fanout", "stride"), [(2, 8), (2, 1), (2, 3), (3, 2), (5, 1)])
def test_manifest_as_brute_force(spark, fanout, stride):
    rows = manifest_rows()[: 120 if stride == 1 else None] if stride == 1 else manifest_rows()
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    hit = F.coalesce(F.crc32(F.col("row.doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False)).cast("int")
    out = merkle.manifest(docs, changed={"n_chars": F.col("row.n_chars") + hit}, fanout=fanout, stride=stride)
    got = out.select("doc_id", "leaf", "subroot", "root", merkle.hashed(F.col("proof")), "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=str) == slow_manifest(rows, tampered, fanout)
    assert {r.verified for r in got} == {True, False}


def test_op13_sql(spark, tmp_path):
    spark.createDataFrame(manifest_rows(), "doc_id long, source string, lang string, n_chars long, text string").coalesce(1).write.parquet(f"file://{tmp_path}/out")
    part = next(tmp_path.glob("out/*.parquet"))
    part.rename(tmp_path / "documents.parquet")
    same(merkle.op13_merkle(spark, str(tmp_path)), duck(tmp_path), merkle.OP13_SQL)


def test_manifest_odd_tables(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0
    one = merkle.manifest(docs_of(spark, ["only"]).where("doc_id = 0")).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof == [] and one.verified
    docs = clashing(spark, ["a", "b", None, "", "word " * 200_000])
    out = merkle.manifest(docs).collect()
    assert len(out) == docs.count() and all(r.verified for r in out) and len({r.root for r in out}) == 1
    equal = spark.createDataFrame([(1, "s", "en", 1, "same")] * 3000, "doc_id long, source string, lang string, n_chars long, text string")
    out = merkle.manifest(equal).select("root", "verified", F.size("proof").alias("n")).collect()
    assert len(out) == 3000 and all(r.verified and r.n <= 12 for r in out) and out[0].root == slow_tree([slow_leaf((1, "s", "en", 1, "same"))] * 3000, 2)[0]


def test_manifest_is_numbered_over_ranges(spark):
    """No task numbers a whole group: the plan's only window runs over the counts of ranges."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("group"), F.xxhash64("id").alias("order"))
    out = merkle.numbered(rows.repartition(6), "group", ["order"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    got = out.collect()
    for g in "ab":
        mine = [r for r in got if r.group == g]
        assert [r.place for r in sorted(mine, key=lambda r: r.order)] == list(range(len(mine))) and {r.total for r in mine} == {len(mine)}


# ---- repeated passages ----


def slow_words(text):
    return [w for w in (text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]


def slow_passages(rows, width=50):
    """(n_words, n_removed, kept words) of each row."""
    texts, origin = [slow_words(t) for _, t in rows], {}
    for (doc, _), words in zip(rows, texts, strict=True):
        for i in range(len(words) - width + 1) if doc is not None else ():
            k = tuple(words[i : i + width])
            origin[k] = min(origin.get(k, doc), doc)
    out = []
    for (doc, _), words in zip(rows, texts, strict=True):
        gone = {j for i in range(len(words) - width + 1) if doc is not None and origin[tuple(words[i : i + width])] < doc for j in range(i, i + width)}
        out.append((doc, len(words), len(gone), " ".join(w for j, w in enumerate(words) if j not in gone)))
    return sorted(out, key=str)


def passage_rows(seed, width, n=60):
    rng, texts = random.Random(seed), []
    for _ in range(n):
        k = rng.choice([1, 2, 3, 30, 5000])
        words = [f"w{rng.randrange(k)}é" for _ in range(rng.randint(0, 4 * width))]
        for _ in range(rng.randint(0, 3)):
            other = rng.choice(texts) if texts else []
            a = rng.randrange(len(other) + 1)
            at = rng.randrange(len(words) + 1)
            words[at:at] = other[a : a + rng.randint(1, 3 * width)] if rng.random() < 0.8 else ["w0é"] * rng.randint(1, 2 * width)
        texts.append(words if rng.random() < 0.8 or not texts else list(rng.choice(texts)))
    return [(i, rng.choice([" ", "  ", "\n"]).join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "width"), [(1, 50), (2, 50), (3, 12), (4, 5), (5, 1)])
def test_passages_as_brute_force(spark, seed, width):
    rows = passage_rows(seed, width)
    rng = random.Random(seed)
    rng.shuffle(rows)
    rows += [(None, rows[0][1]), (None, rows[1][1]), (7, rows[5][1]), (7, rows[5][1]), (2**60 + 1, rows[6][1]), (90, None), (91, ""), (92, " \n ")]
    out = passages.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), width).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, " ".join(slow_words(r.text))) for r in out), key=str) == slow_passages(rows, width)
    assert sum(r.n_removed > 0 for r in out) > 5
    texts = {i: t for i, t in rows}
    assert all(r.text == texts[r.doc_id] for r in out if r.n_removed == 0 and r.doc_id not in (None, 7))


@pytest.mark.parametrize("width", [1, 7, 50])
def test_anchors_follow_from_the_window(width):
    """Equal windows have equal anchors, whatever surrounds them."""
    for seed in range(40):
        hashes = passages.WordHashes(1)
        pieces = [p for p in (hashes.of(passages.words_of(t)) for _, t in passage_rows(seed, width, 8)) if len(p) >= width]
        sizes = np.array([len(p) for p in pieces])
        words, first, owner = np.concatenate(pieces), np.zeros(sizes.sum(), dtype=bool), np.repeat(np.arange(len(pieces)), sizes - width + 1)
        first[np.cumsum(sizes) - sizes] = True
        windows = np.arange(len(owner)) + owner * (width - 1)
        keys, who = passages.anchors(words, first, windows, width)
        seen = {}
        assert (who >= 0).all() and all(seen.setdefault(words[w : w + width].tobytes(), k) == k for w, k in zip(windows.tolist(), keys.tolist(), strict=True))


def test_passages_cut_texts(spark, monkeypatch):
    """Texts that are looked at in several stretches; the small stretch is set in this process and tested in it."""
    monkeypatch.setattr(passages, "STRETCH", 64)
    import pyarrow as pa

    rows = passage_rows(9, 20, 20)
    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "mark": [0] * len(rows), "text": [t for _, t in rows]})
    found = [r for out in passages._anchor_rows(20)(iter([batch])) for r in out.to_pylist()]
    for i, t in rows:
        covered = sorted(w for r in found if r["doc_id"] == i for w in range(r["first"], r["last"] + 1))
        assert covered == list(range(max(0, len(slow_words(t)) - 19)))
    whole = {}
    for r in found:
        words = slow_words(rows[r["doc_id"]][1])
        for w in range(r["first"], r["last"] + 1):
            assert whole.setdefault(tuple(words[w : w + 20]), r["key"]) == r["key"]


def test_passages_hot_passage_and_long_text(spark):
    """A passage in half of the documents, copies by the thousand, and a text of 400,000 words that repeats itself and another."""
    rng = random.Random(6)
    common = " ".join(f"c{i}" for i in range(60))
    rows = [(i, f"a{i} " * 3 + common + f" z{i}" * 3) for i in range(500)] + [(1000 + i, " ".join(f"k{j}" for j in range(90))) for i in range(1500)]
    long_words = [f"q{rng.randrange(9000)}" for _ in range(399_000)]
    rows += [(5000, " ".join(long_words)), (5001, " ".join([*long_words[100_000:300_000], *(["x"] * 1000), *long_words[:30]]))]
    out = {r.doc_id: (r.n_words, r.n_removed) for r in passages.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_words", "n_removed").collect()}
    assert out[0] == (66, 0) and all(out[i] == (66, 60) for i in range(1, 500))
    assert out[1000] == (90, 0) and all(out[i] == (90, 90) for i in range(1001, 2500))
    assert out[5000] == (399_000, 0) and out[5001] == (201_030, 200_000)


def test_passages_odd_tables(spark):
    docs = clashing(spark, ["one two three " * 30, None, "", "one two three " * 30])
    kept_whole(passages.deduplicated(docs), docs)
    assert passages.deduplicated(spark.createDataFrame([], DOCS)).count() == 0


def test_op11_sql(spark):
    same(passages.op11_passages(spark, "/root/testdata/sf0.01"), duck("/root/testdata/sf0.01"), passages.OP11_SQL)
