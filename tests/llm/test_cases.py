"""Repeated, missing and clashing ids and columns, empty tables, long texts, and brute-force versions of whole operators."""

import hashlib
import itertools
import json
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brightloom.llm import bpe, chat, common, embeddings, langid, lines, mixing, pii, simhash, token_counts, topk
from tests.llm.test_llm import DOCS, all_costs, docs_of, groups, slow_print, small_texts

CLASHING = ["row", "of", "doc", "u", "n", "parts", "cdf", "any", "found", "kept", "drops", "lowered", "h", "fp", "component_id", "_source", "_parts", "_cdf", "_u", "_n", "_drops", "_lost_id", "_any", "a.b", "word count"]


def clashing(spark, texts):
    docs = docs_of(spark, texts)
    return docs.select("*", *[F.lit(f"own {x}").alias(x) for x in CLASHING])


def kept_whole(out, docs):
    """Every column of docs is there once, with its own values."""
    assert [c for c in out.columns if c in docs.columns] == docs.columns and len(set(out.columns)) == len(out.columns)
    rows = [r.asDict() for r in out.collect()]
    assert rows and all(r[c] == f"own {c}" for r in rows for c in CLASHING)


STEPS = {
    "mixing": mixing.mixed, "simhash": simhash.deduplicated, "lines": lines.dedup_lines, "pii": pii.pseudonymised, "langid": langid.recognised,
    "langid_predicted": lambda docs: langid.predicted(docs, langid.train(docs)),
    **{f"stage_{name}": (lambda docs, stage=stage: stage(docs.sparkSession, docs, None)) for name, stage in corpus_pipeline.STAGES[:-1]},
}
FINAL = {
    "bpe": bpe.with_token_ids, "simhash_groups": simhash.near_groups, "stage_tokenize": lambda docs: corpus_pipeline.tokenize(docs.sparkSession, docs, None),
    "token_counts": lambda docs: token_counts.bpe_counts(docs),
}


@pytest.mark.parametrize("name", sorted(STEPS))
def test_clashing_columns(spark, name):
    docs = clashing(spark, ["mail ann@example.com or bob@example.com now", "two words or more", "Ein Satz mit Wörtern", None, ""] * 3)
    kept_whole(STEPS[name](docs), docs)


@pytest.mark.parametrize("name", sorted(STEPS | FINAL))
def test_empty_tables(spark, name):
    docs = spark.createDataFrame([], DOCS)
    assert (STEPS | FINAL)[name](docs).count() == 0


def test_empty_vectors_and_conversations(spark, tmp_path):
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_vectors(vectors).count() == 0 and topk.top_k(vectors, vectors).count() == 0
    assert chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    roll = token_counts.TokenRollup(spark, f"file://{tmp_path}/roll")
    nothing = spark.createDataFrame([], "doc_id long, source string, lang string, tokenizer string, n_tokens long")
    assert roll.commit("none", upserts=nothing, deletes=nothing.select("doc_id")) and roll.totals().count() == 0 and roll.compact() is None


def test_near_dedup_repeated_ids(spark):
    a, b = "alpha beta gamma delta epsilon zeta", "one two three four five six seven"
    rows = [(3, a), (5, a), (5, b), (7, b), (9, "else entirely different words here"), (9, "else entirely different words here"), (None, a), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1))
    out = sorted(((r.doc_id, r.text) for r in simhash.deduplicated(docs).collect()), key=str)
    assert out == sorted([(3, a), (5, b), (9, "else entirely different words here"), (None, a), (None, a)], key=str)


def test_near_dedup_one_stays(spark):
    """With ids drawn at random, repeated ones included, each group keeps exactly one row."""
    rng, texts = random.Random(3), [t for t in small_texts() if t][3:]
    rows = [(rng.randrange(25), t) for t in texts * 2]
    prints = [slow_print(t) for _, t in rows]
    root = groups(len(rows), [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if bin(prints[i] ^ prints[j]).count("1") <= 2])
    out = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    least = {g: min(rows[i][0] for i in range(len(rows)) if root[i] == g) for g in root}
    of_text = {t: g for (_, t), g in zip(rows, root, strict=True)}
    assert sorted((of_text[r.text], r.doc_id) for r in out) == sorted(least.items())


def test_components_of_a_hub(spark):
    edges = [(0, i) for i in range(1, 3000)] + [(i, i + 5000) for i in range(1, 300)] + [(9000, 9001)]
    from brightloom.llm.components import connected_components

    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(v == (9000 if k >= 9000 else 0) for k, v in got.items()) and len(got) == 3000 + 299 + 2


def test_manifest(spark, tmp_path):
    one, two = (common.Manifest(spark, f"file://{tmp_path}/m") for _ in range(2))
    assert one.read() == (0, {})
    one.write(0, {"a": [1]})
    with pytest.raises(common.Conflict):
        two.write(0, {"a": [2]})
    assert two.read() == (1, {"a": [1]})
    two.write(1, {"a": [1, 2]})
    assert one.read() == (2, {"a": [1, 2]})


def test_line_runs_reopened(spark, tmp_path):
    path, where = f"file://{tmp_path}/runs", lambda ids: spark.createDataFrame([(i, i % 7, 0) for i in ids], "doc_id long, h1 long, h2 long")
    first = lines.LineRuns(spark, path, fanout=3)
    assert first.add("b0", where(range(5))) and first.add("b1", where(range(4, 9)))
    for name in first.runs():
        spark.sql(f"DROP TABLE {name}")  # as in a new session, whose catalog knows no run
    again = lines.LineRuns(spark, path)
    assert again.fanout == 3 and not again.add("b1", where(range(50))) and again.committed() == ["b0", "b1"]
    new = {name: sorted((r.h1, r.is_new) for r in again._run(name).collect()) for name in again.runs()}
    assert list(new.values()) == [[(h, True) for h in range(5)], [(0, False), (1, False), (4, False), (5, True), (6, True)]]
    assert again.add("b2", where([70, 6, 8])) and len(again.runs()) == 1 and again.add("b3", where([100]))
    ids = [*range(5), *range(4, 9), 70, 6, 8, 100]
    assert {r.h1: (r.n_docs, r.max_doc) for r in again.totals().collect()} == {h: (sum(i % 7 == h for i in ids), max(i for i in ids if i % 7 == h)) for h in range(7)}
    again.drop()
    assert not [t for t in spark.catalog.listTables() if t.name in new]


def test_rollup_conflict_and_compaction(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, source string, lang string, tokenizer string, n_tokens long")
    roll = token_counts.TokenRollup(spark, f"file://{tmp_path}/roll", compact_after=3)
    other = token_counts.TokenRollup(spark, f"file://{tmp_path}/roll")
    roll.commit("b0", upserts=make([(i, "a", "en", "v1", i) for i in range(6)]))
    number, state = other._state()
    folder = other._put(other.signed(make([(1, "a", "en", "v1", 100)]), None))
    roll.commit("b1", upserts=make([(1, "a", "en", "v1", 50)]))
    with pytest.raises(common.Conflict):
        other.manifest.write(number, {"batches": [*state["batches"], "b2"], "folders": [*state["folders"], folder]})
    assert other.commit("b2", upserts=make([(1, "a", "en", "v1", 100)]))
    roll.commit("b3", upserts=make([(7, "a", "en", "v2", 1)]), deletes=spark.createDataFrame([(0,), (2,)], "doc_id long"))
    assert len(roll._state()[1]["folders"]) == 1 and roll.committed() == ["b0", "b1", "b2", "b3"]
    assert sorted(map(tuple, other.totals().collect())) == [("a", "en", "v1", 4, 100 + 3 + 4 + 5), ("a", "en", "v2", 1, 1)]
    assert {r.doc_id for r in other.current().collect()} == {1, 3, 4, 5, 7}


def test_bpe_repeated_ids(spark):
    import public_tokenizers
    import tiktoken

    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.default_ranks()), special_tokens={})
    rows = [(1, "one text"), (1, "another"), (1, None), (None, "no id"), (None, ""), (2**60 + 1, "x" * 3000 + " long" * 50000)]
    out = bpe.with_token_ids(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.decoded.decode(), r.n_tokens) for r in out) == sorted((str(i), t or "", len(codec.encode_ordinary(t or ""))) for i, t in rows)


def test_decode_ids_beside_nulls(spark):
    rows = [(2**60 + 1, "Grüße, 世界"), (None, "no id"), (7, None), (2**60 + 1, "")]
    coded = bpe.with_token_ids(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    out = bpe.decode_ids(coded.select("doc_id", F.when(F.col("doc_id") == 7, None).otherwise(F.col("ids")).alias("ids"))).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted(((i, t or "") for i, t in rows), key=str)


# ---- hot buckets and long texts ----


@pytest.fixture
def no_broadcast(spark):
    """Joins as in large tables: none broadcast, and skew found from a few kB on."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.shuffle.partitions": "20"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(frame):
    frame.write.format("noop").mode("overwrite").save()
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_hot_bucket_is_split(spark, no_broadcast):
    """A bucket with half of the rows: the join with the bucket sizes is a skew join, and any two rows meet."""
    from brightloom.llm.tiles import tiled

    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id") % 5000).alias("key"), F.col("id").alias("spread"), F.sha2(F.col("id").cast("string"), 256).alias("load"))
    out = tiled(rows.repartition(8), ["key"], "spread", 4000)
    assert "SortMergeJoin(skew=true)" in final_plan(out)
    hot = out.where("key = -1").groupBy("left_chunk", "right_chunk").count().collect()
    chunks = 1 + max(r.right_chunk for r in hot)
    assert chunks == 5 and len(hot) == chunks * (chunks + 1) // 2 and max(r["count"] for r in hot) < 9600


def test_simhash_and_embeddings_without_broadcast(spark, no_broadcast):
    texts = [f"some words of a text number {i % 3} that repeats" for i in range(60)] + [f"all other words {i} here {i * 7}" for i in range(20)]
    prints = [slow_print(t) for t in texts]
    root = groups(len(texts), [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if bin(prints[i] ^ prints[j]).count("1") <= 2])
    assert {r.doc_id: r.component_id for r in simhash.near_groups(docs_of(spark, texts)).where("doc_id IS NOT NULL").collect()} == dict(enumerate(root))
    rng = np.random.default_rng(8)
    vectors = np.concatenate([np.repeat(rng.standard_normal((1, 8)), 300, axis=0) + rng.standard_normal((300, 8)) * 0.03, rng.standard_normal((40, 8))])
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")
    unit = vectors.astype(np.float32).astype(np.float64)
    unit /= np.sqrt((unit**2).sum(1))[:, None]
    near = unit @ unit.T >= 0.93
    assert {r.vec_id: r.n_links for r in embeddings.near_vectors(table).collect()} == {i: int(near[i].sum()) - 1 for i in range(len(vectors))}


def test_embeddings_in_double_precision(spark):
    """Two vectors whose cosine reaches the threshold in double precision and not in single, and the other way round."""
    rng, rows, want = np.random.default_rng(12), [], {}
    while len(rows) < 80:
        a = rng.standard_normal(8) * 1000
        b = rng.standard_normal(8)
        b -= a * (a @ b) / (a @ a)
        turn = np.arccos(0.93) + rng.choice([-1, 1]) * 2e-8
        b = a * np.cos(turn) + b / np.sqrt(b @ b) * np.sqrt(a @ a) * np.sin(turn)
        cosine = lambda x, y: x @ y / np.sqrt((x @ x) * (y @ y))
        single = cosine(a.astype(np.float32).astype(float), b.astype(np.float32).astype(float)) >= 0.93
        if single == (cosine(a, b) >= 0.93) or abs(cosine(a, b) - 0.93) < 1e-12:
            continue
        n = len(rows)
        rows += [(n, a.tolist(), n), (n + 1, b.tolist(), n)]
        want |= {n: int(cosine(a, b) >= 0.93), n + 1: int(cosine(a, b) >= 0.93)}
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == want and set(want.values()) == {0, 1}


def test_lines_of_a_very_long_text(spark):
    """100,000 lost lines in each of five texts, in linear time."""
    common = [f"line number {i:07d} which five documents hold in common" for i in range(50_000)]
    texts = ["\n".join(x for line in common for x in (line, line.upper(), f"own {d}"[: d % 2 * 9])) for d in range(5)]
    began = time.monotonic()
    out = {r.doc_id: r for r in lines.dedup_lines(docs_of(spark, texts)).where("doc_id IS NOT NULL").collect()}
    assert time.monotonic() - began < 120
    for d in range(5):
        assert out[d].text_n_lines == 150_000 and out[d].text_n_dropped == (0 if d == 4 else 100_000)
        assert out[d].text == (texts[d] if d == 4 else "\n".join(f"own {d}"[: d % 2 * 9] for _ in common))


def test_pii_of_a_very_long_text(spark):
    """100,000 values in one text, in linear time, equal to the same values in short texts."""
    value = lambda i: f"card 4111 1111 1111 1111, born {1 + i % 28:02d}.{1 + i % 12:02d}.{1900 + i % 180}, host 10.{i % 256}.{i // 256 % 256}.7"
    parts = [value(i) for i in range(33_400)]
    began = time.monotonic()
    whole = pii.pseudonymised(docs_of(spark, ["; ".join(parts)])).where("doc_id = 0").first()
    assert time.monotonic() - began < 120
    few = {r.doc_id: r.text for r in pii.pseudonymised(docs_of(spark, parts[:400])).where("doc_id IS NOT NULL").collect()}
    assert len(whole.pii_kinds) == 100_200 and whole.text.split("; ")[:400] == [few[i] for i in range(400)]


# ---- language ID ----


def slow_predict(model, text):
    grams = langid.trigrams(text).tolist()
    if not grams or not model.langs:
        return langid.UNKNOWN, 0.0
    margin = []
    for column, offset in enumerate(model.offsets):
        margin.append(sum(float(model.weights[g, column]) for g in grams) / len(grams) + float(offset))
    sure = lambda x: 1 / (1 + math.exp(-2 * max(-15.0, min(15.0, x))))
    ones = [(i, m) for i, m in enumerate(model.machines) if m[0] == "family"]
    score, members = 1.0, model.langs
    if len(ones) == 1:
        i, (_, yes, no) = ones[0]
        members, score = (list(yes), sure(margin[i])) if margin[i] > 0 else (list(no), sure(-margin[i]))
    elif ones:
        best, machine = ones[0]
        for i, m in ones:
            if margin[i] > margin[best]:
                best, machine = i, m
        members, score = list(machine[1]), sure(margin[best])
    chances = {x: [] for x in members}
    for i, (kind, yes, no) in enumerate(model.machines):
        if kind == "pair" and yes[0] in chances:
            chances[yes[0]].append(sure(margin[i]))
            chances[no[0]].append(1 - sure(margin[i]))
    lang = sorted(members, key=lambda x: (sum(chances[x]), x))[-1]
    return lang, score * min([1.0, *chances[lang]])


LANGS = {"en": "the of and that with have this from they will", "de": "der die und das nicht mit sich auf ein werden", "nl": "het een van niet zijn voor naar maar heeft wordt", "fr": "les des dans pour pas sur avec une sont mais", "es": "los las una por con para como pero desde hasta", "ru": "это что как его она они было быть если только", "ja": "これは それが です ます から まで ことが もの"}


def labelled(spark, n=40, ids=lambda i: i):
    rng = random.Random(1)
    rows = [(ids(i), " ".join(rng.choices(words.split(), k=12)) + (" junk" * 20000 if i == 3 else ""), lang, "s", 1, "x") for k, (lang, words) in enumerate(LANGS.items()) for i in range(k * n, k * n + n)]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("langs", [("en", "de"), ("en", "fr"), ("en", "de", "nl", "fr"), tuple(LANGS), ("ru",)])
def test_langid_as_loop(spark, langs):
    docs = labelled(spark).where(F.col("lang").isin(*langs))
    model = langid.train(docs)
    texts = [" ".join(random.Random(i).choices(" ".join(LANGS.values()).split(), k=9)) for i in range(60)] + [None, "", "12 34", "x", "the " * 5000]
    out = {r.doc_id: (r.lang_pred, r.lang_score) for r in langid.predicted(docs_of(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        lang, score = slow_predict(model, t)
        assert out[i][0] == lang and abs(out[i][1] - score) < 1e-6, (t, out[i], lang, score)
    right = [r.lang_pred == r.lang for r in langid.predicted(docs, model).collect()]
    assert np.mean(right) > 0.97


def test_langid_sample_is_bounded(spark):
    """Null and repeated ids can't bring all their rows into the sample, and repeated rows count once."""
    many = labelled(spark, 400, ids=lambda i: None).unionByName(spark.createDataFrame([(7, "the same row again", "en", "s", 1, "x")] * 3000, DOCS))
    seen = []
    fit = langid._fit
    try:
        langid._fit = lambda rows: seen.append(len(rows)) or fit(rows)
        one = langid.train(many, per_language=50)
        two = langid.train(many.repartition(11), per_language=50)
    finally:
        langid._fit = fit
    assert (one.weights == two.weights).all() and one.langs == sorted(LANGS)
    n = many.where("lang = 'fr'").count()
    assert n == 400 and np.abs(one.weights).sum() > 0


def test_langid_too_many_languages(spark):
    docs = spark.range(langid.MAX_LANGUAGES * 2).selectExpr("id AS doc_id", "'some text' AS text", "concat('l', id) AS lang")
    with pytest.raises(ValueError):
        langid.train(docs)


# ---- personal data ----


def slow_noise(kind, turn, value):
    return int(hashlib.sha256(f"{pii.KEY}:{kind}:{turn}:{value}".encode()).hexdigest()[:15], 16)


def slow_pair(left, right, a, b, kind):
    for turn in range(1, 9):
        if turn % 2:
            left = (left + slow_noise(kind, turn, right)) % a
        else:
            right = (right + slow_noise(kind, turn, left)) % b
    return left, right


def slow_text(text, kind):
    left, right = text[: len(text) // 2], text[len(text) // 2 :]
    for turn in range(1, 9):
        stream, added = hashlib.sha512(f"{pii.KEY}:{kind}:{turn}:{right}".encode()).hexdigest(), ""
        for i, c in enumerate(left):
            by = int(stream[i * 4 : i * 4 + 4], 16)
            base, n = next(((b, n) for b, n, s in ((48, 10, "0123456789"), (97, 26, "abcdefghijklmnopqrstuvwxyz"), (65, 26, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) if c in s), (0, 0))
            added += chr((ord(c) - base + by) % n + base) if n else c
        left, right = right, added
    return left + right


def slow_luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10


def slow_fill(shape, chars):
    it = iter(chars)
    return "".join(next(it) if c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in shape)


def slow_97(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def slow_value(kind, m):
    """The pseudonym of a value, or None if it is not valid."""
    import datetime as dt

    digits = "".join(c for c in m if c in "0123456789")
    if kind == "email":
        name, rest = m.split("@", 1)
        return slow_text(name, "email") + "@" + rest
    if kind == "iban":
        plain = m.replace(" ", "")
        if not 15 <= len(plain) <= 34 or slow_97(plain) != 1:
            return None
        account = slow_text(plain[4:], "iban")
        return slow_fill(m, plain[:2] + f"{98 - slow_97(plain[:2] + '00' + account):02d}" + account)
    if kind == "card":
        if not 13 <= len(digits) <= 19 or slow_luhn(digits) or not digits.strip("0"):
            return None
        body = digits[0] + slow_text(digits[1:-1], "card")
        return slow_fill(m, next(body + c for c in "0123456789" if slow_luhn(body + c) == 0))
    if kind == "ssn":
        area, group, serial = map(int, m.split("-"))
        if not 1 <= area <= 899 or area == 666 or not group or not serial:
            return None
        left, right = slow_pair((area - 1 - (area > 666)) * 99 + group - 1, serial - 1, 898 * 99, 9999, "ssn")
        new = left // 99 + 1
        return f"{new + (new >= 666):03d}-{left % 99 + 1:02d}-{right + 1:04d}"
    if kind == "date":
        form = "%Y-%m-%d" if m[4] == "-" else "%d.%m.%Y" if "." in m else "%m/%d/%Y"
        try:
            number = (dt.datetime.strptime(m, form).date() - dt.date(1900, 1, 1)).days
        except ValueError:
            return None
        if not 0 <= number < 73_049:
            return None
        left, right = slow_pair(number // 229, number % 229, 319, 229, "date")
        return (dt.date(1900, 1, 1) + dt.timedelta(left * 229 + right)).strftime(form)
    if kind == "ipv4":
        o = list(map(int, m.split(".")))
        if max(o) > 255:
            return None
        left, right = slow_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ipv4")
        return ".".join(str(x) for h in (left, right) for x in divmod(h, 256))
    if kind == "phone":
        area, exchange, line = int(digits[-10:-7]), int(digits[-7:-4]), int(digits[-4:])
        if area < 200 or exchange < 200:
            return None
        left, right = slow_pair((area - 200) * 800 + exchange - 200, line, 640_000, 10_000, "phone")
        return slow_fill(m, ("1" if len(digits) == 11 else "") + f"{left // 800 + 200:03d}{left % 800 + 200:03d}{right:04d}")
    return slow_fill(m, digits[:2] + slow_text(digits[2:], "intl")) if 8 <= len(digits) <= 15 else None


def slow_pseudonymised(text):
    """Every place in turn, every kind in order, every length from the longest."""
    shapes = {k: re.compile(v.replace("(?<sep>", "(?P<sep>").replace(r"\k<sep>", "(?P=sep)")) for k, v in pii.KINDS.items()}
    borders = {k: tuple(map(re.compile, v)) for k, v in pii.BORDERS.items()}
    out, kinds, at = [], [], 0
    while at < len(text):
        found = shapes["email"].match(text, at)
        value = found and found[0]
        for kind in list(pii.KINDS)[1:] if not value else []:
            before, after = borders[kind]
            ends = range(min(len(text), at + 60), at + 6, -1) if before.match(text, at) and text[at] in "+(0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ" else ()
            value = next((text[at:e] for e in ends if after.match(text, e) and shapes[kind].fullmatch(text[at:e]) and slow_value(kind, text[at:e])), None)
            if value:
                break
        if not value:
            out.append(text[at])
            at += 1
            continue
        kind = next(k for k in pii.KINDS if shapes[k].fullmatch(value) and slow_value(k, value))
        out.append(slow_value(kind, value))
        kinds.append(kind)
        at += len(value)
    return "".join(out), kinds


def test_pii_as_brute_force(spark):
    rng = random.Random(5)
    values = ["ann.lee@example.com", ".ann.lee@example.com", "-bob@mail.example.org,", "_x1@a-b.co", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "4111 1111 1111 1112", "378282246310005", "3782 822463 10005", "0000000000000000", "123-45-6789", "666-12-3456", "899-99-9999", "1985-02-28", "28.02.1985", "02/28/1985", "2021-02-30", "1899-12-31", "2099-12-31", "10.0.0.255", "10.0.0.256", "(212) 555-0100", "+1 212-555-0100", "212.555.0100", "112-555-0100", "+49 30 12345678", "+4915112345678", "+49 30 1234 5678 12345 6789", "DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "ES9121000418450200051332", "ES91 2100 0418 4502 0005 1332", "AT611904300234573201", "AT61 1904 3002 3457 3202", "NOW", "OK", "EUR", "A1", "2024", "42", "word", "naïve", "é", "中", "\n", "x@y", "@", "1.2.3", "99-99"]
    texts = [" ".join(rng.choices(values, k=rng.randint(1, 8))) for _ in range(150)] + ["".join(rng.choices([*values, " ", ",", ";"], k=5)) for _ in range(60)]
    texts += [*values, "pay ES9121000418450200051332 NOW", "pay ES91 2100 0418 4502 0005 1332 OK", "a" * 70 + "@example.com", "word " * 30000 + "ann@example.com " + "5" * 5000]
    out = {r.doc_id: (r.text, r.pii_kinds) for r in pii.pseudonymised(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts[:-1]):
        assert out[i] == slow_pseudonymised(t), t
    assert "ann@example.com" not in out[len(texts) - 1][0] and out[len(texts) - 1][0].endswith("5" * 5000)
    assert "lee" not in out[211][0] and out[211][1] == ["email"]


# ---- embeddings and search ----


@pytest.mark.parametrize(("bits", "tile"), [(3, 64), (8, 64), (8, 2000)])
def test_embedding_recall(spark, monkeypatch, bits, tile):
    """Against all pairs, with more bits than the small table needs and with buckets split into tiles."""
    rng = np.random.default_rng(9)
    base = rng.standard_normal((60, 24))
    vectors = np.concatenate([base + rng.standard_normal(base.shape) * s for s in (0, 0.1, 0.2, 0.25, 0.3)] + [np.repeat(base[:1], 150, axis=0) + rng.standard_normal((150, 24)) * 0.05])
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")
    unit = vectors.astype(np.float32).astype(np.float64)
    unit /= np.sqrt((unit**2).sum(1))[:, None]
    near = unit @ unit.T >= 0.93
    np.fill_diagonal(near, False)
    meet = (1 - math.acos(0.93) / math.pi) ** bits
    monkeypatch.setattr(embeddings, "shape_of", lambda *_: (bits, math.ceil(math.log(1 - 0.9999) / math.log(1 - meet))))
    tiled_links = embeddings.link_tiles
    monkeypatch.setattr(embeddings, "link_tiles", lambda classes, threshold, recall: tiled_links(classes, threshold, recall, tile=tile))
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(table).collect()}
    found, all_links = sum(got.values()), int(near.sum())
    assert all(got[i] <= near[i].sum() for i in range(len(vectors))) and found >= 0.999 * all_links > 20000, (found, all_links)


def best_of(rows, asked, mine, k=5):
    """(score, vec_id) of the k best candidates, in Python's integers."""
    q = [math.floor(256 * x) for x in asked]
    scored = [(-sum(math.floor(256 * x) * b for x, b in zip(v, q, strict=True)), i) for i, v in rows if i is not None and i != mine and len(v) == len(q)]
    return [(-s, i) for s, i in sorted(scored)[:k]]


def test_topk_repeated_rows(spark):
    rng = np.random.default_rng(2)
    vectors = np.round(rng.standard_normal((80, 5)), 1)
    rows = [(i % 40, v.tolist()) for i, v in enumerate(vectors)] + [(None, [1.0] * 5), (42, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(table, table.where("vec_id = 3"), shard_rows=7).orderBy("rank").collect()
    assert [(r.score, r.vec_id) for r in got] == best_of(rows, min(v for i, v in rows if i == 3), 3) and [r.rank for r in got] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("size", [2e4, 2e5, 1.4e6])
def test_topk_large_components(spark, size):
    """Scores beyond the exact doubles, up to the end of the longs: 2^53 < 64 * (256 * size)^2 < 2^63, sums included."""
    rng = np.random.default_rng(3)
    rows = [(i, (np.floor(v * size * 256) / 256 + 1 / 512).tolist()) for i, v in enumerate(rng.uniform(-1, 1, (60, 64)))] + [(90, [size] * 64), (91, [size - 1 / 256] * 64), (92, [size] * 63 + [-size])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(table, table.where("vec_id IN (3, 90)"), shard_rows=11).orderBy("query_id", "rank").collect()
    for mine in (3, 90):
        assert [(r.score, r.vec_id) for r in got if r.query_id == mine] == best_of(rows, dict(rows)[mine], mine)


def test_topk_tiers():
    exact = lambda a, b: [[sum(map(int.__mul__, map(int, x), map(int, y))) for y in b] for x in a]
    big = [[2.0**40, 3.0, -(2.0**31)], [2.0**22, 2.0**22, 1.0], [1.0, -1.0, 2.0**31]]
    small = [[2.0**22, 1.0, 5.0], [-(2.0**22), 7.0, 1.0]]
    for a, b in ((small, small), (big, small), (small, big)):
        assert topk.inner_products(np.array(a), np.array(b)).tolist() == exact(a, b)
    edge = [[2.0**62, 2.0**62, 1.0]]
    assert topk.inner_products(np.array(edge), np.array([[1.0, 0.0, -7.0], [-1.0, -1.0, 0.0]])).tolist() == [[2**62 - 7, -(2**63)]]
    with pytest.raises(OverflowError):
        topk.inner_products(np.array(edge), np.array([[1.0, 1.0, 0.0]]))


def test_embeddings_repeated_ids(spark):
    """Rows that repeat a vec_id are vectors of their own, also under another label."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal((12, 6))
    rows = [(int(rng.integers(6)), (base[int(rng.integers(12))] + rng.standard_normal(6) * s).tolist(), int(rng.integers(2))) for s in (0, 0, 0.1, 0.3) for _ in range(20)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    unit = np.array([v for _, v, _ in rows], dtype=np.float32).astype(np.float64)
    cos = unit @ unit.T / np.sqrt((unit**2).sum(1))[:, None] / np.sqrt((unit**2).sum(1))[None, :]
    linked = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if rows[i][2] == rows[j][2] and cos[i, j] >= 0.93]
    root, count = groups(len(rows), linked), Counter(itertools.chain(*linked))
    least = {g: min(rows[i][0] for i in range(len(rows)) if root[i] == g) for g in root}
    want = sorted((r[0], count[i], least[root[i]], r[0] == least[root[i]]) for i, r in enumerate(rows))
    assert sorted(map(tuple, embeddings.near_vectors(table).collect())) == want


# ---- chat ----


def cost_of(actions):
    return sum({"keep": 0, "merge": chat.MERGE, "relabel": chat.RELABEL, "insert": chat.INSERT, "append": chat.INSERT}[x] for a in actions for x in a.split(","))


def test_chat_output_costs(spark):
    """The decoded repairs of all short conversations cost no more than the cheapest one."""
    names, rng = ["odd", "system", "user", "assistant"], random.Random(1)
    all_roles = [r for n in (1, 2, 3) for r in itertools.product(range(4), repeat=n)] + [tuple(rng.choices(range(4), k=rng.choice((4, 5)))) for _ in range(120)]
    rows = [(c, t, names[r], f"t{t}") for c, roles in enumerate(all_roles) for t, r in enumerate(roles)]
    out = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    by = {}
    for r in sorted(out, key=lambda r: r.position):
        by.setdefault(r.conv_id, []).append(r)
    assert all([r.position for r in v] == list(range(len(v))) for v in by.values())
    for c, roles in enumerate(all_roles):
        assert cost_of([r.action for r in by[c]]) == all_costs(roles), roles


def test_chat_cuts():
    """However a conversation is cut into blocks, and these into levels, its repair costs the same."""
    rng = random.Random(4)
    for _ in range(40):
        roles = rng.choices(range(4), k=13)
        best = int((chat.block_matrix(roles)[0] + chat.END).min())
        for size in (1, 2, 5, 13):
            cuts = [roles[i : i + size] for i in range(0, 13, size)]
            matrices = [chat.block_matrix(c) for c in cuts]
            assert (chat.composed(matrices) == chat.block_matrix(roles)).all()
            enter, cost = chat.START, 0
            for c, (before, after) in zip(cuts, chat.boundaries(matrices), strict=True):
                assert before == enter
                for role, now in zip(c, chat.best_path(c, before, after), strict=True):
                    cost += int(chat.STEPS[role][enter, now])
                    enter = now
            assert cost + int(chat.END[enter]) == best


def test_chat_levels(spark):
    rng = random.Random(7)
    roles = [rng.choices(range(4), k=3) for _ in range(37)]
    matrices = [chat.block_matrix(r) for r in roles]
    table = spark.createDataFrame([("c", i, m.ravel().tolist()) for i, m in enumerate(matrices)] + [("one", 0, matrices[0].ravel().tolist())], "conv string, block long, matrix array<long>")
    best = int((chat.composed(matrices)[0] + chat.END).min())
    for bits in (1, 2, 10):
        ends = sorted((r.block, r.enter, r.leave) for r in chat.block_ends(table, bits).collect())
        assert [e[0] for e in ends] == list(range(37)) and ends[0][1] == chat.START and ends[-1][2] == -1
        assert all(a[2] == b[1] for a, b in itertools.pairwise(ends))
        cost = sum(int(m[e, a]) for m, (_, e, a) in zip(matrices[:-1], ends[:-1], strict=True))
        assert cost + int((matrices[-1][ends[-1][1]] + chat.END).min()) == best


def test_chat_is_stable(spark):
    """The same repair and positions at 1, 7 and 90 partitions, with a conversation that spans them and null ids."""
    rng = random.Random(8)
    rows = [(c if c else None, t, rng.choice(["user", "assistant", "system", "tool", None]), "x") for c in range(30) for t in range(rng.randint(1, 40))]
    rows += [(2**60 + 1, t, rng.choice(["user", "assistant", "tool"]), "hot") for t in range(2500)]
    rows += [(5, 3, "user", "x")] * 3
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (1, 7, 90):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            found.append(sorted(map(str, chat.formatted(table.repartition(n)).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(found[0]) == len(rows) and found[0] == found[1] == found[2] and any(str(2**60 + 1) in r for r in found[0])


# ---- the pipeline ----


def slow_line_dedup(rows):
    key = lambda x: re.sub(r"^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+$", "", x).translate({c: c + 32 for c in range(65, 91)})
    holders = {}
    for i, t in rows.items():
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(i)
    return {i: "\n".join(x for x in (t or "").split("\n") if len(holders.get(key(x), ())) < 5 or max(holders[key(x)]) == i) for i, t in rows.items()}


def slow_copies(rows, source_of):
    counts = Counter(source_of[i] for i in rows)
    raw = {s: n**0.5 for s, n in counts.items()}
    out = Counter()
    for i in rows:
        mean = raw[source_of[i]] / sum(raw.values()) * len(rows) / counts[source_of[i]]
        u, p, k = int(hashlib.md5(f"mix-1:0:{i}".encode()).hexdigest()[:13], 16) / 2**52, math.exp(-mean), 0
        total = p
        while total <= u:
            k += 1
            p *= mean / k
            total += p
        out[i] = k
    return out


def test_pipeline_as_brute_force(spark, data):
    import public_tokenizers
    import tiktoken

    docs = {r.doc_id: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    model = langid.train(spark.read.parquet(f"{data}/documents.parquet"))
    told = {i: slow_predict(model, r.text)[0] for i, r in docs.items()}
    texts = slow_line_dedup({i: r.text for i, r in docs.items() if told[i] != "und"})
    ids = sorted(texts)
    prints = [slow_print(texts[i]) for i in ids]
    root = groups(len(ids), [(a, b) for a, b in itertools.combinations(range(len(ids)), 2) if bin(prints[a] ^ prints[b]).count("1") <= 2])
    copies = slow_copies([i for n, i in enumerate(ids) if root[n] == n], {i: r.source for i, r in docs.items()})
    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.default_ranks()), special_tokens={})
    want = []
    for i, k in copies.items():
        found = np.array(codec.encode_ordinary(texts[i]), dtype="<u4")
        want += [(i, told[i], docs[i].source, len(found), hashlib.sha256(found.tobytes()).hexdigest(), hashlib.sha256(texts[i].encode()).hexdigest())] * k
    got = corpus_pipeline.run(spark, data).select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and len(got) > 50


def test_pipeline_uses_the_prediction(spark):
    docs = labelled(spark).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.col("lang")))
    out = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, docs, None).collect()}
    truth = {r.doc_id: r.lang for r in labelled(spark).collect()}
    assert len(out) == len(truth) and np.mean([out[i] == truth[i] for i in out]) > 0.97


def test_json_state_is_small(spark, tmp_path):
    path = f"{tmp_path}/m"
    common.Manifest(spark, f"file://{path}").write(0, {"x": 1})
    assert json.loads(open(f"{path}/commits/{1:012d}.json").read()) == {"x": 1}
