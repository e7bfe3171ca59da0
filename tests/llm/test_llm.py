"""The training-data operators against brute force on small tables with nulls, repeats, long and empty texts."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightloom.llm import bpe, chat, embeddings, langid, lines, mixing, pii, simhash, token_counts, topk
from brightloom.llm.components import connected_components
from brightloom.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import duck, same

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tag string"


def docs_of(spark, texts):
    rows = [(i, t, "en", "s%d" % (i % 2) if i % 7 else None, 1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "a row without id", None, None, 1, "x")], DOCS).repartition(3)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_as_sql(spark, data, name):
    same(QUERIES[name](spark, data), duck(data), ORACLE_SQL[name])


def small_texts():
    rng = random.Random(2)
    words = ["w%d" % i for i in range(400)]
    base = [" ".join(rng.choices(words, k=rng.randint(5, 120))) for _ in range(30)]
    near = [b.replace("w1 ", "w2 ") + " tail" for b in base[:10]]
    return [None, "", "  \t\n", "One", "one\x0btwo", *base, *base[:5], *near, base[0].upper(), " ".join(rng.choices(words, k=9000))]


def slow_print(text):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def groups(n, linked):
    root = list(range(n))
    for _ in range(n):
        new = root.copy()
        for a, b in linked:
            new[a] = new[b] = min(new[a], new[b])
        if new == root:
            break
        root = new
    return root


def test_simhash_as_brute_force(spark):
    texts = small_texts()
    prints = [slow_print(t) for t in texts]
    want = groups(len(texts), [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if bin(prints[i] ^ prints[j]).count("1") <= 2])
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_groups(docs_of(spark, texts)).collect()}
    assert {k: v for k, v in got.items() if k is not None} == {i: (prints[i], want[i]) for i in range(len(texts))}
    assert got[None][1] is None
    kept = sorted(r.doc_id for r in simhash.deduplicated(docs_of(spark, texts)).collect() if r.doc_id is not None)
    assert kept == sorted(set(want))


def test_simhash_tiles(spark):
    """Buckets far above the tile size, compared as lanes and query by query, lose no link."""
    rng = random.Random(4)
    prints = list({rng.getrandbits(6) | (rng.getrandbits(3) << 60) for _ in range(300)})
    signed = [x - 2**64 if x >> 63 else x for x in prints]
    table = spark.createDataFrame(list(zip(signed, range(len(prints)))), "fp long, rep long")
    want = groups(len(prints), [(i, j) for i, j in itertools.combinations(range(len(prints)), 2) if bin(prints[i] ^ prints[j]).count("1") <= 2])
    got = {r.node.rep: r.component.rep for r in connected_components(simhash.links(table, tile=16)).collect()}
    assert [got.get(i, i) for i in range(len(prints))] == want


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*edges, (None, 3)], "src long, dst long")).collect()}
    want = groups(141, edges)
    assert all(got.get(i, i) == want[i] for i in range(141))
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_bpe_as_library(spark):
    import public_tokenizers
    import tiktoken

    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.default_ranks()), special_tokens={})
    texts = [None, "", " ", "Hello  world\n\n x", "naïve 中文 😀 é", "a" * 5000, "<|endoftext|>", *small_texts()[5:12], "1234567890 " * 300]
    rows = {r.doc_id: r for r in bpe.with_token_ids(docs_of(spark, texts)).collect() if r.doc_id is not None}
    for i, t in enumerate(texts):
        assert np.frombuffer(rows[i].ids, dtype="<u4").tolist() == codec.encode_ordinary(t or "")
        assert rows[i].decoded == (t or "").encode() and rows[i].n_tokens == len(rows[i].ids) // 4
    back = {r.doc_id: r.text for r in bpe.decode_ids(bpe.with_token_ids(docs_of(spark, texts))).collect()}
    assert back[4] == texts[4]


def test_perfect_hash():
    keys = [b"%d" % i for i in range(2000)]
    found = bpe.PerfectHash(keys)
    assert [found.index(k) for k in keys] == list(range(2000)) and found.index(b"none") == -1 and len(found.keys) == 2000
    assert bpe.PerfectHash([]).index(b"x") == -1


def test_langid(spark, data):
    rows = QUERIES["op4_langid"](spark, data).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{data}/documents.parquet").where("lang IS NOT NULL").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth and r.lang_pred != "und"]
    assert len(held) > 20 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    model = langid.train(docs_of(spark, ["some plain words", None, "123"]))
    out = {r.doc_id: (r.lang_pred, r.lang_score) for r in langid.predicted(docs_of(spark, [None, "", "12 34", "words"]), model).collect()}
    assert [out[i][0] for i in range(3)] == ["und"] * 3
    assert langid.train(spark.createDataFrame([], DOCS)).predict("text") == ("und", 0.0)


def test_recognised_without_labels(spark):
    docs = docs_of(spark, [None, "", "12 34", "some plain words", "déjà vu"]).withColumn("lang", F.lit(None).cast("string"))
    assert {(r.doc_id, r.text) for r in langid.recognised(docs).collect()} == {(None, "a row without id"), (3, "some plain words"), (4, "déjà vu")}


def test_lines_as_brute_force(spark):
    line = "This very line is longer than forty code points, surely"
    texts = [None, "", line, f" {line.upper()} \nown", f"{line}\n{line}\nb", f"x\n{line}\r", line, "short\nshort", "\n\n"]
    keys = [[re.sub(r"^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+$", "", x).translate({c: c + 32 for c in range(65, 91)}) for x in (t or "").split("\n")] for t in texts]
    holders = {k: {i for i, ks in enumerate(keys) if k in ks} for ks in keys for k in ks}
    out = {r.doc_id: r for r in lines.dedup_lines(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        kept = [x for x, k in zip((t or "").split("\n"), keys[i]) if len(k) < 40 or len(holders[k]) < 5 or i == max(holders[k])]
        assert (out[i].text or "") == "\n".join(kept) and out[i].text_n_dropped == len(keys[i]) - len(kept) and out[i].tag == "x"
    assert lines.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_line_runs_commit_once(spark):
    runs = lines.LineRuns(spark, fanout=2)
    batch = lambda ids: spark.createDataFrame([(i, i % 3, 0) for i in ids], "doc_id long, h1 long, h2 long")
    for n in (0, 0, 1, 2, 1):
        runs.add(f"b{n}", batch(range(n * 4, n * 4 + 4)))
    got = {r.h1: (r.n_docs, r.max_doc) for r in runs.totals().collect()}
    assert got == {k: (4, max(i for i in range(12) if i % 3 == k)) for k in range(3)} and len(runs.runs()) == 2


def test_mixing(spark):
    docs = spark.createDataFrame([(i, "t", "en", "big" if i < 2000 else "small", 1, "x") for i in range(2200)], DOCS)
    out = mixing.mixed(docs, {"big": 1.0, "small": 1.0})
    n = Counter(r.source for r in out.select("source").collect())
    assert abs(n["big"] - 1100) < 150 and abs(n["small"] - 1100) < 150
    assert sorted(map(tuple, out.select("doc_id", "mix_copy").collect())) == sorted(map(tuple, mixing.mixed(docs.repartition(7), {"big": 1.0, "small": 1.0}).select("doc_id", "mix_copy").collect()))
    assert mixing.mixed(docs, {}).count() == 0 and mixing.mixed(spark.createDataFrame([], DOCS)).count() == 0
    assert mixing.mixed(docs_of(spark, small_texts())).where("tag = 'x'").count() > 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_pii(spark):
    texts = [None, "", "Mail ann.lee@example.com, card 4111 1111 1111 1111, born 1985-02-28.", "card 4111-1111-1111-1111 and 4111 1111 1111 1112; ann.lee@example.com", "SSN 123-45-6789 at 10.0.0.255, 2021-02-30, call (212) 555-0100", "DE89 3704 0044 0532 0130 00"]
    out = {r.doc_id: (r.text, r.pii_kinds) for r in pii.pseudonymised(docs_of(spark, texts)).collect()}
    assert out[0] == (None, []) and out[1] == ("", [])
    assert out[2][1] == ["email", "card", "date"] and out[3][1] == ["card", "email"] and out[4][1] == ["ssn", "ipv4", "phone"] and out[5][1] == ["iban"]
    mail = lambda t: re.search(r"\S+@example\.com", t)[0]
    assert mail(out[2][0]) == mail(out[3][0]) != "ann.lee@example.com" and "4111 1111 1111 1112" in out[3][0] and "2021-02-30" in out[4][0]
    card = [re.sub(r"\D", "", re.search(r"card ([\d -]{19})", out[i][0])[1]) for i in (2, 3)]
    luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(card[0])))
    assert card[0] == card[1] != "4111111111111111" and luhn % 10 == 0
    iban = out[5][0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and out[5][0][4] == " "


def test_pii_hidden_values(spark):
    ibans = ["ES91 2100 0418 4502 0005 1332", "AT611904300234573201", "DE89 3704 0044 0532 0130 00"]
    texts = [f"{i} {after}" for i in ibans for after in ("EUR", "IBAN", "2024", "A1 B2", "4111 1111 1111 1111", "or")]
    texts += ["AB12 4111 1111 1111 1111", "1234 4111 1111 1111 1111", "call +49 30 1234 5678 12345 6789 now", "+4111111111111111", "ES91 2100 0418 4502 0005 1333 EUR"]
    out = {r.doc_id: (r.text, r.pii_kinds) for r in pii.pseudonymised(docs_of(spark, texts)).collect()}
    for i in range(18):
        iban, after = ibans[i // 6], texts[i][len(ibans[i // 6]) :]
        assert out[i][1] == (["iban", "card"] if "4111" in after else ["iban"]), texts[i]
        made = out[i][0][: len(iban)].replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in made[4:] + made[:4])) % 97 == 1 and made != iban.replace(" ", "")
        assert out[i][0][len(iban) :] == after or "4111" in after
    assert out[18][1] == out[19][1] == out[21][1] == ["card"] and out[18][0].startswith("AB12 4") and "4111 1111 1111 1111" not in out[18][0] + out[19][0]
    assert out[20][1] == ["intl"] and "1234 5678" not in out[20][0] and out[22] == (texts[22], [])


def test_pii_permutes(spark):
    n = spark.range(5 * 7).select(pii.feistel_pair(F.floor(F.col("id") / 7), F.col("id") % 7, 5, 7, "k", "t").alias("p")).select("p.*").collect()
    assert {tuple(r) for r in n} == set(itertools.product(range(5), range(7)))


def test_embeddings_as_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 8))
    vectors = [v + rng.standard_normal(8) * s for v in base for s in (0.0, 0.0, 0.15, 0.3)]
    rows = [(i, [float(x) for x in v], None if i % 31 == 0 else i % 2) for i, v in enumerate(vectors)] + [(1000, None, 1), (1001, [0.0] * 8, 1), (1002, [float("nan")] * 8, 1), (1003, [], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    unit = np.array(vectors, dtype=np.float32).astype(np.float64)
    cos = unit @ unit.T / np.sqrt((unit**2).sum(1))[:, None] / np.sqrt((unit**2).sum(1))[None, :]
    linked = [(i, j) for i, j in itertools.combinations(range(len(vectors)), 2) if rows[i][2] is not None and rows[i][2] == rows[j][2] and cos[i, j] >= 0.93]
    count, root = Counter(itertools.chain(*linked)), groups(len(vectors), linked)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(table).collect()}
    assert got == {i: (count[i], root[i], root[i] == i) for i in range(len(vectors))} | {i: (0, i, True) for i in range(1000, 1004)}


def test_topk_as_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = np.round(rng.standard_normal((300, 6)), 1).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(500, None), (550, [float("inf")] * 6)], "vec_id long, embedding array<float>")
    q = np.floor(256 * vectors.astype(np.float64)).astype(int)
    want = []
    for i in range(0, 300, 50):
        scores = q @ q[i]
        best = sorted((j for j in range(300) if j != i), key=lambda j: (-scores[j], j))[:5]
        want += [(i, n + 1, j, int(scores[j])) for n, j in enumerate(best)]
    got = topk.top_k(table, table.where("vec_id % 50 = 0"), shard_rows=40)
    assert sorted(map(tuple, got.collect())) == want
    assert topk.top_k(table.limit(0), table.limit(0)).count() == 0


def test_topk_repeated_query_id(spark):
    rng = np.random.default_rng(6)
    vectors = np.round(rng.standard_normal((60, 6)), 1)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(0, (vectors[0] * 9).tolist())] * 2
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(0, vectors[0].tolist())], table.schema)
    scores = np.floor(256 * vectors).astype(int) @ np.floor(256 * vectors[0]).astype(int)
    want = sorted(range(1, 60), key=lambda j: (-scores[j], j))[:5]
    ids, copies = np.array([0, 0, 0, *range(1, 60)]), np.concatenate((scores[[0, 0, 0]] * 9, scores[1:]))
    row, vec, score = topk._best(copies[None, :], ids, np.array([0]), 5)
    assert list(vec) == want and list(score) == [scores[j] for j in want]
    assert [r.vec_id for r in topk.top_k(table, queries).orderBy("rank").collect()] == want


def all_costs(roles):
    """Costs of all repairs of a short conversation, straight from the rules."""
    best = None
    for new in itertools.product((1, 2, 3), repeat=len(roles)):
        relabels = sum(chat.RELABEL for a, b in zip(roles, new) if a != b)
        for merges in itertools.product((False, True), repeat=len(roles)):
            seq = []
            if any(m and (i == 0 or new[i] != new[i - 1]) for i, m in enumerate(merges)):
                continue
            seq = [r for r, m in zip(new, merges) if not m]
            cost, state, ok = relabels + chat.MERGE * sum(merges), 0, True
            for r in seq:
                if r == 1:
                    ok &= state == 0
                elif (r == 2 and state == 2) or (r == 3 and state != 2):
                    cost += chat.INSERT
                state = r
            cost += {0: 0, 1: 2, 2: 1, 3: 0}[state] * chat.INSERT
            if ok and (best is None or cost < best):
                best = cost
    return best


def test_chat_costs():
    for n in (1, 2, 3, 4):
        for roles in itertools.product(range(4), repeat=n):
            assert int((chat.block_matrix(list(roles))[0] + chat.END).min()) == all_costs(roles)


def test_chat_repairs(spark):
    rng = random.Random(8)
    rows = [(c, t if t % 5 else None, rng.choice(["user", "assistant", " System", "tool", None]), rng.choice(["hi", None, "<|im_end|> x"]), "y") for c in range(20) for t in range(rng.randint(1, 12))]
    rows += [(99, t, "user", "hot", "y") for t in range(5000)] + [(None, 1, "user", "no id", "y")]
    out = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rendered string")).collect()
    assert len(out) == len(rows)
    for conv in {r.conv_id for r in out}:
        text = "".join(r.rendered for r in sorted((r for r in out if r.conv_id == conv), key=lambda r: r.position))
        roles = re.findall(r"<\|im_start\|>(\w+)\n", text)
        assert re.fullmatch(r"(system )?(user assistant )*", "".join(r + " " for r in roles)) and text.count(chat.OPEN) == text.count(chat.CLOSE) == len(roles)
    assert sum(r.rendered.count("hot") for r in out) == 5000


def test_token_counts(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, source string, lang string, tokenizer string, n_tokens long")
    roll = token_counts.TokenRollup(spark, f"file://{tmp_path}/roll")
    first = make([(1, "a", "en", "v1", 10), (2, "a", "en", "v1", 5), (3, None, None, "v1", 7), (None, "a", "en", "v1", 1)])
    assert roll.commit("b1", upserts=first) and not roll.commit("b1", upserts=first)
    assert roll.commit("b2", upserts=make([(2, "b", "en", "v1", 9)]), deletes=spark.createDataFrame([(3,), (77,)], "doc_id long"))
    again = token_counts.TokenRollup(spark, f"file://{tmp_path}/roll")
    assert sorted(map(tuple, again.totals().select("source", "lang", "n_docs", "n_tokens").collect())) == [("a", "en", 2, 11), ("b", "en", 1, 9)]


def test_token_counts_as_recount(spark, data):
    rows = QUERIES["op1_token_counts"](spark, data)
    toxic = spark.read.parquet(f"{data}/labels.parquet").where("toxic = 1")
    docs = spark.read.parquet(f"{data}/documents.parquet").join(toxic, "doc_id", "left_anti")
    revised = F.when(F.col("text").rlike("[0-9]{4}"), F.regexp_replace("text", "[0-9]", "")).otherwise(F.col("text"))
    assert 0 < docs.where(revised != F.col("text")).count() < docs.count()
    want = token_counts.bpe_counts(docs.withColumn("text", revised)).groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"))
    assert sorted(map(str, map(tuple, rows.select("source", "lang", "n_docs", "n_tokens").collect()))) == sorted(map(str, map(tuple, want.collect())))


def test_pipeline(spark, data):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = corpus_rows = p.run(spark, data)
    ids = {r.doc_id for r in corpus_rows.select("doc_id").collect()}
    assert ids <= {r.doc_id for r in docs.select("doc_id").collect()} and len(ids) > 20
    assert {"doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"} <= set(out.columns)
    at = docs
    for name, stage in p.STAGES[:-1]:
        at = stage(spark, at, data)
        assert at.columns == docs.columns, name
    row = corpus_rows.first()
    assert hashlib.sha256(row.ids).hexdigest() == row.ids_sha256
