"""Language identification: the family first, then one-versus-one linear support vector machines within it.

Features are the relative frequencies of hashed letter trigrams of the lower-cased text, words padded by a space.
Each machine is fitted in a task of its own, by dual coordinate descent on a bounded sample of labelled rows; the
model is one matrix, a column for each machine, and a whole text is scored by the mean of its trigrams' rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from brightloom.llm.common import dealt, packed, unpacked

#: Families of language codes; a language that is not named forms a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "baltic": ("lt", "lv"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indo-aryan": ("hi", "bn", "ur", "mr", "ne"),
    "sinitic": ("zh",),
    "japonic": ("ja",),
    "koreanic": ("ko",),
    "semitic": ("ar", "he"),
}
BITS = 14
#: Distinct labelled rows (by doc_id and text) that training reads, on average: per language, and of all languages.
SAMPLE_PER_LANGUAGE, SAMPLE_ROWS = 1500, 60_000
#: More languages than that are an error: the model would no longer be a few MB. All that are there are learned.
MAX_LANGUAGES = 1000
UNKNOWN = "und"
#: Factor of the relative frequencies, cost of a violated margin, passes over the sample.
SCALE, COST, PASSES = 16.0, 1.0, 12
PIECE = 1 << 20


def family_of(lang: str) -> str:
    return next((name for name, members in FAMILIES.items() if lang in members), lang)


@cache
def _letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def trigrams(text: str | None) -> np.ndarray:
    """Hashes of the letter trigrams of a text, in order; none if it has no letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    codes = np.where(_letter()[codes], codes, np.uint32(32))
    codes = np.concatenate((np.array([32], dtype=np.uint32), codes, np.array([32], dtype=np.uint32)))
    codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
    if len(codes) < 3:
        return np.zeros(0, dtype=np.int64)
    mixed = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA77) + codes[2:] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x27D4EB2F)
    return (mixed >> np.uint32(32 - BITS)).astype(np.int64)


def held_out(doc_id: Column) -> Column:
    """Documents that training may not read: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def _machines(langs: list[str]) -> list[tuple[str, tuple[str, ...], tuple[str, ...]]]:
    """(kind, languages on the positive side, on the negative side) of every machine."""
    families: dict[str, list[str]] = {}
    for lang in langs:
        families.setdefault(family_of(lang), []).append(lang)
    names = sorted(families)
    found = []
    if len(names) == 2:
        found.append(("family", tuple(families[names[0]]), tuple(families[names[1]])))
    elif len(names) > 2:
        found += [("family", tuple(families[f]), tuple(x for x in langs if x not in families[f])) for f in names]
    return found + [("pair", (a,), (b,)) for f in names for a, b in combinations(families[f], 2)]


class Model:
    """Weights of all machines and how to decide by them."""

    def __init__(self, langs: list[str], machines: list, weights: np.ndarray, offsets: np.ndarray):
        self.langs, self.machines, self.weights, self.offsets = langs, machines, weights, offsets

    def margins(self, text: str | None) -> np.ndarray | None:
        grams = trigrams(text)
        if not len(grams):
            return None
        total = np.zeros(self.weights.shape[1])
        for at in range(0, len(grams), PIECE):
            total += self.weights[grams[at : at + PIECE]].sum(axis=0, dtype=np.float64)
        return total / len(grams) + self.offsets

    def predict(self, text: str | None) -> tuple[str, float]:
        margin = self.margins(text)
        if margin is None or not self.langs:
            return UNKNOWN, 0.0
        sure = lambda x: 1 / (1 + math.exp(-max(-30.0, min(30.0, 2 * x))))
        families = [i for i, m in enumerate(self.machines) if m[0] == "family"]
        score, members = 1.0, tuple(self.langs)
        if len(families) == 1:
            _, yes, no = self.machines[families[0]]
            members, score = (yes, sure(margin[families[0]])) if margin[families[0]] > 0 else (no, sure(-margin[families[0]]))
        elif families:
            best = max(families, key=lambda i: margin[i])
            members, score = self.machines[best][1], sure(margin[best])
        votes, least = dict.fromkeys(members, 0.0), dict.fromkeys(members, 1.0)
        for i, (kind, (a, *_), (b, *_)) in enumerate(self.machines):
            if kind == "pair" and a in votes:
                p = sure(margin[i])
                votes[a] += p
                votes[b] += 1 - p
                least[a], least[b] = min(least[a], p), min(least[b], 1 - p)
        lang = max(members, key=lambda x: (votes[x], x))
        return lang, float(min(1.0, max(0.0, score * least[lang])))


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fits the machines on about ``per_language`` labelled rows of each language that are not held out.

    Every language that occurs is learned; over MAX_LANGUAGES distinct labels are a ValueError. Rows are drawn by a
    hash of doc_id and text, and rows that repeat both count once, so repeated or null ids can't swell the sample.
    """
    labelled = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = labelled.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"lang has more than {MAX_LANGUAGES} distinct values")
    per_language = min(per_language, SAMPLE_ROWS / max(1, len(counts)))
    langs = sorted(r["lang"] for r in counts)
    machines = _machines(langs)
    width = 1 << BITS
    if not machines:
        return Model(langs, [], np.zeros((width, 0), dtype=np.float32), np.zeros(0))
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, per_language / r["count"])))])
    chance = F.pmod(F.col("row_key"), F.lit(1 << 30)) / float(1 << 30)
    sides = {x: [(i, lang_side) for i, (_, yes, no) in enumerate(machines) for lang_side, part in ((1, yes), (-1, no)) if x in part] for x in langs}
    takes = F.create_map(*[x for lang, at in sides.items() for x in (F.lit(lang), F.array(*[F.struct(F.lit(i).alias("machine"), F.lit(y).alias("side")) for i, y in at]))])

    @F.pandas_udf("grams array<int>, counts array<int>")
    def features(texts: pd.Series) -> pd.DataFrame:
        found = [np.unique(trigrams(x), return_counts=True) for x in texts]
        return pd.DataFrame({"grams": [g.astype(np.int32) for g, _ in found], "counts": [n.astype(np.int32) for _, n in found]})

    # bounded by SAMPLE_ROWS: about per_language rows a language in each machine's group
    rows = labelled.select("lang", F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", F.lit(5), "text").alias("row_key"))
    drawn = rows.where(chance < share[F.col("lang")]).groupBy("lang", "row_key").agg(F.max("text").alias("text"))
    sample = drawn.select("row_key", "lang", features(F.col("text")).alias("f"))
    sides_of = sample.select("row_key", "f.grams", "f.counts", F.explode(takes[F.col("lang")]).alias("at")).select("row_key", "grams", "counts", "at.machine", "at.side")
    weights, offsets = np.zeros((width, len(machines)), dtype=np.float32), np.zeros(len(machines))
    for row in sides_of.groupBy("machine").applyInPandas(_fit, "machine int, weights binary, intercept double").collect():
        weights[:, row["machine"]], offsets[row["machine"]] = np.frombuffer(row["weights"], dtype="<f4"), row["intercept"]
    return Model(langs, machines, weights, offsets)


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    """A linear support vector machine with squared hinge loss, by dual coordinate descent over the rows of a sample."""
    rows = rows.sort_values(["row_key", "side"], kind="stable")
    side = rows["side"].to_numpy(dtype=np.float64)
    at = [np.append(g, 1 << BITS).astype(np.int64) for g in rows["grams"]]
    value = [np.append(SCALE * n / max(1, n.sum()), 1.0) for n in rows["counts"]]
    w, alpha, order = np.zeros((1 << BITS) + 1), np.zeros(len(rows)), np.random.default_rng(1)
    square = np.array([v @ v for v in value]) + 0.5 / COST
    for _ in range(PASSES):
        for i in order.permutation(len(rows)):
            slope = side[i] * (w[at[i]] @ value[i]) - 1 + alpha[i] * 0.5 / COST
            new = max(0.0, alpha[i] - slope / square[i])
            if new != alpha[i]:
                w[at[i]] += (new - alpha[i]) * side[i] * value[i]
                alpha[i] = new
    return pd.DataFrame({"machine": [rows["machine"].iloc[0]], "weights": [(w[:-1] * SCALE).astype("<f4").tobytes()], "intercept": [w[-1]]})


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and lang_score, which replace columns of these names; only the text is read.

    The model is broadcast: 64 kB a machine, of which there is one for each family and for each pair within one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([shared.value.predict(x) for x in batch], columns=["lang_pred", "score"])

    # not deterministic for the optimizer, which else predicts twice where a filter reads the prediction
    found = packed(docs, of.asNondeterministic()(F.col("text").cast("string")).alias("found"))
    return unpacked(found, docs, lang_pred=F.col("found.lang_pred"), lang_score=F.col("found.score"))


@F.pandas_udf(BooleanType())
def _lettered(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: len(trigrams(x)) > 0).astype(bool)


def recognised(docs: DataFrame) -> DataFrame:
    """The documents whose language can be told, with the predicted one as their ``lang``; the others go.

    Defined cases: null texts and those without letters have no language and go. If there is no labelled row to learn
    from, nothing can be told of any language: then documents with letters stay as they are. Rows that repeat a
    doc_id, or have none, are told each. Extra columns are carried along; an empty table gives an empty table.
    """
    model, rows = train(docs), packed(docs, F.col("text").cast("string").alias("text"))
    if not model.langs:
        return unpacked(rows.where(_lettered(F.col("text"))), docs)
    told = predicted(rows, model).where(F.col("lang_pred") != UNKNOWN)
    return unpacked(told, docs, lang=F.col("lang_pred").cast(docs.schema["lang"].dataType))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document.

    Defined cases: a null text, and one without letters, is ``und`` with score 0; so is every text if no labelled row
    was there to learn from. Rows that repeat a doc_id are predicted each; a null doc_id is not held out. Texts are
    scored whole. Extra columns are not read. Ties between languages go to the last one in alphabetical order.
    """
    docs = dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
    out = predicted(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
