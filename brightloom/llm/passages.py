"""Substring dedup by recompression: passages that repeat in another document, found by shared symbols.

1. Recompression. A text is a sequence of symbols, at first its words. A round names runs of one symbol, then pairs: a
   symbol whose name has the bit 0 takes in a following one with the bit 1. Names are hashes of the names they stand for,
   so that all executors give equal names to equal things, without a dictionary that grows with the corpus. What a
   symbol of round ROUNDS depends on is its context, the words from which its parsing follows: equal stretches of words
   have equal symbols wherever the context is within them.
2. Every window of ``width`` words has an anchor, which its words alone determine: of the symbols of the highest round
   that have one with its context in the window, that of the least hash. Windows of one anchor follow each other.
3. Anchors that two documents share reveal repeats. Equal extents, all words of an anchor's windows, verify all of its
   windows at once: each document but the first loses them. Only where an anchor has several extents, its windows are
   hashed one by one, in the first document of each extent, and compared.
4. Words covered by a window that also starts in a document with a smaller doc_id go.

Keys are aggregated before they are shuffled; joins read stored tables, so that a common passage is split over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.llm.common import dealt, fresh_path, packed, removed, unpacked

WIDTH, ROUNDS = 50, 4
#: Words that are looked at together: texts are cut at it, with an overlap of a window.
STRETCH = 1 << 18
#: Words whose hash a Python worker remembers before it starts anew, and the longest of them.
MEMO, MEMO_BYTES = 400_000, 40
#: Odd multipliers of the hashes.
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


class WordHashes(dict):
    """xxHash64 of words, remembered in a table of bounded size."""

    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        import xxhash

        found = xxhash.xxh64_intdigest(word, self.seed)
        if len(word) <= MEMO_BYTES:
            if len(self) >= MEMO:
                self.clear()
            self[word] = found
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def words_of(text: str | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of a text."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * M3
    x = (x ^ (x >> np.uint64(29))) * M1
    return x ^ (x >> np.uint64(32))


def span_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """A polynomial hash of each words[start:end], by sums of the words before."""
    powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(words), base, dtype=np.uint64))), dtype=np.uint64)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(words * powers[:-1], dtype=np.uint64)))
    back = np.uint64(pow(int(base), -1, 1 << 64))
    inverse = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(words), back, dtype=np.uint64))), dtype=np.uint64)
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * M2)


class Symbols:
    """Symbols of some texts that lie one behind the other, with the stretch of words that each stands for and that of
    its context; a context that reaches beyond the text of its symbol is never within a window."""

    def __init__(self, words: np.ndarray, first: np.ndarray):
        at = np.arange(len(words))
        self.words, self.names, self.start, self.end, self.low, self.high, self.first = words, words, at, at + 1, at, at + 1, first

    def _joined(self, names: np.ndarray, heads: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        tails = np.append(heads[1:], len(self.names)) - 1
        self.names, self.start, self.end, self.low, self.high, self.first = names, self.start[heads], self.end[tails], low, high, self.first[heads]

    def name_runs(self, salt: int) -> None:
        """Equal neighbours become one symbol. That a neighbour differs is known from its next word, or else from all
        that it depends on."""
        n = len(self.names)
        heads = np.flatnonzero(np.concatenate(([True], (self.names[1:] != self.names[:-1]) | self.first[1:])))
        tails = np.append(heads[1:], n) - 1
        counts = tails - heads + 1
        names = np.where(counts > 1, mixed(self.names[heads] * M2 + counts.astype(np.uint64) * M1 + np.uint64(salt)), self.names[heads])
        before, after = self.start[heads] - 1, self.end[tails]
        same_before = self.words[np.maximum(before, 0)] == self.words[self.end[heads] - 1]
        same_after = self.words[np.minimum(after, len(self.words) - 1)] == self.words[self.start[tails]]
        low_before = np.concatenate(([-1], self.low))[heads]  # of the symbol before each head
        high_after = np.append(self.high, len(self.words) + 1)[tails + 1]
        low = np.minimum(self.low[heads], np.where(same_before, low_before, before))
        high = np.maximum(self.high[tails], np.where(same_after, high_after, after + 1))
        self._joined(names, heads, low, high)

    def name_pairs(self, salt: int) -> None:
        """A symbol of bit 0 and a following one of bit 1 become one; one left alone depends on the neighbour that it
        did not join."""
        bit = (mixed((self.names ^ np.uint64(salt)) * M2) >> np.uint64(40)) & np.uint64(1) == 1
        takes = np.append(~bit[:-1] & bit[1:] & ~self.first[1:], False)
        heads = np.flatnonzero(np.concatenate(([True], ~takes[:-1])))
        pair = takes[heads]
        right = np.where(pair, heads + 1, heads)
        names = np.where(pair, mixed(self.names[heads] * M1 + self.names[right] * M2 + np.uint64(salt)), self.names[heads])
        low_before = np.concatenate(([-1], self.low))[heads]
        high_after = np.append(self.high, len(self.words) + 1)[heads + 1]
        low = np.where(bit[heads] & ~pair, low_before, self.low[heads])
        high = np.where(~bit[heads] & ~pair, high_after, self.high[right])
        self._joined(names, heads, low, high)


def least_of_ranges(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The place of the least values[low:high] of each range, the first among equals; no range is empty."""
    best, out, size = np.arange(len(values)), np.empty(len(low), dtype=np.int64), 1
    depth = np.frexp((high - low).astype(np.float64))[1] - 1
    for level in range(int(depth.max(initial=-1)) + 1):
        mine = depth == level
        a, b = best[low[mine]], best[high[mine] - size]
        out[mine] = np.where(values[a] <= values[b], a, b)
        a, b = best[:-size], best[size:]
        best, size = np.where(values[a] <= values[b], a, b), 2 * size
    return out


def anchors(words: np.ndarray, first: np.ndarray, windows: np.ndarray, width: int = WIDTH, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """For each window, given by its first word: the key of its anchor, and a number that tells anchors apart."""
    keys, who = np.zeros(len(windows), dtype=np.uint64), np.full(len(windows), -1, dtype=np.int64)
    symbols, levels = Symbols(words, first), []
    for n in range(rounds + 1):
        if n:
            symbols.name_runs(2 * n)
            symbols.name_pairs(2 * n + 1)
        levels.append((n, symbols.names, symbols.low, symbols.high))
    left, numbered = np.arange(len(windows)), 0
    for n, names, low, high in reversed(levels):
        a = np.searchsorted(low, windows[left], "left")
        b = np.searchsorted(high, windows[left] + width, "right")
        some = b > a
        if some.any():
            inside = (low >= 0) & (high <= len(words)) & (high - low <= width)
            context = span_hashes(words, np.where(inside, low, 0), np.where(inside, high, 0), M1)
            key = mixed(context * M2 + names * M1 + np.uint64(n))
            at = least_of_ranges(key, a[some], b[some])
            keys[left[some]], who[left[some]] = key[at], numbered + at
        left, numbered = left[~some], numbered + len(names)
        if not len(left):
            break
    return keys, who


def _pieces(batches: Iterator[pa.RecordBatch], hashes: WordHashes, width: int) -> Iterator[list[tuple]]:
    """Lists of (doc_id, mark, place of the first word in its text, hashes of words), of about STRETCH words together."""
    held, n = [], 0
    for batch in batches:
        for doc, mark, text in zip(*(batch.column(c) for c in ("doc_id", "mark", "text")), strict=True):
            words = hashes.of(words_of(text.as_py()))
            for at in range(0, max(len(words) - width + 1, 0), STRETCH):
                part = words[at : at + STRETCH + width - 1]
                held.append((doc.as_py(), mark.as_py(), at, part))
                n += len(part)
                if n >= STRETCH:
                    yield held
                    held, n = [], 0
    if held:
        yield held


def _anchor_rows(width: int):
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces in _pieces(batches, WordHashes(1), width):
            sizes = np.array([len(p[3]) for p in pieces])
            offsets = np.cumsum(sizes) - sizes
            words = np.concatenate([p[3] for p in pieces])
            first = np.zeros(len(words), dtype=bool)
            first[offsets] = True
            owner = np.repeat(np.arange(len(pieces)), sizes - width + 1)
            windows = np.arange(len(owner)) + owner * (width - 1)  # every piece has at least a window
            keys, who = anchors(words, first, windows, width)
            head = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (owner[1:] != owner[:-1]))))
            tail = np.append(head[1:], len(windows)) - 1
            digest, view = xxhash.xxh64_intdigest, memoryview(words.view(np.uint8))
            cut = zip((windows[head] * 8).tolist(), ((windows[tail] + width) * 8).tolist(), strict=True)
            extents = np.fromiter((digest(view[a:b]) for a, b in cut), dtype=np.uint64, count=len(head))
            base = np.array([p[2] for p in pieces]) - offsets
            own = owner[head]
            docs, marks = (np.array([p[i] for p in pieces], dtype=np.int64)[own] for i in (0, 1))
            columns = [keys[head].view(np.int64), extents.view(np.int64), docs, marks, (windows[head] + base[own]).astype(np.int32), (windows[tail] + base[own]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "extent", "doc_id", "mark", "first", "last"])

    return run


def _window_rows(width: int):
    """Two hashes of each window in the given stretches of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = WordHashes(2), WordHashes(3)
        for batch in batches:
            for doc, mark, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "mark", "text", "spans")), strict=True):
                words = words_of(text)
                a, b = one.of(words), two.of(words)
                at = np.unique(np.concatenate([np.arange(x["first"], x["last"] + 1) for x in spans]))
                for k in range(0, len(at), STRETCH):
                    part = at[k : k + STRETCH]
                    low, high = int(part[0]), int(part[-1]) + width
                    h = [span_hashes(w[low:high], part - low, part - low + width, base).view(np.int64) for w, base in ((a, M1), (b, M2))]
                    yield pa.RecordBatch.from_arrays([pa.array(h[0]), pa.array(h[1]), pa.array([doc] * len(part), pa.int64()), pa.array([mark] * len(part), pa.int64()), pa.array(part.astype(np.int32))], names=["h1", "h2", "doc_id", "mark", "at"])

    return run


def _marked(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


class _Tables:
    """Tables of one call in the shared folder, each removed once the last plan that reads it has run."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, name: str, rows: DataFrame) -> DataFrame:
        self.paths[name] = path = fresh_path(self.spark, f"passages-{name}")
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            removed(self.spark, self.paths.pop(name))


def repeated_spans(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, mark, spans): for each text with words to be removed, stretches of words (first, end) that cover them.

    ``mark`` is a hash of the text and tells rows of one doc_id apart. Cases as in ``deduplicated``.
    """
    texts, tables = _marked(docs).where("doc_id IS NOT NULL"), _Tables(docs.sparkSession)
    found = tables.put("anchors", texts.mapInArrow(_anchor_rows(width), "key long, extent long, doc_id long, mark long, first int, last int"))
    several = lambda column: (F.min(column) < F.max(column)).alias("several")
    shared = tables.put("shared", found.groupBy("key").agg(several("doc_id")).where("several").select("key"))
    mine = tables.put("mine", found.join(shared, "key", "left_semi"))
    tables.drop("anchors", "shared")
    extents = tables.put("extents", mine.groupBy("key", "extent").agg(F.min("doc_id").alias("origin")))
    mixed_keys = tables.put("mixed", extents.groupBy("key").agg(several("origin")).where("several"))
    judged = tables.put("judged", extents.join(mixed_keys, "key", "left").select("key", "extent", "origin", F.coalesce("several", F.lit(False)).alias("several")))
    gone = F.col("doc_id") > F.col("origin")
    spans = tables.put("spans", mine.join(judged, ["key", "extent"]).where(gone | F.col("several")).select("doc_id", "mark", "first", "last", gone.alias("gone")))
    tables.drop("mine", "extents", "mixed", "judged")
    asked = tables.put("asked", spans.where("NOT gone").groupBy("doc_id", "mark").agg(F.collect_list(F.struct("first", "last")).alias("spans")))
    windows = texts.join(asked.hint("merge"), ["doc_id", "mark"]).mapInArrow(_window_rows(width), "h1 long, h2 long, doc_id long, mark long, at int")
    windows = tables.put("windows", windows)
    origins = tables.put("origins", windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("origin"), several("doc_id")).where("several").drop("several"))
    late = windows.join(origins, ["h1", "h2"]).where(gone).select("doc_id", "mark", F.col("at").alias("first"), (F.col("at") + width).alias("end"))
    every = spans.where("gone").select("doc_id", "mark", "first", (F.col("last") + width).alias("end")).unionByName(late)
    return tables.put("lost", every.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("first", "end")).alias("spans")))


def without_spans(text: Column, spans: Column) -> Column:
    """struct(n_words, n_removed, kept): kept is null where nothing is removed."""

    @F.pandas_udf("struct<n_words:bigint,n_removed:bigint,kept:string>")
    def of(texts: pd.Series, cuts: pd.Series) -> pd.DataFrame:
        rows = []
        for text, cut in zip(texts, cuts, strict=True):
            words = words_of(text)
            if cut is None:
                rows.append((len(words), 0, None))
                continue
            edge = np.zeros(len(words) + 1, dtype=np.int64)
            for span in cut:
                edge[span["first"]] += 1
                edge[span["end"]] -= 1
            stays = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
            rows.append((len(words), len(words) - len(stays), b" ".join([words[i] for i in stays]).decode("utf-8", "surrogatepass")))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])

    return of(text, spans)


def deduplicated(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs without the words that are covered by a window of ``width`` words which also starts in a document with a
    smaller doc_id, with ``n_words`` and ``n_removed``.

    Windows are judged on the texts as they come. The text of a document that loses words is what stays, joined by one
    space; other texts stay as they are.

    Defined cases: a null text, and one of fewer words than a window, loses nothing. Rows that repeat a doc_id are rows
    of their own and no repeats of each other; a row without doc_id loses nothing, nor does another for its sake.
    Repeats within one document stay. Texts are searched whole, whatever their length. Extra columns are carried along,
    whatever their names; columns named n_words or n_removed are replaced. An empty table gives no rows.
    """
    lost = repeated_spans(docs, width)
    text = F.col("row").getField("text").cast("string")
    rows = packed(docs, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("mark"))
    found = rows.join(lost.hint("merge"), ["doc_id", "mark"], "left").withColumn("done", without_spans(text, F.col("spans")))
    return unpacked(found, docs, text=F.coalesce("done.kept", text), n_words=F.col("done.n_words"), n_removed=F.col("done.n_removed"))


def op11_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every text of documents keeps; cases as in ``deduplicated``. Texts are taken as their words joined by a space."""
    docs = dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    out = deduplicated(docs)
    plain = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(plain, 256).alias("kept_sha256"))


#: Every window as a row, to be run on small tables only.
OP11_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)
), origins AS (
  SELECT k, min(doc_id) AS origin FROM windows GROUP BY k HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM windows JOIN origins USING (k) WHERE doc_id > origin
), lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
placed AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM words
), kept AS (
  SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.pos) AS text
  FROM placed p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.pos = p.pos WHERE g.pos IS NULL GROUP BY p.doc_id
)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(l.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM words w LEFT JOIN lost l ON l.doc_id = w.doc_id LEFT JOIN kept k ON k.doc_id = w.doc_id
"""
