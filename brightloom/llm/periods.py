"""Periodic runs in the words of a text: heavy/light lag counting, then island scans of the lags that can hold one.

A run of period q holds at least 2q, and at least 24 - q, matches of words q apart. The matches of all lags of a text
are counted exactly: for words that occur often by the autocorrelation of their places, with FFTs whose results are
rounded to the whole numbers that they are; for the others by the differences of their places. Only lags with enough
matches are scanned for islands of consecutive matches, in ascending order. A scan looks at every (q / 8)-th place first:
an island of 2q matches shows there as 16 in a row; only such stretches are looked at more closely, eight times as close
each time.

Every text is a row of its own: tables are dealt by Spark, and a task sees one text at a time, whole.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.llm.common import dealt, packed, unpacked

LEAST, TIMES = 24, 3
#: Texts whose results a Python worker holds at once.
ROWS = 250
#: Words that occur this often, in terms of the square root of a text's length, are counted by FFT.
HEAVY = 2.5
RUN = "start:bigint,length:bigint,period:bigint"


def numbers(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words, counted from 0 in the order of first sight."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))


def lag_matches(ids: np.ndarray, most: int) -> np.ndarray:
    """For each lag up to ``most``, how many places hold the same word as the place that lag behind; [0] is 0."""
    n, counts = len(ids), np.zeros(most + 1, dtype=np.int64)
    often = np.bincount(ids)
    heavy = np.flatnonzero(often > max(16.0, HEAVY * np.sqrt(n)))
    if len(heavy):
        size = 1 << int(n + most).bit_length()
        power = np.zeros(size // 2 + 1)
        for word in heavy:
            spectrum = np.fft.rfft(ids == word, size)
            power += spectrum.real**2 + spectrum.imag**2
        counts += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
        counts[0] = 0
    light = np.flatnonzero((often <= max(16.0, HEAVY * np.sqrt(n)))[ids] & (often > 1)[ids])
    order = light[np.argsort(ids[light], kind="stable")]
    key, place = ids[order], order
    at, step = np.arange(len(order)), 0
    while len(at):
        step += 1
        at = at[at + step < len(order)]
        at = at[key[at + step] == key[at]]  # those with a step-th next place of the same word
        apart = place[at + step] - place[at]
        counts += np.bincount(apart[apart <= most], minlength=most + 1)
    return counts


def stretches(marks: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(first, end) of the stretches of at least ``least`` true values."""
    edges = np.flatnonzero(np.diff(marks.astype(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    long_enough = ends - starts >= least
    return list(zip(starts[long_enough].tolist(), ends[long_enough].tolist(), strict=True))


def islands(ids: np.ndarray, lag: int, least: int, known: Callable[[int, int], bool]) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches of period ``lag`` with at least ``least`` consecutive matches, but those of which
    ``known`` says that they lie in a run of a smaller period that divides the lag."""
    places, step = [(0, len(ids) - lag)], max(1, lag // 8)
    while True:
        closer = []
        for low, high in places:
            for first, end in stretches(ids[low:high:step] == ids[low + lag : high + lag : step], least // step):
                a, b = low + first * step, low + (end - 1) * step
                # if these places lie in such a run, the whole island does, as it shares more than both periods with it
                if not known(a, b + lag + 1):
                    closer.append((max(low, a - step + 1), min(high, b + step)))
        places = closer
        if step == 1 or not places:
            break
        step = max(1, step // 8)
    for first, end in places:
        yield first, end + lag


def runs_of(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least ``least`` words and ``times`` periods, by start and period.

    ``times`` is at least 3. A stretch whose smallest period is less than the lag has a period that divides it (Fine and
    Wilf) and lies in a run of that period, found before.
    """
    n = len(ids)
    most = n // times
    if n < least or most < 1:
        return []
    lags = np.arange(1, most + 1)
    need = np.maximum(least - lags, (times - 1) * lags)
    found: dict[int, tuple[list[int], list[int]]] = {}
    for lag in lags[lag_matches(ids, most)[1:] >= need].tolist():
        smaller = [found[d] for d in found if lag % d == 0]

        def known(start: int, end: int, smaller=smaller) -> bool:
            for starts, ends in smaller:
                at = bisect_right(starts, start) - 1
                if at >= 0 and ends[at] >= end:
                    return True
            return False

        for start, end in islands(ids, lag, int(need[lag - 1]), known):
            starts, ends = found.setdefault(lag, ([], []))
            starts.append(start)
            ends.append(end)
    return sorted((s, e - s, d) for d, (starts, ends) in found.items() for s, e in zip(starts, ends, strict=True))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: all but those that lie in a run behind its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def words_of(text: str | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of a text."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def with_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs with ``n_words``, ``runs`` (structs of start, length, period in words) and ``collapsed``, the text's words
    without those behind the first period of a run, joined by one space.

    Defined cases: a null text, an empty one and one without words have no words and no runs, and collapse to an empty
    text. Texts are searched whole, whatever their length. Rows are handled each, whatever their ids. Extra columns are
    carried along, whatever their names; columns of the three names above are replaced. An empty table gives no rows.
    """

    @F.pandas_udf(f"struct<n_words:bigint,runs:array<struct<{RUN}>>,collapsed:string>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            for at in range(0, len(batch), ROWS):  # a batch of long texts is not held twice
                yield pd.DataFrame([solved(text) for text in batch.iloc[at : at + ROWS]], columns=["n_words", "runs", "collapsed"])

    def solved(text: str | None) -> tuple[int, list[dict], str]:
        words = words_of(text)
        runs = runs_of(numbers(words), least, times)
        kept = [words[i] for i in np.flatnonzero(kept_words(len(words), runs))] if runs else words
        return len(words), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], b" ".join(kept).decode("utf-8", "surrogatepass")

    rows = packed(docs, of(F.col("text").cast("string")).alias("found"))
    return unpacked(rows, docs, n_words=F.col("found.n_words"), runs=F.col("found.runs"), collapsed=F.col("found.collapsed"))


def strongest(runs: Column) -> Column:
    """The run of the greatest length / period, of the smallest start and period among equals; null if there is none.

    Fractions are compared as products of whole numbers.
    """
    first = lambda x, y: x["length"] * y["period"] - y["length"] * x["period"]  # noqa: E731  above 0, if x is stronger
    better = lambda x, y: (first(x, y) > 0) | ((first(x, y) == 0) & ((x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["period"] < y["period"]))))
    rest = F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0)))
    return F.when(F.size(runs) > 0, F.aggregate(rest, F.get(runs, 0), lambda acc, x: F.when(better(x, acc), x).otherwise(acc)))


def runs_digest(runs: Column) -> Column:
    """The digest of all runs, one a line."""
    lines = F.transform(runs, lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    return F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256)


def planted(text: Column, crc: Column) -> Column:
    """Texts of which the words behind a place repeat, where the CRC-32 beside them says so: the cases of op12_periods."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(w: Column) -> Column:
        g, n = F.floor(crc / 10).cast("long"), F.size(w)
        a = (g % n).cast("int")
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("int")
        places = F.sequence(F.lit(0), n - 1)
        return F.when(n > 0, F.array_join(F.transform(places, lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p))), " ")).otherwise(text)

    return F.when(crc % 10 == 0, F.get(F.transform(F.array(words), repeated), 0)).otherwise(text)


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every text of documents, some of which are made periodic from a place on first; cases as in
    ``with_runs``. A null doc_id has no CRC-32 and its text stays as it is."""
    docs = dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = with_runs(docs.select("doc_id", planted(F.col("text").cast("string"), crc).alias("text"))).withColumn("best", strongest(F.col("runs")))
    thousand = F.col("best.length") * 1000
    milli = ((thousand - thousand % F.col("best.period")) / F.col("best.period")).cast("long")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"),
        runs_digest(F.col("runs")).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
