"""SimHash near-dedup: fingerprints, blocking, bit-sliced comparison and connected components.

1. Every text gets a 64-bit fingerprint from its 3-word shingles.
2. Documents of equal fingerprint form a class; only the class takes part in what follows.
3. Two fingerprints that differ in at most two of 64 bits agree on at least four of six bit ranges, so they meet in
   one of the 15 tables keyed by four whole ranges. Buckets of more than a tile are split into pairs of chunks.
4. In a bucket, distances are counted bit-sliced: bit planes hold one bit of many fingerprints, carry-save counters
   add the differing bits of all lanes at once, and a block ends as soon as every lane exceeds the radius.
5. Each tile gives the links of its own spanning forest; distributed components join them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.llm.common import LOWER, UPPER, dealt, packed, stored, unpacked
from brightloom.llm.components import connected_components
from brightloom.llm.tiles import tiled

RADIUS, SHINGLE, SEED = 2, 3, 42
#: Bit ranges of the fingerprint (low bit, width); a table keys on all but RADIUS of them.
RANGES = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
TILE = 2048
#: Buckets up to this size are compared as lanes of pairs, larger ones query by query.
SMALL = 24
BLOCK = 1 << 15
_LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text: a bit is set if it is set in over half the hashes of its word shingles."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWERED).split()
    if not words:
        return 0
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= shingle:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    count, total = len(words) - shingle + 1, np.zeros(64, dtype=np.int64)
    for at in range(0, count, BLOCK):
        cut = zip(starts[at : min(at + BLOCK, count)].tolist(), ends[at + shingle - 1 : min(at + BLOCK, count) + shingle - 1].tolist(), strict=True)
        hashes = np.fromiter([digest(joined[a:b], seed) for a, b in cut], dtype=np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > count, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *more) -> DataFrame:
    """(doc_id, fp, *more): the fingerprint as a signed 64-bit number."""

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            values = np.fromiter((fingerprint(x) for x in batch), dtype=np.uint64, count=len(batch))
            yield pd.Series(values.view(np.int64))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), of(F.col("text").cast("string")).alias("fp"), *more)


def planes(values: np.ndarray) -> np.ndarray:
    """64 rows of packed words: bit i of row j is bit j of values[i]; unused lanes are zero."""
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view(np.uint64)


def beyond(rows: Iterator[np.ndarray], lanes: np.ndarray) -> np.ndarray:
    """Lanes that differ in more than two bits; ``rows`` gives each plane's differing bits.

    ones and twos are carry-save counters of 1 and 2; four is kept once reached. Ends when all lanes exceed.
    """
    ones, twos, over = np.zeros_like(lanes), np.zeros_like(lanes), ~lanes
    for n, differing in enumerate(rows):
        carry = ones & differing
        ones ^= differing
        over |= twos & carry
        twos ^= carry
        over |= twos & ones  # three differing bits
        if n % 8 == 7 and (over == np.uint64(2**64 - 1)).all():
            break
    return over


def _lanes(n: int) -> np.ndarray:
    """Packed words in which the first n bits are set."""
    return np.pad(np.packbits(np.ones(n, dtype=np.uint8), bitorder="little"), (0, -((n + 7) // 8) % 8)).view(np.uint64)


def _unpacked(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), axis=-1, bitorder="little")[..., :n].astype(bool)


def close_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which a[i], b[i] differ in at most two bits."""
    found = [np.zeros(0, dtype=bool)]
    for at in range(0, len(a), BLOCK):
        lanes = np.ascontiguousarray(a[at : at + BLOCK] ^ b[at : at + BLOCK])
        found.append(~_unpacked(beyond(iter(planes(lanes)), _lanes(len(lanes))), len(lanes)))
    return np.concatenate(found)


def close_groups(values: np.ndarray) -> np.ndarray:
    """For each fingerprint of a block, the position of the first one that it reaches by links within the block.

    A breadth-first walk: the planes are stored once, and every fingerprint is a query once.
    """
    n, stored_planes, root = len(values), planes(values), np.full(len(values), -1, dtype=np.int64)
    full, left = np.uint64(2**64 - 1), _lanes(len(values))
    for first in range(n):
        if root[first] >= 0:
            continue
        frontier = np.array([first])
        root[first] = first
        while len(frontier):
            ask, frontier = frontier[:64], frontier[64:]
            open_lanes = np.packbits(root < 0, bitorder="little")
            left = np.pad(open_lanes, (0, -len(open_lanes) % 8)).view(np.uint64)
            if not left.any():
                break
            wanted = ((values[ask][:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(bool)
            rows = (stored_planes[j][None, :] ^ np.where(wanted[:, j], full, np.uint64(0))[:, None] for j in range(64))
            near = ~np.bitwise_and.reduce(beyond(rows, np.broadcast_to(left, (len(ask), len(left))).copy()), axis=0)
            new = np.flatnonzero(_unpacked(near, n) & (root < 0))
            root[new] = first
            frontier = np.concatenate((frontier, new))
    return root


def _small_links(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links, as positions, of buckets of at most SMALL rows: each row meets its r-th successor, for r = 1, 2, ..."""
    ends = np.repeat(start + size, size)
    at = np.concatenate([np.arange(s, s + k) for s, k in zip(start, size, strict=True)]) if len(start) else np.zeros(0, dtype=np.int64)
    links = []
    for r in range(1, SMALL):
        at, ends = at[at + r < ends], ends[at + r < ends]
        if not len(at):
            break
        near = close_pairs(values[at], values[at + r])
        links.append((at[near], at[near] + r))
    return links


def _bucket_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links (src_rep, src_fp, dst_rep, dst_fp) of the buckets of one partition, which come sorted by bucket."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        prints, reps = rows["fp"].to_numpy(dtype=np.int64), rows["rep"].to_numpy(dtype=np.int64)
        values = prints.view(np.uint64)
        ids = rows[["table", "key", "left_chunk", "right_chunk"]].to_numpy(dtype=np.int64)
        start = np.concatenate(([0], np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1))
        size = np.diff(np.append(start, len(rows)))
        small = (size > 1) & (size <= SMALL)
        links = _small_links(values, start[small], size[small])
        for s, k in zip(start[size > SMALL], size[size > SMALL], strict=True):
            root = close_groups(np.ascontiguousarray(values[s : s + k]))
            moved = np.flatnonzero(root != np.arange(k))
            links.append((s + moved, s + root[moved]))
        src, dst = (np.concatenate([x[i] for x in links]).astype(np.int64) if links else np.zeros(0, dtype=np.int64) for i in (0, 1))
        return pd.DataFrame({"src_rep": reps[src], "src_fp": prints[src], "dst_rep": reps[dst], "dst_fp": prints[dst]}).drop_duplicates()

    rest = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        last = rows[["table", "key", "left_chunk", "right_chunk"]].iloc[-1]
        same = np.ones(len(rows), dtype=bool)
        for c in last.index:
            same &= rows[c].to_numpy() == last[c]
        rest = rows[same]
        if not same.all():
            yield solve(rows[~same])
    if rest is not None and len(rest):
        yield solve(rest)


def links(classes: DataFrame, tile: int = TILE) -> DataFrame:
    """(src, dst), each struct(rep, fp), between rows of ``classes`` (rep, fp): the same components as all links.

    A fingerprint ``fp`` comes once; its ``rep``, the smallest doc_id that has it, may stand for others as well.
    """
    tables = list(combinations(range(len(RANGES)), len(RANGES) - RADIUS))
    masks = [sum(((1 << RANGES[i][1]) - 1) << RANGES[i][0] for i in kept) for kept in tables]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keys = F.array(*[F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks)])
    keyed = classes.select("fp", "rep", F.explode(keys).alias("at")).select("fp", "rep", "at.table", "at.key")
    ids = ["table", "key", "left_chunk", "right_chunk"]
    tiles = tiled(keyed, ["table", "key"], "fp", tile).repartition(*ids).sortWithinPartitions(*ids)
    found = tiles.select("fp", "rep", *ids).mapInPandas(_bucket_links, "src_rep long, src_fp long, dst_rep long, dst_fp long")
    ends = [F.struct(F.col(f"{x}_rep").alias("rep"), F.col(f"{x}_fp").alias("fp")).alias(x) for x in ("src", "dst")]
    return found.select(*ends)


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id, component_fp) for every row of docs; see op3_simhash for the definition.

    component_fp, the fingerprint of the group's first class, tells groups apart that begin at the same repeated id.
    """
    prints = stored(fingerprints(docs), "fingerprints")
    classes = stored(prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprint-classes")
    edges = stored(links(classes), "fingerprint-links")
    moved = connected_components(edges).where("node <> component").select(F.col("node.fp").alias("moved_fp"), F.col("component"))
    first = F.coalesce("component", F.struct("rep", "fp"))
    # stored, so that the join below reads two shuffles and a fingerprint of very many documents is split
    final = stored(classes.join(moved, F.col("fp") == F.col("moved_fp"), "left").select(F.col("fp").alias("class_fp"), first.alias("first")), "fingerprint-groups")
    named = lambda name: F.when(F.col("doc_id").isNotNull(), F.col("first").getField(name))
    return prints.join(final, F.col("fp") == F.col("class_fp"), "left").select("doc_id", "fp", named("rep").alias("component_id"), named("fp").alias("component_fp"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each group stays, of the smallest doc_id; see op3_simhash.

    Defined cases: rows without doc_id are kept. Rows that repeat a doc_id are told apart by their fingerprints, and
    each stays or goes with its own group; of several rows of a group that have its smallest doc_id, the one of the
    smallest fingerprint and text hash stays. Extra columns are carried along, whatever their names. An empty table
    gives an empty table.
    """
    groups = stored(near_groups(docs), "near-groups").where("doc_id IS NOT NULL")
    repeated = stored(groups.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated-ids")
    gone = groups.where("doc_id <> component_id").select("doc_id").unionByName(repeated).distinct()
    rows = packed(docs, F.col("doc_id").cast("long").alias("doc_id"))
    kept = unpacked(rows.join(gone, "doc_id", "left_anti"), docs)
    if repeated.isEmpty():
        return kept
    again = rows.join(repeated, "doc_id", "left_semi").select("row", "doc_id", F.col("row.text").alias("text"))
    again = fingerprints(again, "row", F.xxhash64("text").alias("h")).join(groups.distinct(), ["doc_id", "fp"]).where("doc_id = component_id")
    return kept.unionByName(unpacked(again.groupBy("component_id", "component_fp").agg(F.min_by("row", F.struct("fp", "h")).alias("row")), docs))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document.

    Defined cases: a null text, and one without words, has fingerprint zero and is linked like any other. Rows that
    repeat a doc_id are rows of their own in one group if their texts agree. A row without doc_id gets its fingerprint
    and a null component_id, and takes part in no group. Extra columns are not read. An empty table gives no rows.
    """
    docs = dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return near_groups(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
