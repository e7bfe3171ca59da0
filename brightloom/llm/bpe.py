"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier 1: a minimal perfect hash over the vocabulary (hash and displace) answers pre-tokens that are tokens themselves.
Tier 2: the others are merged by a heap of candidate pairs over a doubly linked list of byte parts, in O(n log n)
even for a pre-token of a whole page.

The rank file is read on the driver and sent to the executors once: its size is that of the vocabulary. Results for
pre-tokens are remembered in a table of bounded size in each Python worker.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.llm.common import dealt

#: Pre-tokens that a Python worker remembers before it starts anew, and the most characters of one: about 100 MB.
MEMO, MEMO_CHARS = 600_000, 48
VOCABULARY = "byte_bpe_50k.tiktoken"


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank from a file of base64 and number pairs."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, file.read().splitlines()))}


class PerfectHash:
    """A minimal perfect hash of byte strings: n keys in n slots, one number for every three keys.

    The key's 64-bit hash picks a bucket and two 32-bit numbers a, b; the bucket's displacement d places it at slot
    (a + d * b) mod n. Buckets are placed by falling size; a bucket of one key takes any free slot, kept as -slot - 1.
    """

    def __init__(self, keys: list[bytes]):
        import xxhash

        self.n, seed = len(keys), 0
        while True:
            self.seed, self.n_buckets = seed, self.n // 3 + 1
            hashes = [xxhash.xxh64_intdigest(k, seed) for k in keys]
            if self._place(hashes):
                break
            seed += 1
        self.keys: list[bytes] = [b""] * self.n
        self.position = [0] * self.n
        for i, (k, h) in enumerate(zip(keys, hashes, strict=True)):
            slot = self._slot(h)
            self.keys[slot], self.position[slot] = k, i

    def _slot(self, h: int) -> int:
        d = self.displace[h % self.n_buckets]
        return -d - 1 if d < 0 else ((h & 0xFFFFFFFF) + d * (h >> 32)) % self.n

    def _place(self, hashes: list[int]) -> bool:
        buckets: list[list[int]] = [[] for _ in range(self.n_buckets)]
        for h in hashes:
            buckets[h % self.n_buckets].append(h)
        self.displace, used, free = [0] * self.n_buckets, np.zeros(self.n, dtype=bool), iter(())
        for b in sorted(range(self.n_buckets), key=lambda b: -len(buckets[b])):
            if len(buckets[b]) > 1:
                low, high = (np.array([f(h) for h in buckets[b]], dtype=np.int64)[:, None] for f in (lambda h: h & 0xFFFFFFFF, lambda h: h >> 32))
                for start in range(0, 1 << 17, 256):
                    slots = np.sort((low + np.arange(start, start + 256) * high) % self.n, axis=0)
                    fit = np.flatnonzero(~used[slots].any(axis=0) & (slots[1:] != slots[:-1]).all(axis=0))
                    if len(fit):
                        break
                else:
                    return False
                self.displace[b] = start + int(fit[0])
                used[slots[:, fit[0]]] = True
            elif buckets[b]:
                slot = next(free, -1)
                if slot < 0:
                    free = iter(np.flatnonzero(~used).tolist())
                    slot = next(free)
                used[slot] = True
                self.displace[b] = -slot - 1
        return True

    def index(self, key: bytes) -> int:
        """The key's position in the list it was built from, or -1."""
        import xxhash

        if not self.n:
            return -1
        slot = self._slot(xxhash.xxh64_intdigest(key, self.seed))
        return self.position[slot] if self.keys[slot] == key else -1


def merge_bytes(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ranks of the parts after all merges: always the pair of lowest rank, of equal ones the leftmost."""
    n = len(token)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # start of the next part, of the previous part
    end = after.copy()  # of the part that starts here
    pair = [ranks.get(token[i : i + 2], -1) if i + 2 <= n else -1 for i in range(n)]
    heap = [(r, i) for i, r in enumerate(pair) if r >= 0]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        if pair[i] != rank:
            continue
        j = after[i]
        end[i] = end[j]
        k = after[i] = after[j]
        pair[j] = -1
        if k < n:
            before[k] = i
            pair[i] = r = ranks.get(token[i : end[k]], -1)
            if r >= 0:
                heapq.heappush(heap, (r, i))
        else:
            pair[i] = -1
        h = before[i]
        if h >= 0:
            pair[h] = r = ranks.get(token[h : end[i]], -1)
            if r >= 0:
                heapq.heappush(heap, (r, h))
    parts, i = [], 0
    while i < n:
        parts.append(ranks[token[i : end[i]]])
        i = after[i]
    return parts


class Codec(dict):
    """Encodes and decodes; as a dict, pre-token to the little-endian 32-bit ids of its tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, whole: PerfectHash | None = None):
        import regex

        super().__init__()
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.whole, self.rank_of = whole or PerfectHash(list(ranks)), list(ranks.values())
        self.token = {rank: token for token, rank in ranks.items()}

    def __missing__(self, piece: str) -> bytes:
        token = piece.encode("utf-8", "replace")
        at = self.whole.index(token)
        ids = [self.rank_of[at]] if at >= 0 else merge_bytes(token, self.ranks)
        found = np.array(ids, dtype="<u4").tobytes()
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = found
        return found

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, self.pattern.findall(text or "")))

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the tokens; an id outside the vocabulary is an error."""
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_CODECS: dict[str, Codec] = {}
_TABLES: dict[str, tuple] = {}


def codec_of(shared) -> Codec:
    """The worker's codec for what share() has broadcast; it outlives a task."""
    name, ranks, pattern, whole = shared.value
    if name not in _CODECS:
        _CODECS[name] = Codec(ranks, pattern, whole)
    return _CODECS[name]


def share(spark: SparkSession, path: str | None = None, pattern: str | None = None):
    """Broadcasts the ranks of a file, its perfect hash and the pattern (a few MB, the size of the vocabulary)."""
    path, pattern = path or default_ranks(), pattern or default_pattern()
    name = f"{path}:{pattern}"
    if name not in _TABLES:
        ranks = load_ranks(path)
        _TABLES[name] = (name, ranks, pattern, PerfectHash(list(ranks)))
    return spark.sparkContext.broadcast(_TABLES[name])


def with_token_ids(docs: DataFrame, path: str | None = None, pattern: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, n_tokens, ids, decoded): ids as little-endian 32-bit numbers, decoded as the bytes they stand for.

    Defined cases: a null or empty text has no tokens; texts of any length are encoded whole; rows that repeat a
    doc_id are encoded each; a null doc_id stays null; extra columns are not read; an empty table gives no rows.
    """
    shared = share(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = [codec.encode(x) for x in part.column("text").to_pylist()]
                made = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(codec.decode, ids), pa.binary())]
                own = ["doc_id", *keep]  # as Arrow columns: pandas would turn ids beside a null into floats
                yield pa.RecordBatch.from_arrays([*map(part.column, own), *made], names=[*own, "n_tokens", "ids", "decoded"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).cast("string").alias(c) for c in keep])
    return rows.mapInArrow(run, ", ".join(["doc_id long", *[f"{c} string" for c in keep], "n_tokens long, ids binary, decoded binary"]))


def decode_ids(rows: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of rows with doc_id and ids; bytes that are no UTF-8 become the replacement character.

    Defined cases: null ids give an empty text; a null doc_id stays null, and repeated ones stay apart.
    """
    shared = share(rows.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared)
        for batch in batches:
            texts = [codec.decode(x or b"").decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def encoded(docs: DataFrame) -> DataFrame:
    """For the pipeline: ids of every document with the digests of both directions; lang and source go along."""
    return with_token_ids(docs, keep=("lang", "source")).select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of every text's ids, and the digest of what they decode to; cases as in ``with_token_ids``."""
    docs = dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return with_token_ids(docs).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
