"""Byte-level BPE encoding and decoding with a two-tier lookup.

A pre-token that is in the vocabulary as a whole is resolved by a minimal perfect hash (hash and displace: one slot for
each entry, none empty; the entry's bytes are compared, so a foreign pre-token is never taken for one). The rest is
merged by a heap over a linked list of its bytes, in n log n for any length. Each task keeps a bounded table of
pre-tokens that it has met. Special tokens are never produced.

Defined cases: a null text is empty, and empty texts have no ids; rows are encoded one by one, so repeated rows and other
columns don't matter; ids that the vocabulary lacks fail to decode with an error.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from .common import table

MASK = (1 << 64) - 1
SPREAD, MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
#: Entries of the table of pre-tokens that a task keeps, and the longest pre-token in it.
KNOWN, KNOWN_CHARS = 300_000, 48


class PerfectHash:
    """A minimal perfect hash of byte strings onto 0..n-1, with their values."""

    def __init__(self, entries: dict[bytes, bytes]):
        keys = list(entries)
        self.n, self.r = len(keys), max(1, len(keys) // 4)
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        bucket = (hashes % np.uint64(self.r)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.r + 1))
        sizes = np.diff(cuts)
        taken, place = np.zeros(self.n, bool), np.full(self.n, -1, np.int64)
        self.shift = [0] * self.r
        free: list[int] = []
        for b in np.argsort(-sizes, kind="stable"):
            own = order[cuts[b] : cuts[b + 1]]
            if len(own) == 0:
                break
            if len(own) == 1:  # the rest take the free slots one by one
                free = free or np.flatnonzero(~taken).tolist()
                slot = free.pop()
                self.shift[b], taken[slot], place[own[0]] = -slot - 1, True, slot
                continue
            start = 1
            while True:
                d = np.arange(start, start + 512, dtype=np.uint64)
                slots = self._slots(hashes[own][:, None], d)
                good = ~taken[slots].any(0)
                ordered = np.sort(slots, 0)
                good &= (ordered[1:] != ordered[:-1]).all(0)
                if good.any():
                    k = int(good.argmax())
                    self.shift[b] = start + k
                    place[own] = slots[:, k]
                    taken[slots[:, k]] = True
                    break
                start += 512
        self.keys: list[bytes] = [b""] * self.n
        self.values = [b""] * self.n
        for k, p in zip(keys, place.tolist()):
            self.keys[p], self.values[p] = k, entries[k]

    def _slots(self, hashes: np.ndarray, shift: np.ndarray) -> np.ndarray:
        x = (hashes ^ (shift * np.uint64(SPREAD))) * np.uint64(MIX)
        return (((x >> np.uint64(32)) * np.uint64(self.n)) >> np.uint64(32)).astype(np.int64)

    def get(self, key: bytes) -> bytes | None:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.r]
        if d < 0:
            slot = -d - 1
        else:
            slot = ((((h ^ (d * SPREAD & MASK)) * MIX & MASK) >> 32) * self.n) >> 32
        return self.values[slot] if self.keys[slot] == key else None


class Vocabulary:
    """Ranks of byte strings, and the pattern that splits texts before merges. Sent to the tasks as it is."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)


class Coder:
    """Encodes and decodes; built once a Python worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.ranks = vocabulary.ranks
        self.packed = {token: rank.to_bytes(4, "little") for token, rank in self.ranks.items()}
        self.whole = PerfectHash(self.packed)
        self.split = regex.compile(vocabulary.pattern).findall
        self.known = _Known(self)
        size = max(self.ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def merge(self, piece: bytes) -> bytes:
        """The ids of a pre-token that is not an entry: the lowest rank is merged first, the leftmost of equal ones."""
        n, rank = len(piece), self.ranks.get
        pair = [rank(piece[i : i + 2], -1) for i in range(n)]  # what the part at i and the next would be
        pair[n - 1] = -1
        after, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [r << 40 | i for i, r in enumerate(pair) if r >= 0]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFFFF
            if pair[i] != top >> 40:
                continue  # one of the two parts has been merged otherwise
            j = after[i]
            end = after[i] = after[j]
            pair[i] = pair[j] = -1
            if end < n:
                before[end] = i
                r = pair[i] = rank(piece[i : after[end]], -1)
                if r >= 0:
                    heappush(heap, r << 40 | i)
            left = before[i]
            if left >= 0:
                r = pair[left] = rank(piece[left:end], -1)
                if r >= 0:
                    heappush(heap, r << 40 | left)
        out, i = [], 0
        while i < n:
            out.append(self.packed[piece[i : after[i]]])
            i = after[i]
        return b"".join(out)

    def ids(self, piece: str) -> bytes:
        raw = piece.encode()
        whole = self.whole.get(raw)
        return whole if whole is not None else self.merge(raw)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.known.__getitem__, self.split(text)))

    def count(self, text: str) -> int:
        return len(self.encode(text)) // 4

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, "<u4")
        if not len(ids):
            return b""
        lengths = self.lengths[ids]
        if not lengths.all():
            raise ValueError("an id is not in the vocabulary")
        at = np.repeat(self.starts[ids] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        return self.flat[at].tobytes()


class _Known(dict):
    def __init__(self, coder: Coder):
        super().__init__()
        self.coder = coder

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= KNOWN:
            self.clear()
        out = self.coder.ids(piece)
        if len(piece) <= KNOWN_CHARS:
            self[piece] = out
        return out


_coders: dict[int, Coder] = {}


def coder_of(broadcast) -> Coder:
    """The worker's coder for a broadcast vocabulary."""
    if broadcast.id not in _coders:
        _coders.clear()
        _coders[broadcast.id] = Coder(broadcast.value)
    return _coders[broadcast.id]


class _Sent:
    """A broadcast with a name that is the same in all tasks."""

    def __init__(self, spark: SparkSession, vocabulary: Vocabulary):
        digest = xxhash.xxh3_64(vocabulary.pattern.encode())
        for token, rank in vocabulary.ranks.items():
            digest.update(b"%d %d " % (rank, len(token)) + token)
        self.id, self.sent = digest.intdigest(), spark.sparkContext.broadcast(vocabulary)

    @property
    def value(self) -> Vocabulary:
        return self.sent.value


#: Entries of a vocabulary that may be broadcast.
MOST_ENTRIES = 2_000_000


def sent(spark: SparkSession, vocabulary: Vocabulary) -> _Sent:
    if len(vocabulary.ranks) > MOST_ENTRIES:
        raise ValueError(f"a vocabulary of more than {MOST_ENTRIES} entries is not broadcast")
    return _Sent(spark, vocabulary)


def encoded(text: Column, vocabulary: _Sent) -> Column:
    """The ids of a text column, packed."""

    @F.pandas_udf(BinaryType())
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = coder_of(vocabulary)
        for texts in parts:
            yield pd.Series([coder.encode(t) for t in texts], dtype=object)

    return encode(F.coalesce(text, F.lit("")))


def decoded(ids: Column, vocabulary: _Sent) -> Column:
    """The bytes of a column of packed ids."""

    @F.pandas_udf(BinaryType())
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = coder_of(vocabulary)
        for ids in parts:
            yield pd.Series([coder.decode(x) for x in ids], dtype=object)

    return decode(F.coalesce(ids, F.lit(b"")))


def token_count(text: Column, vocabulary: _Sent) -> Column:
    """How many ids a text has."""

    @F.pandas_udf(LongType())
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = coder_of(vocabulary)
        for texts in parts:
            yield pd.Series([coder.count(t) for t in texts], dtype="int64")

    return count(F.coalesce(text, F.lit("")))


@lru_cache(maxsize=4)
def public_vocabulary(name: str) -> Vocabulary:
    """A vocabulary file of the public tokenizers' package."""
    import public_tokenizers

    return Vocabulary.load(public_tokenizers.path(name), public_tokenizers.PATTERN)


def round_trip(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids, bytes) of each row: packed ids, and what they decode to. One Python worker a task does both."""
    words = sent(docs.sparkSession, vocabulary)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = coder_of(words)
        for frame in frames:
            ids = [coder.encode(t) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(), "ids": ids, "bytes": [coder.decode(x) for x in ids]})

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(scan, "doc_id long, ids binary, bytes binary")


N_TOKENS = "octet_length(ids) div 4"


def digests(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    return round_trip(docs, vocabulary).select("doc_id", F.expr(N_TOKENS).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return digests(table(spark, sf_dir, "documents"), public_vocabulary("byte_bpe_multi_50k.tiktoken"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: each document's ids, packed as little-endian 32-bit integers, with their number and digests.

    Columns of documents other than doc_id (text, lang, source) are not returned.
    """
    coded = round_trip(docs, public_vocabulary("byte_bpe_multi_50k.tiktoken"))
    return coded.select("doc_id", F.expr(N_TOKENS).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
