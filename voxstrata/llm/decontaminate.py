"""Benchmark decontamination by suffix arrays over the training documents.

Each task cuts its documents into shards, sorts all suffixes of a shard's words (prefix doubling, to ``DEPTH`` words)
and looks up the benchmark's suffixes by binary search: equal windows of ``window`` words are folded into one, with all
their places in the benchmark, so a shard has at most one occurrence a position for each length of window. Only windows
whose hash is among those of the shard's own windows are searched, so a shard's time depends on its own words, and on the
benchmark's by a logarithm alone. From a position
that no earlier match covers, the longest verbatim match is found by binary search among the places of its window, which
are in the order of their own suffixes. Time and memory are linear in the words of both, up to logarithms. No document is
shuffled. The benchmark is broadcast only while its words are under ``BENCH_WORDS``; beyond that it is gone through in
slices of that size, a pass over the documents each, with what was found so far written in between.

Defined cases: null and empty texts have no words and are never hit; an item with fewer words than the window is one
window of all of them; an item without words matches nothing; repeated rows are treated alike, each by itself; a
document longer than a shard is a shard of its own; items without an item_id take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, byte_batches, table, text_bytes
from .words import ALNUM, Words, splitmix, windows

#: Words by which suffixes are sorted; windows are no longer than that.
DEPTH = 16
#: Benchmark words that are broadcast at once (some 60 bytes a word).
BENCH_WORDS = 4_000_000
#: Bytes of text in a shard, about.
SHARD_BYTES = 1 << 20


@dataclass
class Suffixes:
    """The distinct windows of benchmark items, and where they are.

    ``words`` of all items, one after the other; ``end`` is where the item of a word ends. Window d is
    ``words[start[d]:start[d] + length[d]]``; its places are ``place[first[d]:first[d + 1]]``, in the order of the suffixes that
    begin there. ``keys`` are the windows' hashes, ascending, and ``sizes`` their different lengths. Windows with the same items share a ``group``, whose items are ``items[cut[g]:cut[g + 1]]``.
    """

    words: np.ndarray
    end: np.ndarray
    item_of: np.ndarray
    start: np.ndarray
    length: np.ndarray
    keys: np.ndarray
    sizes: np.ndarray
    first: np.ndarray
    place: np.ndarray
    group: np.ndarray
    cut: np.ndarray
    items: np.ndarray

    @classmethod
    def of(cls, ids: list[int], texts: list[bytes], window: int) -> Suffixes:
        w = Words(texts, ALNUM)
        ids_, sizes = np.asarray(ids, np.int64), np.diff(w.first)
        item = np.repeat(np.arange(len(texts)), sizes)
        end = w.first[1:][item]
        whole = np.flatnonzero(np.arange(len(item)) + window <= end)
        start, length = [whole], [np.full(len(whole), window)]
        keys = [windows(w.hashes, window)[whole]]
        for i in np.flatnonzero((sizes > 0) & (sizes < window)):
            start.append(w.first[i : i + 1])
            length.append(sizes[i : i + 1])
            keys.append(windows(w.of(i), int(sizes[i])))
        start, length, keys = np.concatenate(start).astype(np.int64), np.concatenate(length).astype(np.int64), np.concatenate(keys)
        # the order of all suffixes, each cut at the end of its item
        _, rank = np.unique(w.hashes, return_inverse=True)
        spaced = np.zeros(len(rank) + len(texts), np.int64)
        spaced[np.arange(len(rank)) + item] = rank + 1
        order = np.empty(len(spaced), np.int64)
        order[suffix_array(spaced, 1 << int(max(sizes, default=1)).bit_length())] = np.arange(len(spaced))
        by = np.lexsort((order[start + item[start]] if len(start) else start, keys))
        start, length, keys = start[by], length[by], keys[by]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        first, of = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        # windows with the same items
        pairs = np.unique(np.stack([of, item[start]], 1), axis=0) if len(of) else np.empty((0, 2), np.int64)
        cuts = np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))
        mark = splitmix(pairs[:, 1].astype(np.uint64) + np.uint64(1 << 54))
        with np.errstate(over="ignore"):
            marks = np.add.reduceat(mark, cuts[:-1]) if len(first) else np.empty(0, np.uint64)
        _, one, group = np.unique(marks, return_index=True, return_inverse=True)
        items = [ids_[pairs[cuts[d] : cuts[d + 1], 1]] for d in one]
        return cls(w.hashes, end, ids_[item], start[first], length[first], keys[first], np.unique(length), np.append(first, len(start)), start, group, np.cumsum([0, *map(len, items)]), np.concatenate([*items, np.empty(0, np.int64)]))

    def longest(self, d: int, words: np.ndarray) -> tuple[int, int]:
        """A place of window d, and how many words from there on equal those given; none goes on for longer.

        The place next to where the words would stand in the order of suffixes is among those that the search visits.
        """
        low, high, n = int(self.first[d]), int(self.first[d + 1]), int(self.length[d])
        best = (int(self.place[low]), 0)
        while low < high:
            mid = (low + high) // 2
            at = int(self.place[mid])
            same = n + _agree(self.words[at + n : self.end[at]], words[n:])
            if same > best[1]:
                best = (at, same)
            if same == len(words):
                break
            if at + same == self.end[at] or self.words[at + same] < words[same]:
                low = mid + 1
            else:
                high = mid
        return best


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading words are the same."""
    n, at, step = min(len(a), len(b)), 0, 16
    while at < n:
        differ = a[at : min(at + step, n)] != b[at : min(at + step, n)]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, step * 2
    return n


def suffix_array(ranks: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Starts of suffixes in the order of their first ``depth`` ranks (a power of two); beyond the end comes rank 0."""
    rank, step, n = ranks.astype(np.int64), 1, len(ranks)
    order = np.argsort(rank, kind="stable")
    while step < depth:
        pair = rank * (n + 1)
        pair[:-step] += rank[step:] if step < n else 0
        order = np.argsort(pair, kind="stable")
        ordered = pair[order]
        fresh = np.ones(n, np.int64)
        fresh[1:] = ordered[1:] != ordered[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        if rank.max(initial=0) == n:
            break
        step *= 2
        if step >= n:
            break
    return order


class Shard:
    """A suffix array over the words of some documents."""

    def __init__(self, words: Words):
        n = len(words)
        counts = np.diff(words.first)
        # a separator after each document, with a rank that no word has
        self.doc = np.repeat(np.arange(n), counts + 1)
        self.first = np.cumsum(counts + 1) - (counts + 1)
        self.place = np.arange(len(self.doc)) - np.repeat(self.first, counts + 1)
        is_word = self.place < np.repeat(counts, counts + 1)
        self.vocabulary, inverse = np.unique(words.hashes, return_inverse=True)
        self.ranks = np.ones(len(self.doc), np.int64)
        self.ranks[is_word] = inverse + 2
        self.array = suffix_array(self.ranks)
        self.padded = np.concatenate([self.ranks, np.zeros(DEPTH, np.int64)])
        self.hashes = np.zeros(len(self.doc), np.uint64)
        self.hashes[is_word] = words.hashes

    def known(self, bench: Suffixes) -> np.ndarray:
        """The benchmark's windows whose hash is that of a window of the shard: all that occur, hardly any other."""
        found = [np.empty(0, np.int64)]
        for n in bench.sizes:
            own = np.unique(windows(self.hashes, int(n)))
            at = np.searchsorted(bench.keys, own)
            at[at == len(bench.keys)] = 0
            found.append(at[bench.keys[at] == own])
        return np.unique(np.concatenate(found))

    def bound(self, query: np.ndarray, length: np.ndarray, right: bool) -> np.ndarray:
        """For each query (rows of ranks) how many suffixes are less, or not greater, by its first ``length`` words."""
        low, high = np.zeros(len(query), np.int64), np.full(len(query), len(self.array), np.int64)
        while True:
            open_ = low < high
            if not open_.any():
                return low
            mid = (low + high) // 2
            at = self.array[np.minimum(mid, len(self.array) - 1)]
            less, tied = np.zeros(len(query), bool), np.ones(len(query), bool)
            for k in range(query.shape[1]):
                tied_here = tied & (k < length)
                if not tied_here.any():
                    break
                x = self.padded[at + k]
                less |= tied_here & (x < query[:, k])
                tied &= ~tied_here | (x == query[:, k])
            go_right = open_ & (less | (tied if right else False))
            low = np.where(go_right, mid + 1, low)
            high = np.where(open_ & ~go_right, mid, high)

    def matches(self, bench: Suffixes) -> tuple[np.ndarray, np.ndarray]:
        """(window, position): each occurrence of a distinct window, by position."""
        none = np.empty(0, np.int64)
        if not len(self.vocabulary) or not len(bench.start):
            return none, none
        alive = self.known(bench)
        if not len(alive):
            return none, none
        width = int(bench.length[alive].max())
        asked = bench.words[np.minimum(bench.start[alive][:, None] + np.arange(width), len(bench.words) - 1)]
        at = np.searchsorted(self.vocabulary, asked)
        at[at == len(self.vocabulary)] = 0
        query = np.where(self.vocabulary[at] == asked, at + 2, -1)  # -1 is no word's rank
        low, high = self.bound(query, bench.length[alive], False), self.bound(query, bench.length[alive], True)
        counts = high - low
        window = np.repeat(alive, counts)
        at = self.array[np.repeat(low, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)]
        order = np.lexsort((-bench.length[window], at))
        return window[order], at[order]


STATE = "doc_id long, text binary, n_words long, covered binary, n_hit long, items array<long>, spans array<struct<item_id:long,start:long,words:long>>"


def _spans(bench: Suffixes, words: np.ndarray, window: list[int], place: list[int]) -> list[dict]:
    """Longest matches from left to right; those that lie wholly within one before are left out. window, place: by place."""
    out, over = [], 0
    for d, p in zip(window, place):
        if p + int(bench.length[d]) <= over:
            continue
        at, n = bench.longest(d, words[p:])
        out.append({"item_id": int(bench.item_of[at]), "start": p, "words": n})
        over = p + n
    return out


def _scan(sent):
    """Adds what one slice of the benchmark finds to the state of each document."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bench = sent.value
        for frame in byte_batches(frames, limit=SHARD_BYTES):
            words = Words(frame["text"].tolist(), ALNUM)
            shard = Shard(words)
            window, at = shard.matches(bench)
            edges = np.zeros(len(shard.doc) + 1, np.int64)
            np.add.at(edges, at, 1)
            np.add.at(edges, at + bench.length[window], -1)
            hit = np.cumsum(edges[:-1]) > 0
            cuts = np.searchsorted(shard.doc[at], np.arange(len(words) + 1))
            covered, items, spans = [], [], []
            for i, (before, old_items, old_spans) in enumerate(zip(frame["covered"], frame["items"], frame["spans"])):
                bits = hit[shard.first[i] : shard.first[i] + words.first[i + 1] - words.first[i]]
                if len(before):
                    bits = bits | np.unpackbits(np.frombuffer(before, np.uint8), count=len(bits)).astype(bool)
                covered.append(bits)
                here = slice(cuts[i], cuts[i + 1])
                groups = np.unique(bench.group[window[here]])
                own = np.unique(np.concatenate([*(bench.items[bench.cut[g] : bench.cut[g + 1]] for g in groups), np.asarray(old_items, np.int64)]))
                items.append(own.tolist())
                spans.append([*old_spans, *_spans(bench, words.of(i), window[here].tolist(), shard.place[at[here]].tolist())])
            yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(), "text": frame["text"].to_numpy(), "n_words": np.diff(words.first), "covered": [np.packbits(x).tobytes() for x in covered], "n_hit": [int(x.sum()) for x in covered], "items": items, "spans": spans})

    return scan


def _slices(benchmark: DataFrame, window: int, limit: int) -> Iterator[Suffixes]:
    """The benchmark, in slices of at most ``limit`` words or one item."""
    ids, texts, n = [], [], 0
    for r in benchmark.where("item_id IS NOT NULL").select("item_id", text_bytes()).toDF("item_id", "text").toLocalIterator():
        size = len(r["text"]) // 2 + 1
        if ids and n + size > limit:
            yield Suffixes.of(ids, texts, window)
            ids, texts, n = [], [], 0
        ids.append(r["item_id"])
        texts.append(bytes(r["text"]))
        n += size
    yield Suffixes.of(ids, texts, window)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, bench_words: int = BENCH_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit (words in an occurrence of a window), items, and the longest verbatim matches.

    ``spans`` lists (item, first word in the document, words), from left to right, by slice of the benchmark: from each
    window that no match before covers wholly, the longest match, with one of the items that have it.
    """
    if not 1 <= window <= DEPTH:
        raise ValueError(f"window must be from 1 to {DEPTH}")
    empty = {"n_words": F.lit(0).cast("long"), "covered": F.lit(b""), "n_hit": F.lit(0).cast("long"), "items": F.array().cast("array<long>"), "spans": F.array().cast("array<struct<item_id:long,start:long,words:long>>")}
    found = docs.select("doc_id", text_bytes().alias("text"), *(c.alias(k) for k, c in empty.items()))
    found = _in_turn(found, _slices(benchmark, window, bench_words), lambda df, sent: df.mapInPandas(_scan(sent), STATE))
    return found.select("doc_id", "n_words", "n_hit", "items", "spans")


def _in_turn(df: DataFrame, slices: Iterator[Suffixes], apply) -> DataFrame:
    """apply(df, broadcast) for one slice after the other; what came of one is written before the next is sent."""
    scratch, last, sent = Scratch(df.sparkSession, "decontaminate"), None, None
    for one in slices:
        if sent is not None:
            df = scratch.write(df)
            sent.unpersist()
            if last is not None:
                scratch.drop(last)
            last = df
        sent = df.sparkSession.sparkContext.broadcast(one)
        df = apply(df, sent)
    return df


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _clean_rows(sent, text: int):
    """Filters whole rows in place, so that no document is shuffled or joined back. text: the place of that column."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x.encode() if x else b"" for x in batch.column(text).to_pylist()]
            bad = np.zeros(len(raw), bool)
            for part in byte_batches([pd.DataFrame({"text": raw})], limit=SHARD_BYTES):
                shard = Shard(Words(part["text"].tolist(), ALNUM))
                _, at = shard.matches(sent.value)
                bad[part.index.to_numpy()[shard.doc[at]]] = True
            yield batch.filter(pa.array(~bad))

    return scan


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, bench_words: int = BENCH_WORDS) -> DataFrame:
    """The rows of documents, in all their columns, in which no window of the benchmark occurs."""
    return _in_turn(docs, _slices(benchmark, window, bench_words), lambda df, sent: df.mapInArrow(_clean_rows(sent, docs.columns.index("text")), docs.schema))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no window of the benchmark occurs."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


OP8_SQL = r"""
WITH ascii AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, ascii),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, ascii
  WHERE item_id IS NOT NULL),
window_of AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
  FROM item, UNNEST(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
size AS (SELECT DISTINCT n FROM window_of),
place AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM doc, size, UNNEST(range(1, len(w) - n + 2)) AS t(i)),
found AS (SELECT p.doc_id, p.i, p.n, x.item_id FROM place p JOIN window_of x ON p.n = x.n AND p.s = x.s),
hit AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT DISTINCT doc_id, i, n FROM found), UNNEST(range(i, i + n)) AS t(k) GROUP BY doc_id),
own AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)
"""
