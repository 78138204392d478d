"""Language-model scoring by cross-entropy difference.

Two bigram models of the same order, smoothing and vocabulary are counted over the whole corpus: the target model over
the documents labelled good, the background model over all others. A document's score is its mean loss per token under the
target less that under the background: the lower, the more it reads like the target.

The vocabulary is every word of the corpus, or, where ``words`` is given, that many of the most frequent words with the rest
as one unknown word. Words are counted first. At most ``head`` frequent words are sent to the tasks with their counts; all
others are cold. Every bigram occurrence then goes once to a bucket that sees all of its kind: bigrams of two frequent words
by the pair, those with a cold history by that history, those with only a cold word by that word. There the counts of
the bigram and of its cold side are complete, so both losses follow at once, and sums go back to the documents. Two cases
are treated apart: bigrams so frequent that one of them would fill a bucket are counted before and scored where they are
found, and bigrams of two cold words, which lie in the buckets of both, join the history's count.

Occurrences travel packed: a row holds those of a batch of documents for a bucket, with the bytes of equal weight together.

Defined cases: null and empty texts have no tokens and get losses of 0; without target documents the target model is the
smoothing alone; several labels of one document count as good if any is; repeated rows are counted and scored each; rows
without a doc_id belong to the background.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, byte_batches, maybe_among, table, text_bytes
from .words import ALNUM, U, Words, splitmix

#: Weight of the unigram model in tokens, and frequent words that are broadcast at most (40 bytes each).
WEIGHT, HEAD = 50.0, 200_000
#: Tokens of a bucket, about, and buckets at least. A bucket is what a task holds at a time.
BUCKET_TOKENS, LEAST_BUCKETS = 1_200_000, 8
#: Bytes of text in a packed batch: this much for each bucket, within limits.
BYTES_A_BUCKET, LEAST_BATCH, MOST_BATCH = 8192, 1 << 20, 1 << 26
#: What stands for a word outside a given vocabulary, and before a first word.
UNKNOWN, START = U(2**64 - 3), U(2**64 - 2)
#: Distinct words that a task holds before it hands their counts on.
HELD = 400_000
#: Ids of target documents that are broadcast at most; beyond that documents are joined with them by a shuffle.
MOST_IDS = 1_000_000
#: Codes below this are those of frequent words; cold words go by their hash.
CODES = U(1 << 32)
#: Marks on a document's number: it belongs to the target; the occurrence only counts for its history.
GOOD, HISTORY_ONLY = np.uint32(1 << 31), np.uint32(1 << 30)
NUMBER = np.uint32((1 << 30) - 1)


def _word_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, counts = np.empty(0, U), np.empty(0, np.int64)
    for frame in byte_batches(frames):
        own, n = np.unique(Words(frame["text"].tolist(), ALNUM).hashes, return_counts=True)
        held, at = np.unique(np.concatenate([held, own]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([counts, n]), len(held)).astype(np.int64)
        if len(held) > HELD:
            yield pd.DataFrame({"word": held.view(np.int64), "n": counts})
            held, counts = np.empty(0, U), np.empty(0, np.int64)
    yield pd.DataFrame({"word": held.view(np.int64), "n": counts})


def vocabulary(docs: DataFrame, words: int) -> np.ndarray:
    """The sorted hashes of the most frequent words of all documents; equal counts go by hash."""
    counts = docs.select(text_bytes().alias("text")).mapInPandas(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.col("n").desc(), "word").limit(words).select("word").toPandas()["word"]
    return np.sort(top.to_numpy(np.int64).view(U))


def _bigrams(texts: list[bytes], known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Histories and words of some documents, and for each its document."""
    words = Words(texts, ALNUM)
    word = words.hashes
    if known is not None:
        at = np.minimum(np.searchsorted(known, word), max(len(known) - 1, 0))
        word = np.where(known[at] == word, word, UNKNOWN) if len(known) else np.full(len(word), UNKNOWN)
    lengths = np.diff(words.first)
    history = np.empty_like(word)
    history[1:] = word[:-1]
    history[words.first[:-1][lengths > 0]] = START
    return history, word, np.repeat(np.arange(len(lengths)), lengths)


def _pair(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    return splitmix(history * U(0x9E3779B97F4A7C15) ^ splitmix(word))


COUNTS = ("n", "t", "hn", "ht")


def _counted(known: np.ndarray | None):
    """For each word how often it occurs and is a history, in all documents (n, hn) and in those of the target (t, ht)."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, sums = np.empty(0, U), np.empty((0, 4))

        def out() -> pd.DataFrame:
            return pd.DataFrame({"word": held.view(np.int64), **{c: sums[:, k].astype(np.int64) for k, c in enumerate(COUNTS)}})

        for frame in byte_batches(frames):
            history, word, doc = _bigrams(frame["text"].tolist(), known)
            good = frame["good"].to_numpy(bool)[doc]
            held, at = np.unique(np.concatenate([held, word, history]), return_inverse=True)
            at = at[len(sums) :], at[: len(sums)]
            w, h = at[0][: len(word)], at[0][len(word) :]
            new = np.stack([np.bincount(x, g, len(held)) for x in (w, h) for g in (None, good)], 1).astype(float)
            new[at[1]] += sums
            sums = new
            if len(held) > HELD:
                yield out()
                held, sums = np.empty(0, U), np.empty((0, 4))
        yield out()

    return scan


def packed(x: np.ndarray) -> bytes:
    """Numbers with their bytes of equal weight together: the high ones are mostly zero."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), 1)


def unpacked(x: bytes, kind) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(x), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(flat.T).reshape(-1).view(kind)


class Head:
    """The frequent words with their counts. Their codes go by frequency, so that most are small; the last is that of START."""

    def __init__(self, rows: pd.DataFrame, start: tuple[int, int], totals: tuple[int, int], size: int, weight: float):
        rows = rows.sort_values(["n", "word"], ascending=[False, True])
        hashes = rows["word"].to_numpy(np.int64).view(U)
        self.code = np.argsort(hashes).astype(U)
        self.hashes = hashes[self.code.astype(np.int64)]
        self.n, self.t, self.hn, self.ht = (np.append(rows[c].to_numpy(float), last) for c, last in zip(COUNTS, (0, 0, *start)))
        self.totals, self.size, self.weight = totals, size, weight
        self.hot, self.hot_losses = np.empty(0, U), (np.empty(0), np.empty(0))

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """Codes of frequent words and START; the others as they are."""
        out = np.where(hashes == START, U(len(self.hashes)), hashes)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            out = np.where(self.hashes[at] == hashes, self.code[at], out)
        return out

    def losses(self, n, t, hn, ht, wn, wt) -> tuple[np.ndarray, np.ndarray]:
        """Under the target and under the background, for a bigram's, its history's and its word's counts."""
        lost = lambda pair, history, one, total: -np.log((pair + self.weight * (one + 1) / float(total + self.size)) / (history + self.weight))
        return lost(t, ht, wt, self.totals[1]), lost(n - t, hn - ht, wn - wt, self.totals[0] - self.totals[1])


def _hot_counts(head: Head, known: np.ndarray | None, frequent: np.ndarray):
    """Counts of the bigrams of two of the codes ``frequent``."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, sums = np.empty(0, U), np.empty((0, 2))
        for frame in byte_batches(frames):
            history, word, doc = _bigrams(frame["text"].tolist(), known)
            h, w = head.codes(history), head.codes(word)
            inside = np.zeros(len(head.hashes) + 1, bool)
            inside[frequent] = True
            own = (h < CODES) & (w < CODES)
            own[own] = inside[h[own].astype(np.int64)] & inside[w[own].astype(np.int64)]
            held, at = np.unique(np.concatenate([held, h[own] << U(32) | w[own]]), return_inverse=True)
            now = at[len(sums) :]
            new = np.stack([np.bincount(now, g, len(held)) for g in (None, frame["good"].to_numpy(bool)[doc[own]])], 1).astype(float)
            new[at[: len(sums)]] += sums
            sums = new
            if len(held) > HELD:
                yield pd.DataFrame({"pair": held.view(np.int64), "n": sums[:, 0].astype(np.int64), "t": sums[:, 1].astype(np.int64)})
                held, sums = np.empty(0, U), np.empty((0, 2))
        yield pd.DataFrame({"pair": held.view(np.int64), "n": sums[:, 0].astype(np.int64), "t": sums[:, 1].astype(np.int64)})

    return scan


DEALT = "bucket int, batch long, h binary, w binary, doc binary, ids array<long>, n_tokens array<long>, t array<double>, b array<double>"


def _deal(sent, known: np.ndarray | None, buckets: int):
    """The occurrences of each batch of documents by bucket, and a row with the documents themselves."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, batch = sent.value, TaskContext.get().partitionId() << 32
        for frame in byte_batches(_wide(frames, buckets), limit=_batch_bytes(buckets)):
            history, word, doc = _bigrams(frame["text"].tolist(), known)
            n = np.bincount(doc, minlength=len(frame))
            h, w, number = head.codes(history), head.codes(word), doc.astype(np.uint32)
            cold_h, cold_w = h >= CODES, w >= CODES
            sums = np.zeros((2, len(frame)))
            left = np.ones(len(h), bool)
            if len(head.hot):
                pair = h << U(32) | w
                at = np.minimum(np.searchsorted(head.hot, pair), len(head.hot) - 1)
                hit = ~cold_h & ~cold_w & (head.hot[at] == pair)
                sums = np.stack([np.bincount(doc[hit], x[at[hit]], len(frame)) for x in head.hot_losses])
                left = ~hit
            number |= np.where(frame["good"].to_numpy(bool)[doc], GOOD, np.uint32(0))
            to = np.where(cold_h & ~cold_w, splitmix(h), np.where(cold_w, splitmix(w), splitmix(h << U(32) | w)))
            twice = cold_h & cold_w  # the history's bucket needs them too
            h, w, number, to = (np.concatenate(x) for x in ((h[left], h[twice]), (w[left], w[twice]), (number[left], number[twice] | HISTORY_ONLY), (to[left], splitmix(h[twice]))))
            bucket = (to % U(buckets)).astype(np.int64)
            order = np.lexsort((w, h, bucket))
            h, w, number, bucket = h[order], w[order], number[order], bucket[order]
            there, cuts = np.unique(bucket, return_index=True)
            parts = list(zip(there.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(bucket)]))
            yield pd.DataFrame({"bucket": [p[0] for p in parts], "batch": batch, **{k: [packed(x[a:b]) for _, a, b in parts] for k, x in (("h", h), ("w", w), ("doc", number))}, "ids": None, "n_tokens": None, "t": None, "b": None})
            ids = [None if pd.isna(x) else int(x) for x in frame["doc_id"]]
            yield pd.DataFrame({"bucket": [int(batch % buckets)], "batch": batch, "h": None, "w": None, "doc": None, "ids": [ids], "n_tokens": [n], "t": [sums[0]], "b": [sums[1]]})
            batch += 1

    return scan


def _batch_bytes(buckets: int) -> int:
    return min(max(buckets * BYTES_A_BUCKET, LEAST_BATCH), MOST_BATCH)


def _wide(frames: Iterator[pd.DataFrame], buckets: int) -> Iterator[pd.DataFrame]:
    """Frames put together until they hold a batch."""
    held, size = [], 0
    for frame in frames:
        held.append(frame)
        size += int(frame["text"].map(len).sum())
        if size >= _batch_bytes(buckets):
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


#: What comes back of occurrences of two cold words: the history, the document, and the counts that are complete.
COLD = {"history": np.int64, "c_doc": np.uint32, "c_n": np.int64, "c_t": np.int64, "c_wn": np.int64, "c_wt": np.int64}
SUMMED = "batch long, doc binary, t binary, b binary, ids array<long>, n_tokens array<long>, own_t array<double>, own_b array<double>, " + ", ".join(f"{c} binary" for c in COLD)


def _complete(keys: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row how many rows have its key, and how many of those are of the target."""
    _, at = np.unique(keys, return_inverse=True)
    return np.bincount(at)[at], np.bincount(at, good)[at]


def _split(batches: np.ndarray, batch: np.ndarray, columns: dict[str, np.ndarray]) -> pd.DataFrame:
    """A row with packed columns for each batch. batch: places among batches, in order."""
    there, cuts = np.unique(batch, return_index=True)
    ends = [*cuts[1:].tolist(), len(batch)]
    return pd.DataFrame({"batch": batches[there.astype(np.int64)], **{c: [packed(x[a:b]) for a, b in zip(cuts.tolist(), ends)] for c, x in columns.items()}})


def _in_bucket(sent):
    """Losses of a bucket's occurrences, summed by document; those of two cold words come out with what is known."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        head = sent.value
        docs, rows = frame[frame["ids"].notna()], frame[frame["h"].notna()]
        out = [pd.DataFrame({"batch": docs["batch"].to_numpy(), "ids": docs["ids"].tolist(), "n_tokens": docs["n_tokens"].tolist(), "own_t": docs["t"].tolist(), "own_b": docs["b"].tolist()})]
        if len(rows):
            h, w, doc = ([unpacked(x, kind) for x in rows[c]] for c, kind in (("h", U), ("w", U), ("doc", np.uint32)))
            batch = np.repeat(np.arange(len(rows)), [len(x) for x in h])
            h, w, doc = np.concatenate(h), np.concatenate(w), np.concatenate(doc)
            good, history_only, number = (doc & GOOD) > 0, (doc & HISTORY_ONLY) > 0, doc & NUMBER
            cold_h, cold_w = h >= CODES, w >= CODES
            by_history, by_word = np.flatnonzero(cold_h & (~cold_w | history_only)), np.flatnonzero(cold_w & ~history_only)
            n, t = _complete(_pair(h, w) ^ history_only.astype(U), good)
            hn, ht, wn, wt = (np.zeros(len(h)) for _ in range(4))
            at = np.where(cold_h, 0, h).astype(np.int64)
            hn, ht = np.where(cold_h, 0, head.hn[at]), np.where(cold_h, 0, head.ht[at])
            at = np.where(cold_w, 0, w).astype(np.int64)
            wn, wt = np.where(cold_w, 0, head.n[at]), np.where(cold_w, 0, head.t[at])
            hn[by_history], ht[by_history] = _complete(h[by_history], good[by_history])
            wn[by_word], wt[by_word] = _complete(w[by_word], good[by_word])
            del good, doc, at
            known = np.flatnonzero(~history_only & ~(cold_h & cold_w))
            target, background = head.losses(*(x[known] for x in (n, t, hn, ht, wn, wt)))
            key, at = np.unique(batch[known] << 32 | number[known], return_inverse=True)
            sums = [np.bincount(at, x, len(key)).astype(np.float32) for x in (target, background)]
            out.append(_split(rows["batch"].to_numpy(), key >> 32, {"doc": (key & 0xFFFFFFFF).astype(np.uint32), "t": sums[0], "b": sums[1]}))
            both = np.flatnonzero(cold_h & cold_w & ~history_only)
            both = both[np.argsort(batch[both], kind="stable")]
            out.append(_split(rows["batch"].to_numpy(), batch[both], {c: x[both].astype(kind) for (c, kind), x in zip(COLD.items(), (h.view(np.int64), number, n, t, wn, wt))}))
        columns = [c.split()[0] for c in SUMMED.split(", ")]
        whole = pd.concat([x.reindex(columns=columns).astype(object) for x in out], ignore_index=True)
        return whole.where(whole.notna(), None).astype({"batch": "int64"})

    return work


SCORED = "batch long, doc long, doc_id long, n_tokens long, t double, b double, cold array<struct<history:long,n:long,t:long,wn:long,wt:long>>"


def _by_batch(frame: pd.DataFrame) -> pd.DataFrame:
    """The sums of a batch's documents, and their occurrences of two cold words."""
    docs = frame[frame["ids"].notna()].iloc[0]
    t, b = np.array(docs["own_t"], float), np.array(docs["own_b"], float)
    for part in frame[frame["doc"].notna()].itertuples():
        at = unpacked(part.doc, np.uint32)
        t[at] += unpacked(part.t, np.float32)
        b[at] += unpacked(part.b, np.float32)
    cold: list[list[dict]] = [[] for _ in t]
    for part in frame[frame["history"].notna()].itertuples():
        history, doc, *rest = (unpacked(getattr(part, c), kind).tolist() for c, kind in COLD.items())
        for d, *x in zip(doc, history, *rest):
            cold[d].append(dict(zip(("history", "n", "t", "wn", "wt"), x)))
    return pd.DataFrame({"batch": docs["batch"], "doc": np.arange(len(t)), "doc_id": pd.array(docs["ids"], "Int64"), "n_tokens": docs["n_tokens"], "t": t, "b": b, "cold": cold})


def flagged(docs: DataFrame, target: DataFrame, scratch: Scratch, most_ids: int = MOST_IDS) -> DataFrame:
    """(doc_id, text, good): texts as bytes.

    Up to ``most_ids`` ids of the target are broadcast. Of more, only rows that a filter can't tell from the target's are shuffled.
    """
    wanted = scratch.write(target.select(F.col("doc_id").cast("long").alias("id")).where("id IS NOT NULL").distinct())
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_bytes().alias("text"))
    if wanted.count() <= most_ids:
        return rows.join(F.broadcast(wanted.withColumn("__good", F.lit(True))), "id", "left").select(F.col("id").alias("doc_id"), "text", F.coalesce("__good", F.lit(False)).alias("good"))
    marked = maybe_among(rows, wanted)
    near = marked.where("__maybe").join(wanted.withColumn("__good", F.lit(True)), "id", "left").select(F.col("id").alias("doc_id"), "text", F.coalesce("__good", F.lit(False)).alias("good"))
    return marked.where("NOT __maybe").select(F.col("id").alias("doc_id"), "text", F.lit(False).alias("good")).unionAll(scratch.write(near))


def head_of(counts: DataFrame, known: np.ndarray | None, head: int, weight: float) -> tuple[Head, int]:
    """The frequent words, and the least count among them. counts: (word, n, t, hn, ht) of every word and of START."""
    start, words = F.col("word") == int(START.view(np.int64)), F.col("word") != int(START.view(np.int64))
    total = counts.agg(F.count_if(words).alias("words"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "t")), *(F.coalesce(F.sum(F.when(start, F.col(c))), F.lit(0)).alias(c) for c in ("hn", "ht"))).first()
    # the least count with which no more than ``head`` words are frequent; counts beyond a million are one step
    steps = counts.where(words).groupBy(F.least("n", F.lit(1_000_000)).alias("n")).agg(F.count("*").alias("words")).orderBy(F.desc("n")).toPandas()
    fits = steps["n"][steps["words"].cumsum() <= head]
    least = int(fits.min()) if len(fits) else 1 << 62
    rows = counts.where(words & (F.col("n") >= least)).toPandas()  # at most ``head``
    size = (total["words"] if known is None else len(known)) + 1
    return Head(rows, (total["hn"], total["ht"]), (total["n"], total["t"]), size, weight), least


def cross_entropy_difference(docs: DataFrame, target: DataFrame, words: int | None = None, head: int = HEAD, weight: float = WEIGHT, buckets: int | None = None, most_ids: int = MOST_IDS) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, difference) of all documents, by the models that all documents make."""
    if words is not None and words <= 0:
        raise ValueError("words must be positive")
    spark = docs.sparkSession
    known = None if words is None else vocabulary(docs, words)
    scratch = Scratch(spark, "lm")
    texts = flagged(docs, target, scratch, most_ids)
    counted = texts.select("text", "good").mapInPandas(_counted(known), "word long, " + ", ".join(f"{c} long" for c in COUNTS))
    counts = scratch.write(counted.groupBy("word").agg(*(F.sum(c).alias(c) for c in COUNTS)))
    model, least = head_of(counts, known, head, weight)
    buckets = buckets or max(LEAST_BUCKETS, -(-model.totals[0] // BUCKET_TOKENS))

    # a bigram can fill an eighth of a bucket only if both words do: at most 8 * buckets of them are counted before
    share = model.totals[0] / (8 * buckets)
    frequent = np.flatnonzero(np.maximum(model.n, model.hn) >= max(share, 2))
    if len(frequent):
        pairs = texts.select("text", "good").mapInPandas(_hot_counts(model, known, frequent), "pair long, n long, t long")
        hot = pairs.groupBy("pair").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).where(F.col("n") >= share).toPandas()
        hot = hot.sort_values("pair")  # codes are small, so pairs are positive
        model.hot = hot["pair"].to_numpy(np.int64).view(U)
        h, w = (model.hot >> U(32)).astype(np.int64), (model.hot & U(0xFFFFFFFF)).astype(np.int64)
        model.hot_losses = model.losses(hot["n"].to_numpy(float), hot["t"].to_numpy(float), model.hn[h], model.ht[h], model.n[w], model.t[w])
    sent = spark.sparkContext.broadcast(model)  # at most ``head`` words and 8 * buckets bigrams

    dealt = texts.mapInPandas(_deal(sent, known, buckets), DEALT)
    summed = dealt.groupBy("bucket").applyInPandas(_in_bucket(sent), SUMMED)
    merged = scratch.write(summed.groupBy("batch").applyInPandas(_by_batch, SCORED))
    cold = merged.where(F.size("cold") > 0).select("batch", "doc", F.explode("cold").alias("c")).select("batch", "doc", "c.*")
    rare = counts.where(F.col("n") < least).select(F.col("word").alias("history"), "hn", "ht")
    lost = lambda pair, history, one, total: -F.log((pair + weight * (one + 1) / float(total + model.size)) / (history + weight))
    all_, own = model.totals
    t2 = lost(F.col("t"), F.col("ht"), F.col("wt"), own)
    b2 = lost(F.col("n") - F.col("t"), F.col("hn") - F.col("ht"), F.col("wn") - F.col("wt"), all_ - own)
    more = cold.join(rare, "history").groupBy("batch", "doc").agg(F.sum(t2).alias("t2"), F.sum(b2).alias("b2"))
    mean = lambda c: (F.col(c) + F.coalesce(F.col(c + "2"), F.lit(0.0))) / F.greatest("n_tokens", F.lit(1))
    out = merged.drop("cold").join(more, ["batch", "doc"], "left").select("doc_id", "n_tokens", mean("t").alias("target_loss"), mean("b").alias("background_loss"))
    return out.withColumn("difference", F.col("target_loss") - F.col("background_loss"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, difference of every document."""
    target = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return cross_entropy_difference(table(spark, sf_dir, "documents"), target)
