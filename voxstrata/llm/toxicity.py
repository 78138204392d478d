"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic examples and unlabelled text are learnt from. A linear classifier over the words that a text holds
minimises ``prior * loss(positives as 1) + max(0, loss(unlabelled as 0) - prior * loss(positives as 0))``: the second
part estimates the negatives' risk, and where it falls below zero, a sign of overfitting, the step is taken the other
way. The loss is logistic, so the score is an estimate of the probability.

The positives are a bounded sample of the labelled rows (``positives`` confirmed ones, by a hash of the doc_id). The vocabulary
and the unlabelled risk are over all documents of the training folds, one row an id: words are counted in all of them, every
document's columns of the vocabulary are written once in packed form, and passes over that table sum the risk and its
gradient. So that few passes do, each step is taken on the driver by a surrogate (Jordan, Lee and Yang's): the risk over
``unlabelled`` documents, plus the linear term that makes its value and gradient at the current weights those of all documents.
``PASSES`` rounds bring the risk over all documents down; the sample only says how it curves. Where the corrected negative
risk is held at zero the minimum isn't unique, so weights still depend on the steps taken. Sums are of whole numbers, so that the result doesn't depend on partitions. At most ``most_bytes`` of columns go to the driver. The class
prior, unless given, is the share of toxic rows among the labelled rows of the training folds. Every document is scored on its
whole text.

Defined cases: null and empty texts have no words and get the score of the bias alone; without confirmed examples the
score is the prior, or 0 without one, as it is where no word tells positives from the rest; several labels of one document count as toxic if any is; repeated rows get equal
scores; rows without a doc_id are scored, and count as not held out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FIT_BYTES, Scratch, byte_batches, crc_mod, fitting_rows, maybe_among, table, text_bytes
from .words import ALNUM, Words

#: Confirmed rows, documents that tell how the risk curves, and words in the vocabulary, at most.
POSITIVES, UNLABELLED, VOCABULARY, LEAST_DF, LEAST_Z = 4000, 12000, 1 << 16, 4, 4.0
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
SEED = 11
#: Passes over all documents' columns, and steps of the descent before and between them.
PASSES, STEPS, STEPS_BETWEEN = 4, 200, 80
#: A word's occurrences that a task holds at most before it counts them, bytes of packed columns in a row, the unit of sums.
HELD, PACKED_BYTES, UNIT = 1 << 21, 4 << 20, 1 << 24


def word_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The distinct words of each text, as sorted hashes."""
    words = Words(texts, ALNUM)
    for i in range(len(words)):
        yield np.unique(words.of(i))


def _columns(s: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The places among ``words`` of those of a sorted set that are there."""
    if not len(words):
        return np.empty(0, np.int32)
    at = np.searchsorted(words, s)
    at[at == len(words)] = 0
    return at[words[at] == s].astype(np.int32)


@dataclass
class Classifier:
    """Sorted word hashes, their weights, and the bias."""

    words: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, sets: Iterator[np.ndarray]) -> np.ndarray:
        out = []
        for s in sets:
            total = self.bias
            if len(s) and len(self.words):
                at = np.searchsorted(self.words, s)
                at[at == len(self.words)] = 0
                total += float(self.weights[at[self.words[at] == s]].sum())
            out.append(total)
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


class Rows:
    """The columns of some documents as one array, and the row of each."""

    def __init__(self, columns: list[np.ndarray]):
        self.n, self.columns = len(columns), np.concatenate([*columns, np.empty(0, np.int32)]).astype(np.int64)
        self.row = np.repeat(np.arange(self.n), [len(k) for k in columns])

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.columns], self.n)

    def gradient(self, by_row: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.columns, by_row[self.row], size)

    def as_zero(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        """The mean loss of taking every row as 0, and its slope by weight, the bias last."""
        z = self.times(theta[:-1]) + theta[-1]
        by_row = sigmoid(z) / self.n
        return float(np.logaddexp(0, z).mean()), np.append(self.gradient(by_row, len(theta) - 1), by_row.sum())


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def z_scores(in_p: np.ndarray, in_u: np.ndarray, n: int, m: int) -> np.ndarray:
    """By how many standard errors the words' shares of the n positive and of the m unlabelled rows differ.

    What differs by little is too rare, or too evenly spread, for its weight to be more than noise; -1 for words in too few rows.
    """
    share = (in_p + in_u + 1) / (n + m + 2)
    z = np.abs(in_p / n - in_u / m) / np.sqrt(share * (1 - share) * (1 / n + 1 / m))
    return np.where(in_p + in_u >= LEAST_DF, z, -1.0)


def descend(p: Rows, u: Rows, theta: np.ndarray, prior: float, steps: int, rate: float = 0.05, decay: float = 3e-4, beta: float = 0.0, whole: tuple[float, np.ndarray] | None = None) -> np.ndarray:
    """Full-batch Adam from theta (weights, bias) on the non-negative risk.

    whole: the unlabelled loss and slope at theta over all documents; the loss over u is tilted so that it has these there.
    """
    start, m, v = theta, np.zeros(len(theta)), np.zeros(len(theta))
    tilt_value, tilt = 0.0, np.zeros(len(theta))
    if whole is not None:
        own = u.as_zero(theta)
        tilt_value, tilt = whole[0] - own[0], whole[1] - own[1]
    for step in range(1, steps + 1):
        zp = p.times(theta[:-1]) + theta[-1]
        as_one, as_zero = (sigmoid(zp) - 1) / p.n, sigmoid(zp) / p.n  # slopes of the positives' two losses
        loss, rest = u.as_zero(theta)
        loss, rest = loss + tilt_value + float(tilt @ (theta - start)), rest + tilt
        if loss - prior * np.logaddexp(0, zp).mean() >= -beta:
            by_p, sign = prior * (as_one - as_zero), 1.0
        else:
            by_p, sign = prior * as_zero, -1.0
        slope = np.append(p.gradient(by_p, len(theta) - 1) + decay * theta[:-1], by_p.sum()) + sign * rest
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if whole is not None:
            move = move * (1 - (step - 1) / steps)  # so that it comes to rest
        theta = theta - move
    return theta


def _prior_only(prior: float) -> Classifier:
    return Classifier(np.empty(0, np.uint64), np.empty(0), float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9))))


def _flat(size: int, prior: float) -> np.ndarray:
    return np.append(np.zeros(size), np.log(prior / (1 - prior)))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, **options) -> Classifier:
    """Non-negative PU learning from word sets in memory."""
    if not positive or not unlabelled or not sum(map(len, positive)):
        return _prior_only(prior)
    found, at = np.unique(np.concatenate(positive + unlabelled), return_inverse=True)
    cut = sum(map(len, positive))
    z = z_scores(np.bincount(at[:cut], minlength=len(found)), np.bincount(at[cut:], minlength=len(found)), len(positive), len(unlabelled))
    telling = np.flatnonzero(z >= LEAST_Z)
    words = found[np.sort(telling[np.argsort(-z[telling], kind="stable")[:VOCABULARY]])]
    if not len(words):  # no word tells the two apart: there is only the prior
        return _prior_only(prior)
    p, u = (Rows([_columns(s, words) for s in sets]) for sets in (positive, unlabelled))
    theta = descend(p, u, _flat(len(words), prior), prior, options.pop("steps", STEPS), **options)
    return Classifier(words, theta[:-1], float(theta[-1]))


def _one_an_id(docs: DataFrame, by_id: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id and text: all rows whose id is there once as they are; of others the least text. Only ids are shuffled for it."""
    often = scratch.write(by_id.where("rows > 1").select("doc_id"))
    marked = maybe_among(docs, often, key="doc_id")
    least = scratch.write(marked.where("__maybe").groupBy("doc_id").agg(F.min("text").alias("text")))
    return marked.where("NOT __maybe").select("doc_id", "text").unionByName(least)


def _count_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many rows hold each word, and how many of the positive ones."""

    def counted(all_: list[np.ndarray], bad: list[np.ndarray]) -> pd.DataFrame:
        words, in_u = np.unique(np.concatenate(all_), return_counts=True)
        in_p = np.zeros(len(words), np.int64)
        found, n = np.unique(np.concatenate([*bad, np.empty(0, np.uint64)]), return_counts=True)
        in_p[np.searchsorted(words, found)] = n
        return pd.DataFrame({"word": words.view(np.int64), "in_p": in_p, "in_u": in_u})

    all_, bad, held = [], [], 0
    for frame in byte_batches(frames):
        for s, positive in zip(word_sets(frame["text"].tolist()), frame["positive"]):
            all_.append(s)
            held += len(s)
            if positive:
                bad.append(s)
        if held > HELD:
            yield counted(all_, bad)
            all_, bad, held = [], [], 0
    if all_:
        yield counted(all_, bad)


def vocabulary(rows: DataFrame, positives: DataFrame, n: int, m: int) -> np.ndarray:
    """The telling words, by counts over all rows (doc_id, text), as sorted hashes; at most VOCABULARY."""
    marked = rows.join(F.broadcast(positives.select("doc_id", F.lit(True).alias("positive"))), "doc_id", "left")
    counts = marked.select(text_bytes().alias("text"), F.coalesce("positive", F.lit(False)).alias("positive")).mapInPandas(_count_words, "word long, in_p long, in_u long")

    def scores(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"word": f["word"], "z": z_scores(f["in_p"].to_numpy(float), f["in_u"].to_numpy(float), n, m)})

    summed = counts.groupBy("word").agg(F.sum("in_p").alias("in_p"), F.sum("in_u").alias("in_u")).where(F.col("in_p") + F.col("in_u") >= LEAST_DF)
    told = summed.mapInPandas(scores, "word long, z double").where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "word").limit(VOCABULARY).toPandas()
    return np.sort(told["word"].to_numpy(np.int64).view(np.uint64))


def _packed(sent):
    """Turns texts into distinct sets of columns with how many rows have them, many sets to a row."""

    def row(tally: Counter) -> pd.DataFrame:
        sets = sorted(tally)
        sizes, counts = np.array([len(x) // 4 for x in sets], np.int32), np.array([tally[x] for x in sets], np.int64)
        return pd.DataFrame({"columns": [b"".join(sets)], "sizes": [sizes.tobytes()], "counts": [counts.tobytes()]})

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally, held = Counter(), 0
        for frame in byte_batches(frames):
            for s in word_sets(frame["text"].tolist()):
                own = _columns(s, sent.value).tobytes()
                held += 0 if own in tally else len(own) + 64
                tally[own] += 1
            if held > PACKED_BYTES:
                yield row(tally)
                tally, held = Counter(), 0
        if tally:
            yield row(tally)

    return scan


def whole_risk(packed: DataFrame, theta: np.ndarray, m: int) -> tuple[float, np.ndarray]:
    """The mean loss of taking each of the m packed rows as 0, and its slope: sums of whole numbers, at most len(theta) + 1 of them."""
    sent, size = packed.sparkSession.sparkContext.broadcast(theta), len(theta) - 1

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size + 2, np.int64)
        for frame in frames:
            for columns, sizes, counts in zip(frame["columns"], frame["sizes"], frame["counts"]):
                ends = np.cumsum(np.frombuffer(sizes, np.int32))
                rows, times = Rows(np.split(np.frombuffer(columns, np.int32), ends[:-1])), np.frombuffer(counts, np.int64)
                z = rows.times(sent.value[:-1]) + sent.value[-1]
                by_row = np.rint(sigmoid(z) * UNIT) * times
                total[:size] += rows.gradient(by_row, size).astype(np.int64)
                total[size] += int(by_row.sum())
                total[size + 1] += int((np.rint(np.logaddexp(0, z) * UNIT).astype(np.int64) * times).sum())
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "total": total[at]})

    out = np.zeros(size + 2)
    for at, total in packed.mapInPandas(scan, "at long, total long").groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        out[at] = float(total) / UNIT / m
    sent.unpersist()
    return float(out[-1]), out[:-1]


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED, most_bytes: int = FIT_BYTES) -> Classifier:
    """A classifier from the documents outside the held-out fold."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (crc_mod("doc_id", FOLDS) != HELD_OUT)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if prior is None:
        prior = own.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    pick = F.xxhash64(F.lit(SEED), F.col("doc_id"))
    chosen = own.where("toxic = 1").orderBy(pick, "doc_id").limit(positives).select("doc_id", F.lit(1).alias("kind"))
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "toxicity")
    mine = docs.where(F.col("doc_id").isNotNull() & (crc_mod("doc_id", FOLDS) != HELD_OUT)).select("doc_id", "text")
    by_id = mine.groupBy("doc_id").agg(F.count("*").alias("rows"))
    n, m = by_id.join(F.broadcast(chosen), "doc_id", "left").agg(F.count("kind"), F.count("*")).first()
    if not n:
        return _prior_only(prior)
    rows = _one_an_id(mine, by_id, scratch)
    words = vocabulary(rows, chosen, n, m)
    if not len(words):  # no word tells the two apart: there is only the prior
        return _prior_only(prior)
    sent = spark.sparkContext.broadcast(words)

    def columns(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in byte_batches(frames):
            found = [_columns(s, sent.value).tobytes() for s in word_sets(frame["text"].tolist())]
            yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(), "kind": frame["kind"].to_numpy(), "columns": found})

    ids = by_id.select("doc_id").orderBy(pick, "doc_id").limit(unlabelled)
    both = chosen.unionByName(ids.select("doc_id", F.lit(0).alias("kind")))  # at most positives + unlabelled rows
    local = fitting_rows(rows, both, columns, "doc_id long, kind int, columns binary", "columns", SEED, most_bytes)
    p, u = (Rows([np.frombuffer(x, np.int32) for x in local.loc[local["kind"] == kind, "columns"]]) for kind in (1, 0))
    if not len(p.columns) or not u.n:
        return _prior_only(prior)
    packed = scratch.write(rows.select(text_bytes().alias("text")).mapInPandas(_packed(sent), "columns binary, sizes binary, counts binary"))
    theta = descend(p, u, _flat(len(words), prior), prior, STEPS)
    for _ in range(PASSES):
        theta = descend(p, u, theta, prior, STEPS_BETWEEN, whole=whole_risk(packed, theta, m))
    scratch.drop(packed)
    return Classifier(words, theta[:-1], float(theta[-1]))


def scored(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id and score of every row. The classifier is a bounded broadcast: at most VOCABULARY words."""
    sent = docs.sparkSession.sparkContext.broadcast(classifier)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in byte_batches(frames):
            yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(), "score": sent.value.score(word_sets(frame["text"].tolist()))})

    return docs.select("doc_id", text_bytes().alias("text")).mapInPandas(scan, "doc_id long, score double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = scored(docs, train(docs, labels))
    held = F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
