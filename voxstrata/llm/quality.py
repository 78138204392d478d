"""Quality by nearest-neighbour voting among labelled documents in a latent-semantic space.

A document's terms are its words, the shapes of its white-space tokens (runs of capitals, small letters, digits and single
signs), pairs of shapes, and marks for the share of words that repeat the one before. Weighted by tf-idf and projected on the
leading singular vectors of the labelled sample, documents become short vectors. The sample's vectors are broadcast; each
task computes exact cosine products of its documents with all of them, block by block, and the nearest labels vote with
weights that grow with similarity.

The sample is bounded (``sample`` labelled rows outside the held-out fold, one an id, chosen by a hash of the doc_id, and
``most_bytes`` of terms in all) and so is the vocabulary; every document is scored on its whole text, and no document leaves its task.

Defined cases: a text without terms (null and empty ones too), or one whose terms the sample lacks, gets the share of good
rows in the sample; without labelled rows every score is 1, so that the pipeline keeps everything; several labels of one
document count as good if any is; repeated rows get equal scores; neighbours of equal cosine go by doc_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FIT_BYTES, byte_batches, crc_mod, fitting_rows, table, text_bytes
from .words import ALNUM, PLAIN, U, Words, splitmix, windows

#: Labelled rows, terms in the vocabulary, dimensions, voting neighbours, and the power of the cosine that they vote with.
SAMPLE, TERMS, DIMENSIONS, NEIGHBOURS, SHARPNESS = 3000, 4096, 48, 15, 8
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
SEED = 13
#: Documents whose products are computed at once.
BLOCK = 256

SHAPES = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 57 if 48 <= b <= 57 else b if b not in (9, 10, 11, 12, 13) else 32 for b in range(256))
WORD, SHAPE, PAIR = (splitmix(np.array([k], U) + U(1 << 52))[0] for k in range(3))
#: Shares of words that repeat the one before, from which a text has a mark more, and those marks.
REPEATS = np.array([0.02, 0.05, 0.1, 0.2, 0.35, 0.5])
MARKS = splitmix(np.arange(len(REPEATS), dtype=U) + U(1 << 53))
#: Fewer repeats than that happen by chance in a short text.
FEW = 4
#: Steps of a cosine of 1 that neighbours are told apart by.
STEPS = 1 << 17
#: Weights, axes and unit vectors are whole numbers of such steps. Every product of theirs, and every sum of products, stays
#: under 2**53, where doubles are exact: scores don't depend on the order of a sum, nor on what else is in a block.
WEIGHT_STEPS, AXIS_STEPS, UNIT_STEPS = 1 << 10, 1 << 20, 1 << 22
#: A translation that leaves shapes as they are.
AS_IS = bytes(range(256))


def _collapsed(text: bytes) -> bytes:
    data = np.frombuffer(text.translate(SHAPES), np.uint8)
    if len(data) < 2:
        return data.tobytes()
    keep = np.ones(len(data), bool)
    np.not_equal(data[1:], data[:-1], out=keep[1:])
    return data[keep].tobytes()


def terms(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The distinct term hashes of each text, and how often each occurs."""
    words, shapes = Words(texts, ALNUM), Words([_collapsed(t) for t in texts], AS_IS)
    for i in range(len(texts)):
        w, s = words.of(i), shapes.of(i)
        repeats = int((w[1:] == w[:-1]).sum())
        marks = np.repeat(MARKS[repeats >= REPEATS * max(len(w), 1)], repeats if repeats >= FEW else 0)
        yield np.unique(np.concatenate([w ^ WORD, s ^ SHAPE, windows(s, 2) ^ PAIR, marks]), return_counts=True)


@dataclass
class Voters:
    """The space, and the labelled vectors in it. All bounded: TERMS x DIMENSIONS and SAMPLE x DIMENSIONS numbers."""

    vocabulary: np.ndarray
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @property
    def share(self) -> float:
        return float(self.labels.mean()) if len(self.labels) else 1.0

    def weighted(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """tf-idf in whole steps of 1 / WEIGHT_STEPS."""
        out = np.zeros((len(rows), len(self.vocabulary)))
        if len(self.vocabulary):
            for i, (found, counts) in enumerate(rows):
                at = np.searchsorted(self.vocabulary, found)
                at[at == len(self.vocabulary)] = 0
                same = self.vocabulary[at] == found
                logs = np.array([math.log(c) for c in counts[same].tolist()])
                out[i, at[same]] = np.rint((1 + logs) * self.idf[at[same]] * WEIGHT_STEPS)
        return out

    def project(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Unit vectors in whole steps of 1 / UNIT_STEPS."""
        return _whole_unit(self.weighted(rows) @ self.axes)

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.full(len(rows), self.share)
        if not len(self.labels) or not self.axes.size:
            return out
        k = min(NEIGHBOURS, len(self.labels))
        later = np.arange(len(self.labels))
        for at in range(0, len(rows), BLOCK):
            part = rows[at : at + BLOCK]
            steps = np.rint((self.project(part) @ self.vectors.T) * (STEPS / UNIT_STEPS**2)).astype(np.int64)
            top = np.argpartition(later - steps * len(later), k - 1, axis=1)[:, :k]  # equal ones by doc_id
            top.sort(axis=1)
            for i, near in enumerate(top):
                weight = [max(int(steps[i, j]) / STEPS, 0.0) ** SHARPNESS for j in near]
                total = math.fsum(weight)
                if total > 0:
                    out[at + i] = math.fsum(w * self.labels[j] for w, j in zip(weight, near)) / total
        return np.clip(out, 0, 1)


def _whole_unit(x: np.ndarray) -> np.ndarray:
    """Rows of whole numbers at unit length, in steps of 1 / UNIT_STEPS: from squares whose sums are exact in any order."""
    _, high = np.frexp(np.abs(x).max(1, initial=0))
    x = np.rint(np.ldexp(x, (22 - high)[:, None]))
    norm = np.sqrt((x * x).sum(1))[:, None]
    return np.rint(x / np.where(norm > 0, norm, 1) * UNIT_STEPS)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Voters:
    """Latent-semantic vectors of labelled rows, by a randomised singular value decomposition."""
    if not rows:
        return Voters(np.empty(0, U), np.empty(0), np.empty((0, 0)), np.empty((0, 0)), np.empty(0))
    found, df = np.unique(np.concatenate([r[0] for r in rows]), return_counts=True)
    common = np.flatnonzero(df >= min(3, len(rows)))
    common = np.sort(common[np.argsort(-df[common], kind="stable")[:TERMS]])
    voters = Voters(found[common], np.log((1 + len(rows)) / (1 + df[common])) + 1, np.empty((0, 0)), np.empty((0, 0)), labels.astype(np.float64))
    if not len(common):
        return voters
    x = _unit(voters.weighted(rows).astype(np.float32))
    k = min(DIMENSIONS, *x.shape)
    basis = np.random.default_rng(0).standard_normal((x.shape[1], min(k + 16, x.shape[1]))).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    _, _, right = np.linalg.svd(x @ basis, full_matrices=False)
    voters.axes = np.rint((basis @ right[:k].T).astype(np.float64) * AXIS_STEPS)
    voters.vectors = np.vstack([voters.project(rows[i : i + BLOCK]) for i in range(0, len(rows), BLOCK)])
    return voters


def _term_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in byte_batches(frames):
        found = list(terms(frame["text"].tolist()))
        yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(), "label": frame["label"].to_numpy(), "terms": [t.tobytes() for t, _ in found], "counts": [c.astype(np.int64).tobytes() for _, c in found]})


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_bytes: int = FIT_BYTES) -> Voters:
    """Voters from labelled documents outside the held-out fold."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (crc_mod("doc_id", FOLDS) != HELD_OUT)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    chosen = own.orderBy(F.xxhash64(F.lit(SEED), F.col("doc_id")), "doc_id").limit(sample)  # at most sample rows
    rows = fitting_rows(docs, chosen, _term_rows, "doc_id long, label int, terms binary, counts binary", "terms", SEED, most_bytes)
    return fit([(np.frombuffer(t, U), np.frombuffer(c, np.int64)) for t, c in zip(rows["terms"], rows["counts"])], (rows["label"] == 1).to_numpy())


def scored(docs: DataFrame, voters: Voters) -> DataFrame:
    """doc_id and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(voters)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in byte_batches(frames):
            yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(), "score": sent.value.score(list(terms(frame["text"].tolist())))})

    return docs.select("doc_id", text_bytes().alias("text")).mapInPandas(scan, "doc_id long, score double")


def good_rows(docs: DataFrame, voters: Voters, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of documents, in all their columns, whose score reaches the threshold."""
    sent, text = docs.sparkSession.sparkContext.broadcast(voters), docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = pd.DataFrame({"text": [x.encode() if x else b"" for x in batch.column(text).to_pylist()]})
            scores = [sent.value.score(list(terms(part["text"].tolist()))) for part in byte_batches([raw])]
            yield batch.filter(pa.array(np.concatenate([*scores, np.empty(0)]) >= threshold))

    return docs.mapInArrow(scan, docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = scored(docs, train(docs, labels))
    held = F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier does not reject."""
    return good_rows(docs, train(docs, table(spark, sf_dir, "labels")))
