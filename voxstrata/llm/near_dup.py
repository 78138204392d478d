"""MinHash near-dedup by a multi-index Hamming join.

A document's signature is ``hashes`` MinHash values of ``bits`` bits each. Two signatures within ``distance`` differing
values agree, by the pigeonhole principle, in at least one of ``chunks`` chunks up to ``distance // chunks`` values; each
signature is therefore indexed under every chunk with every allowed set of values left out, and all pairs within the
distance share a key. Documents that share keys are gathered into candidate groups (linear in the keys: each document is
linked to the least one under its key, pairs are never listed). Links are confirmed on the full shingle sets in two steps.
First each document is held against the least one that it shares a key with, which settles most groups, however large, in
time linear in their members. Groups that fall into several parts are then worked through in pairs of blocks of at most
``block`` documents, the largest part only against the others: signatures alone tell which documents have a partner within
the distance in another part, and only those documents' sets are compared. Only a spanning forest of the confirmed links
leaves a task. Equal sets are folded into one representative before any of that.

The distance follows from the similarity asked for: a pair at just that similarity is beyond it with a probability of at
most ``MISSED``, and nearer pairs with less (64 values: 23 at 0.85, 9e-6); everything within it is found and confirmed
exactly. op3 links at 0.85, the pipeline's stage at 0.8 (``corpus_pipeline``).

Defined cases: null and empty texts and texts without words have no shingles, are linked with nothing and are kept; fewer
words than ``width`` are one shingle; repeated doc_ids count as one document with the union of their links; rows without a
doc_id are linked with nothing and kept. The stage keeps every row of a doc_id that it keeps, also equal ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, byte_batches, only, table, text_bytes
from .graph import components
from .words import PLAIN, U, Words, splitmix, windows

HASHES, BITS, WIDTH, BLOCK = 64, 16, 5, 256
#: Percent of shared shingles that link two documents, and the share of pairs at just that similarity that may be missed.
SIMILAR, MISSED = 85, 1e-5


def allowed(similar: int, hashes: int = HASHES, bits: int = BITS) -> tuple[int, int]:
    """The distance that pairs at ``similar`` percent stay within, and the chunks that leave one value out of each key."""
    differ = (1 - similar / 100) * (1 - 0.5**bits)
    beyond, distance = 1.0, -1
    while beyond > MISSED and distance < hashes:
        distance += 1
        beyond = sum(comb(hashes, d) * differ**d * (1 - differ) ** (hashes - d) for d in range(distance + 1, hashes + 1))
    return distance, distance // 2 + 1


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(texts, PLAIN)
    for i in range(len(words)):
        own = words.of(i)
        yield np.unique(windows(own, min(width, len(own)))) if len(own) else own


class Signer:
    """b-bit MinHash values of shingle sets."""

    def __init__(self, hashes: int = HASHES, bits: int = BITS):
        self.bits = bits
        self.mul = splitmix(np.arange(hashes, dtype=U) + U(1 << 50)) | U(1)
        self.add = splitmix(np.arange(hashes, dtype=U) + U(1 << 51))

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.mul), U(2**64 - 1))
        for at in range(0, len(shingles), 4096):
            np.minimum(least, (shingles[at : at + 4096, None] * self.mul + self.add).min(0), out=least)
        # low bits of the mixed minimum
        return (splitmix(least) & U((1 << self.bits) - 1)).astype(np.uint16 if self.bits <= 16 else np.uint32)


def _sign(width: int, hashes: int, bits: int):
    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signer = Signer(hashes, bits)
        for frame in byte_batches(frames):
            n, s1, s2, sigs = [], [], [], []
            for shingles in shingle_sets(frame["text"].tolist(), width):
                n.append(len(shingles))
                with np.errstate(over="ignore"):
                    s1.append(np.add.reduce(splitmix(shingles), dtype=U).astype(np.int64))
                    s2.append(np.add.reduce(splitmix(shingles ^ U(0x5851F42D4C957F2D)), dtype=U).astype(np.int64))
                sigs.append(signer(shingles).tobytes() if len(shingles) else b"")
            yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(), "n_shingles": n, "s1": s1, "s2": s2, "sig": sigs})

    return scan


def signatures(docs: DataFrame, width: int = WIDTH, hashes: int = HASHES, bits: int = BITS) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, sig): the set's size, 128 bits of it, and its MinHash values."""
    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInPandas(_sign(width, hashes, bits), "doc_id long, n_shingles long, s1 long, s2 long, sig binary")


def key_columns(hashes: int, distance: int, chunks: int) -> list[tuple[int, ...]]:
    """Which values make up each key: a chunk without any ``distance // chunks`` of its values."""
    cuts = np.linspace(0, hashes, chunks + 1).astype(int)
    out = []
    for a, b in zip(cuts, cuts[1:]):
        for gone in combinations(range(a, b), min(distance // chunks, b - a - 1)):
            out.append(tuple(c for c in range(a, b) if c not in gone))
    return out


def _keys(hashes: int, bits: int, distance: int, chunks: int):
    columns = key_columns(hashes, distance, chunks)
    kind = np.uint16 if bits <= 16 else np.uint32

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 4096):
                part = frame.iloc[at : at + 4096]
                sigs = np.frombuffer(b"".join(part["sig"]), kind).reshape(-1, hashes).astype(U)
                keys = np.empty((len(part), len(columns)), U)
                for k, own in enumerate(columns):
                    x = np.full(len(part), k, U)
                    for c in own:
                        x = splitmix(x ^ sigs[:, c])
                    keys[:, k] = x
                yield pd.DataFrame({"key": keys.ravel().view(np.int64), "id": np.repeat(part["doc_id"].to_numpy(), len(columns))})

    return scan


def _stars(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each id under a key, linked to the key's first id in this partition. Rows come sorted by (key, id).

    The first and the last key may go on in other partitions: their first ids come out as well, with the key.
    """
    key, first, rows = None, 0, 0
    ends: dict[int, int] = {}
    for frame in frames:
        if not len(frame):
            continue
        keys, ids = frame["key"].to_numpy(), frame["id"].to_numpy()
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        new[0] = keys[0] != key
        begin = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        firsts = np.where(run >= 0, ids[begin][np.maximum(run, 0)] if len(begin) else first, first)
        if not rows:
            ends[int(keys[0])] = int(ids[0])
        rows += len(keys)
        star = ids != firsts
        if star.any():
            yield pd.DataFrame({"u": ids[star], "v": firsts[star], "key": np.full(star.sum(), np.nan)}).astype({"key": "Int64"})
        key, first = int(keys[-1]), int(firsts[-1])
    if rows:
        ends[key] = first
        yield pd.DataFrame({"u": list(ends.values()), "v": list(ends.values()), "key": list(ends)}).astype({"key": "Int64"})


def stars(reps: DataFrame, scratch: Scratch, hashes: int = HASHES, bits: int = BITS, distance: int = 23, chunks: int = 12) -> DataFrame:
    """(u, v): links that join all documents under a key. reps: (doc_id, sig).

    Keys are range-partitioned together with the ids, so a key that very many documents share is spread over partitions.
    """
    keys = reps.mapInPandas(_keys(hashes, bits, distance, chunks), "key long, id long")
    n = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = scratch.write(keys.repartitionByRange(n, "key", "id").sortWithinPartitions("key", "id").mapInPandas(_stars, "u long, v long, key long"))
    ends = found.where("key IS NOT NULL")
    least = ends.groupBy("key").agg(F.min("u").alias("v"))
    across = ends.select("u", "key").join(least, "key").select("u", "v")
    return found.where("key IS NULL").select("u", "v").unionAll(across).where("u <> v")


def alike(a: np.ndarray, b: np.ndarray, similar: int) -> bool:
    """Whether two sorted sets share ``similar`` percent of their union."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < similar * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= similar * (len(a) + len(b) - both)


def _first_links(similar: int):
    """Within a piece of a star: the links between its centre and the others."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        sets, ids = [np.frombuffer(s, U) for s in frame["shingles"]], frame["id"].to_numpy()
        # an id may stand for several sets
        centre = [s for s, i, v in zip(sets, ids, frame["v"]) if i == v]
        out = {(int(i), int(v)) for s, i, v in zip(sets, ids, frame["v"]) if i != v and any(alike(s, c, similar) for c in centre)}
        return pd.DataFrame(sorted(out), columns=["u", "v"]).astype("int64")

    return work


def _across(frame: pd.DataFrame, a: int, similar: int, distance: int, sigs: np.ndarray) -> np.ndarray:
    """The rows after row a, of the other block or of its own, of other parts, with sizes and signatures near a's."""
    block, part, size = frame["block"].to_numpy(), frame["part"].to_numpy(), frame["n_shingles"].to_numpy()
    others = np.arange(a + 1, len(frame))
    others = others[(part[others] != part[a]) & ((block[others] != block[a]) | (frame["i"].iloc[0] == frame["j"].iloc[0]))]
    others = others[100 * np.minimum(size[others], size[a]) >= similar * np.maximum(size[others], size[a])]
    return others[(sigs[others] != sigs[a]).sum(1) <= distance]


def _partners(similar: int, distance: int, kind):
    """Within a pair of blocks: the documents that have a partner by their signatures in another part."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        sigs, found = np.stack([np.frombuffer(s, kind) for s in frame["sig"]]), np.zeros(len(frame), bool)
        for a in range(len(frame)):
            others = _across(frame, a, similar, distance, sigs)
            found[others] = True
            found[a] |= len(others) > 0
        return pd.DataFrame({"id": np.unique(frame["id"].to_numpy()[found])})

    return work


def _links(similar: int, distance: int, kind):
    """Within a pair of blocks: a spanning forest of the links between parts, confirmed on the sets."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        sigs, ids, sets = np.stack([np.frombuffer(s, kind) for s in frame["sig"]]), frame["id"].to_numpy(), [np.frombuffer(s, U) for s in frame["shingles"]]
        parent = {p: p for p in frame["part"].tolist()}
        part = frame["part"].tolist()

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        out = []
        for a in range(len(frame)):
            for b in _across(frame, a, similar, distance, sigs).tolist():
                ra, rb = root(part[a]), root(part[b])
                if ra != rb and alike(sets[a], sets[b], similar):
                    parent[ra] = rb
                    out.append((ids[a], ids[b]))
        return pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    return work


def _sets(width: int, hashes: int, bits: int):
    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signer = Signer(hashes, bits)
        for frame in byte_batches(frames):
            sets = list(shingle_sets(frame["text"].tolist(), width))
            yield pd.DataFrame({"id": frame["id"].to_numpy(), "n_shingles": [len(x) for x in sets], "sig": [signer(s).tobytes() for s in sets], "shingles": [s.tobytes() for s in sets]})

    return scan


def full_sets(docs: DataFrame, ids: DataFrame, width: int, hashes: int, bits: int) -> DataFrame:
    """(id, n_shingles, sig, shingles) of documents that may be among ids."""
    texts = only(docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), text_bytes().alias("text")), ids)
    return texts.mapInPandas(_sets(width, hashes, bits), "id long, n_shingles long, sig binary, shingles binary").where("n_shingles > 0")


def first_links(docs: DataFrame, star: DataFrame, similar: int, width: int, hashes: int, bits: int, block: int) -> DataFrame:
    """(u, v): each document that shares a key with a lesser one, linked to the least of those if they are alike."""
    first = star.select(F.greatest("u", "v").alias("id"), F.least("u", "v").alias("v")).groupBy("id").agg(F.min("v").alias("v"))
    # the centre of a large star goes to several tasks
    pieces = first.groupBy("v").agg(F.ceil(F.count("*") / block).cast("int").alias("pieces"))
    dealt = first.join(pieces, "v").select("id", "v", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int").alias("piece"))
    centres = pieces.select(F.col("v").alias("id"), "v", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    roles = dealt.unionByName(centres)
    return full_sets(docs, roles.select("id"), width, hashes, bits).select("id", "shingles").join(roles, "id").groupBy("v", "piece").applyInPandas(_first_links(similar), "u long, v long")


def in_blocks(members: DataFrame, block: int) -> DataFrame:
    """members with a row for each pair (i, j) of blocks that theirs is in. members: (cluster, part, id, ...).

    The largest part of a cluster is in blocks of its own, which meet those of the other parts only.
    """
    parts = members.groupBy("cluster", "part").agg(F.count("*").alias("n"))
    largest = parts.groupBy("cluster").agg(F.max(F.struct("n", "part")).alias("most"), F.sum("n").alias("all"))
    sizes = largest.select("cluster", F.col("most.part").alias("main"), F.ceil((F.col("all") - F.col("most.n")) / block).cast("int").alias("rest_blocks"), F.ceil(F.col("most.n") / block).cast("int").alias("main_blocks")).where("rest_blocks > 0")
    placed = members.join(sizes, "cluster")
    is_main, hashed = F.col("part") == F.col("main"), F.xxhash64("id")
    placed = placed.withColumn("block", F.when(is_main, F.col("rest_blocks") + F.pmod(hashed, "main_blocks")).otherwise(F.pmod(hashed, "rest_blocks")).cast("int"))
    last = F.when(is_main, F.col("rest_blocks") - 1).otherwise(F.col("rest_blocks") + F.col("main_blocks") - 1)
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return paired.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "main", "rest_blocks", "main_blocks")


def near_duplicates(docs: DataFrame, similar: int = SIMILAR, width: int = WIDTH, hashes: int = HASHES, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents linked at ``similar`` percent or more of their shingles, transitively."""
    spark = docs.sparkSession
    distance, chunks = allowed(similar, hashes, bits)
    kind = np.uint16 if bits <= 16 else np.uint32
    scratch = Scratch(spark, "near-dup")
    signed = scratch.write(signatures(docs, width, hashes, bits))
    # one representative of each set
    sets = scratch.write(signed.where("n_shingles > 0").groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig")))
    reps = sets.groupBy(F.col("rep").alias("doc_id"), "sig").agg(F.count("*").alias("sets"))  # a repeated doc_id may stand for several texts
    star = stars(reps.select("doc_id", "sig"), scratch, hashes, bits, distance, chunks)
    first = scratch.write(first_links(docs, star, similar, width, hashes, bits, block))
    parts = components(first, scratch).withColumnRenamed("component", "part")
    clusters = components(star, scratch).withColumnRenamed("component", "cluster")
    members = scratch.write(clusters.join(parts, "id", "left").select("cluster", F.coalesce("part", "id").alias("part"), "id"))
    # what is left: documents with a partner in another part of their cluster, by their signatures
    signs = sets.select(F.col("rep").alias("id"), "n_shingles", "sig")
    near = in_blocks(members, block).join(signs, "id").groupBy("cluster", "i", "j").applyInPandas(_partners(similar, distance, kind), "id long")
    near = scratch.write(near.distinct())
    left = in_blocks(members.join(near, "id", "left_semi"), block)
    again = full_sets(docs, near, width, hashes, bits).join(left, "id").groupBy("cluster", "i", "j").applyInPandas(_links(similar, distance, kind), "u long, v long")
    linked = components(first.unionAll(again), scratch)
    # a repeated doc_id with several texts ties the sets of its texts together
    copies = signed.where("n_shingles > 0").join(sets.select("s1", "s2", "n_shingles", "rep"), ["s1", "s2", "n_shingles"]).select("doc_id", "rep")
    placed = copies.join(linked.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(placed.groupBy("doc_id").agg(F.min("component_id").alias("component_id")), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document; rows without a doc_id have no component and are kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    nameless = signatures(docs.where("doc_id IS NULL").withColumn("doc_id", F.lit(0))).select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id"))
    found = near_duplicates(docs).unionByName(nameless)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, similar: int = SIMILAR) -> DataFrame:
    """One document of each group of near duplicates: that with the least doc_id."""
    found = near_duplicates(docs.select("doc_id", "text"), similar)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, string_split_regex(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+', ' ', 'g'), ' '), ' ') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + least(5, len(w)) - 1], ' ')) AS s
  FROM words, UNNEST(range(1, len(w) - least(5, len(w)) + 2)) AS t(i) WHERE w <> ['']),
size AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM shared JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN size USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) c USING (doc_id)
"""
