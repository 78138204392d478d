"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are dealt into buckets by length (ranges of the norm, cut into blocks of bounded size). A first pass scores
every query against the longest bucket's first block, which gives each query a floor: its k-th best product there. A
query then visits only the blocks that its floor leaves open: a block whose longest vector cannot reach the floor is
passed over as a whole. Within a block the floor becomes a local cosine threshold, floor / (|q| * longest). Where it is
low, candidates are pruned by length alone, in pieces from the longest on, and the floor rises with what each piece gives;
where it is high, coordinates prune: on the ``focus`` largest coordinates of the query the product is taken, and the
Cauchy-Schwarz bound over the others decides who can still reach the floor. What is left is verified by full products;
each block gives at most k candidates a query, and the best k of all blocks stay.

Blocks come longest first, so a query visits a run of them and only the run's end is worked out; Spark makes the rows. A task
holds one block and one chunk of queries, both bounded in rows and bytes. Up to ``BLOCKS`` of the largest
blocks (3 million candidates) a query is sent a bounded number of times; a candidate is sent once a chunk that visits it.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part; shorter vectors count as
filled up with zeros; ties go to the smaller vec_id; repeated vec_ids are candidates each, but never for a query of their
own vec_id; an empty table gives no rows. Products are taken in single precision where it holds them exactly, else in
double; queries some of whose products could pass 2**53 in size in a piece are scored there by Python's whole numbers;
scores beyond a long count as the largest (or least) long, components beyond one likewise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

K, EVERY, SCALE = 5, 50, 256
#: Candidates and queries whose products are held at a time, queries in a chunk, coordinates looked at first.
BLOCK, AT_ONCE, CHUNK, FOCUS = 1024, 2048, 16384, 16
#: Blocks while none has more than ``MOST_ROWS`` times the least rows; blocks at most (their lengths are sent to the tasks).
BLOCKS, MOST_ROWS, MOST_BLOCKS = 96, 32, 1 << 16
#: Shares of a chunk in the first pass, which has one block only to be dealt to tasks.
SHARES = 8
#: Bytes of components, as doubles, in a block or chunk.
BLOCK_BYTES = 32 << 20
#: Local cosine thresholds from which coordinates prune rather than length; the part of a square by which it may be off.
STEEP, ROUNDED = 0.5, 1e-12
#: From these sizes on a product of lengths is not known to be exact in single and double precision; the largest long.
SINGLE, EXACT, MOST = 2.0**24, 2.0**53, (1 << 63) - 1


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, or null where a component is null or not finite."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.transform(wide, lambda x: F.floor(x * scale).cast("double")))


def prepared(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v, norm): the vectors that take part."""
    v = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), quantised(F.col("embedding"), scale).alias("v")).where("v IS NOT NULL")
    return v.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))


def _matrix(rows: pd.Series, width: int, kind: type) -> np.ndarray:
    """The first ``width`` components of each, filled up with zeros."""
    out = np.zeros((len(rows), width), kind)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r[:width]
    return out


def _merge(best: np.ndarray, ids: np.ndarray, i: np.ndarray, scores: np.ndarray, c_ids: np.ndarray) -> None:
    """Into the best so far of each row, by falling score and then id, those found for rows i."""
    rows, k = np.unique(i), best.shape[1]
    at = np.concatenate([np.repeat(rows, k), i])
    s, v = np.concatenate([best[rows].ravel(), scores]), np.concatenate([ids[rows].ravel(), c_ids])
    by = np.lexsort((v, -s, at))
    at, s, v = at[by], s[by], v[by]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    kept = place < k
    best[at[kept], place[kept]], ids[at[kept], place[kept]] = s[kept], v[kept]


def _reaching(scores: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of scores at their row's floor or over it; of many the best k of a row, ties by column."""
    rows = np.flatnonzero(scores.max(axis=1) >= floors)
    scores = scores[rows]
    hit = scores >= floors[rows, None]
    many = np.flatnonzero(np.count_nonzero(hit, axis=1) > 8 * k)
    if len(many):
        some = scores[many]
        kth = np.partition(some, some.shape[1] - k, axis=1)[:, some.shape[1] - k, None]
        tied = some == kth
        hit[many] &= (some > kth) | tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= k)
    at = np.flatnonzero(hit)
    return rows[at // hit.shape[1]], at % hit.shape[1]


def top_of_block(q_ids: np.ndarray, q: np.ndarray, q_norm: np.ndarray, floors: np.ndarray, c_ids: np.ndarray, c: np.ndarray, c_norm: np.ndarray, k: int, piece: int = BLOCK, at_once: int = AT_ONCE) -> pd.DataFrame:
    """The best k candidates of a block for each query, of those that reach its floor."""
    order = np.lexsort((c_ids, -c_norm))  # longest first: length pruning keeps a prefix
    c, c_ids, c_norm = c[order], c_ids[order], c_norm[order]
    order = np.argsort(q_ids, kind="stable")  # queries of one id side by side
    q_ids, q, q_norm, floors = q_ids[order], q[order], q_norm[order], floors[order].astype(float)
    out = []
    longest = c_norm[0] if len(c) else 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(q_norm * longest > 0, floors / (q_norm * longest), np.where(floors > 0, np.inf, -np.inf))
    steep = (local >= STEEP) & (q_norm * longest < EXACT)
    columns = np.ascontiguousarray(c.T) if steep.any() else c.T
    for i in np.flatnonzero(steep & (local <= 1 + 1e-9)):
        # by coordinates: the query's largest ones, and a bound for the rest
        big = np.argsort(-np.abs(q[i]), kind="stable")[:FOCUS]
        n = int(np.searchsorted(-c_norm, -floors[i] / q_norm[i] * (1 - 1e-9), side="right"))
        part, own = columns[big, :n].astype(float), q[i, big].astype(float)
        # a difference of squares is off by a part of the squares: by less than ROUNDED
        rest = np.sqrt((max(q_norm[i] ** 2 - (own**2).sum(), 0) + ROUNDED * q_norm[i] ** 2) * (np.maximum(c_norm[:n] ** 2 - np.einsum("ij,ij->j", part, part), 0) + ROUNDED * c_norm[:n] ** 2))
        left = np.flatnonzero((own @ part + rest * (1 + 1e-9) + 1e-6 >= floors[i]) & (c_ids[:n] != q_ids[i]))
        if len(left):
            s = (c[left] @ q[i]).astype(float)
            left, s = left[s >= floors[i]], s[s >= floors[i]]
            first = np.lexsort((c_ids[left], -s))[:k]
            out.append((np.full(len(first), q_ids[i]), c_ids[left[first]], s[first].astype(np.int64)))
    flat = np.flatnonzero(~steep)
    for start in range(0, len(flat), at_once):
        _by_length(*(x[flat[start : start + at_once]] for x in (q_ids, q, q_norm, floors)), c_ids, c, c_norm, k, piece, out)
    if not out:
        return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0, np.int64)})
    return pd.DataFrame({n: np.concatenate(x) for n, x in zip(("query_id", "vec_id", "score"), zip(*out))})


def _by_length(q_ids: np.ndarray, q: np.ndarray, q_norm: np.ndarray, floors: np.ndarray, c_ids: np.ndarray, c: np.ndarray, c_norm: np.ndarray, k: int, piece: int, out: list) -> None:
    """Appends to ``out`` what these queries find in a block, piece by piece; floors rise to each query's k-th best."""
    best, ids = np.full((len(q_ids), k), -np.inf), np.full((len(q_ids), k), MOST)
    for begin in range(0, len(c), piece):
        longest = c_norm[begin]
        rows = np.flatnonzero(q_norm * longest * (1 + 1e-9) >= floors)
        large = q_norm[rows] * longest >= EXACT
        by_id = begin + np.argsort(c_ids[begin : begin + piece], kind="stable")  # ids ascend, so ties keep the smaller
        part, part_ids = c[by_id], c_ids[by_id]
        out += _large(q_ids[rows[large]], q[rows[large]], part_ids, part, k)
        rows = rows[~large]
        if not len(rows):
            continue
        scores = (q if len(rows) == len(q) else q[rows]) @ part.T
        own = q_ids[rows]
        low, high = np.searchsorted(own, part_ids, "left"), np.searchsorted(own, part_ids, "right")
        for j in np.flatnonzero(high > low):
            scores[low[j] : high[j], j] = -np.inf
        i, j = _reaching(scores, np.maximum(floors[rows], -1e30).astype(scores.dtype), min(k, len(part)))
        if len(i):
            _merge(best, ids, rows[i], scores[i, j].astype(float), part_ids[j])
            floors = np.maximum(floors, best[:, -1])
    i, j = np.nonzero(best > -np.inf)
    out.append((q_ids[i], ids[i, j], best[i, j].astype(np.int64)))


def _large(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list:
    """The same for queries some of whose products a double can't hold: by Python's whole numbers, all of the block."""
    if not len(q):
        return []
    c = np.array([[int(v) for v in row] for row in c], object)
    out = []
    for i, row in zip(q_ids, q):
        other = np.flatnonzero(c_ids != i)
        scores = [min(max(s, -MOST - 1), MOST) for s in (c[other] @ np.array([int(v) for v in row], object)).tolist()]
        best = sorted(zip((-s for s in scores), c_ids[other].tolist()))[:k]
        out.append((np.full(len(best), i), np.array([v for _, v in best], np.int64), np.array([-s for s, _ in best], np.int64)))
    return out


def _search(k: int):
    def work(key: tuple, queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        width = min(max((len(v) for v in f["v"]), default=0) for f in (queries, candidates))  # beyond it one of the two is zero
        longest = [max(1.0, f["norm"].max()) if len(f) else 1.0 for f in (queries, candidates)]
        kind = np.float32 if longest[0] * longest[1] < SINGLE else np.float64
        q, c = _matrix(queries["v"], width, kind), _matrix(candidates["v"], width, kind)
        return top_of_block(queries["vec_id"].to_numpy(), q, queries["norm"].to_numpy(), queries["floor"].to_numpy(), candidates["vec_id"].to_numpy(), c, candidates["norm"].to_numpy(), k)

    return work


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score). Both tables hold (vec_id, v, norm) as ``prepared`` makes them; ``block``: a block's least rows."""
    spark = candidates.sparkSession
    scratch = Scratch(spark, "top-k")
    candidates, queries = scratch.write(candidates), scratch.write(queries)
    held = F.coalesce(F.sum(F.size("v").cast("long")) * 8, F.lit(0)).alias("bytes")
    top = F.coalesce(F.max("norm"), F.lit(0.0)).alias("top")
    every, most = candidates.agg(F.count("*").alias("n"), top).first(), queries.agg(F.count("*").alias("n"), top, held).first()
    n, top = every["n"], max(every["top"], most["top"])
    # no component is larger than the greatest length: what is shuffled takes the bytes that they need
    packed = F.col("v").cast(f"array<{'smallint' if top < 1 << 14 else 'int' if top < 1 << 30 else 'double'}>").alias("v")
    size = min(max(block, -(-n // BLOCKS)), block * MOST_ROWS)
    blocks = min(MOST_BLOCKS, max(1, -(-n // size)))
    # cuts of the norm by a quantile sketch: one number a block
    marks = [i / blocks for i in range(1, blocks)]
    cuts = sorted(set(candidates.approxQuantile("norm", marks, 1 / (8 * blocks)))) if blocks > 1 else []
    splits = [float("-inf"), *cuts, float("inf")]
    dealt = Bucketizer(splits=splits, inputCol="norm", outputCol="__bucket").transform(candidates) if cuts else candidates.withColumn("__bucket", F.lit(0))
    dealt = dealt.withColumn("bucket", F.col("__bucket").cast("int")).drop("__bucket")
    # equal or nearly equal lengths can fill a bucket beyond a block: it is cut further
    sizes = {r["bucket"]: r for r in dealt.groupBy("bucket").agg(F.count("*").alias("n"), F.max("norm").alias("longest"), held).collect()}  # a row a bucket
    parts = {b: max(1, round(r["n"] / size), -(-r["bytes"] // BLOCK_BYTES)) for b, r in sizes.items()}
    begin, total = {}, 0
    for b in sorted(parts, reverse=True):  # longest first
        begin[b], total = total, total + parts[b]
    longest = [0.0] * total
    for b, r in sizes.items():
        longest[begin[b] : begin[b] + parts[b]] = [r["longest"]] * parts[b]
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    layout = spark.createDataFrame([(b, begin[b], parts[b]) for b in parts], "bucket int, begin int, parts int")
    turn = F.xxhash64(F.monotonically_increasing_id())  # of the row, not of its id, which may be repeated
    dealt = scratch.write(dealt.join(F.broadcast(layout), "bucket").select("vec_id", packed, "norm", (F.col("begin") + F.pmod(turn, F.col("parts"))).cast("int").alias("block")))
    chunks = max(1, -(-most["n"] // chunk), -(-most["bytes"] // BLOCK_BYTES))
    asked = scratch.write(queries.select("vec_id", packed, "norm", F.pmod(turn, F.lit(chunks * SHARES)).cast("int").alias("share")))
    each = F.explode(F.sequence(F.lit(0), F.lit(chunks * SHARES - 1))).alias("share")  # the block that every query begins with

    # a floor for each query from the block of the longest vectors
    none = F.lit(float("-inf"))
    first = asked.select("vec_id", "v", "norm", "share", none.alias("floor")).groupBy("share").cogroup(dealt.where("block = 0").select("vec_id", "v", "norm", each).groupBy("share")).applyInPandas(_search(k), "query_id long, vec_id long, score long")
    first = scratch.write(first)
    floors = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("floor"))
    asked = scratch.write(asked.join(floors, asked["vec_id"] == floors["query_id"], "left").select("vec_id", "v", "norm", F.expr(f"int(share div {SHARES})").alias("chunk"), F.coalesce("floor", none).alias("floor")))

    reach = spark.sparkContext.broadcast(np.array(longest))  # a number a block: at most MOST_BLOCKS and what hot lengths add
    # one number a row comes back from Python; the rows of its run are made by Spark, one at a time
    run = F.explode(F.sequence(F.lit(1), F.col("last"))).alias("block")
    routed = reached(asked, reach).where("last > 0").select("vec_id", "v", "norm", "chunk", "floor", run)
    rest = routed.groupBy("chunk", "block").cogroup(shipped(asked, dealt, reach).groupBy("chunk", "block")).applyInPandas(_search(k), "query_id long, vec_id long, score long")
    return _ranked(first.unionAll(rest), k).select("query_id", "rank", "vec_id", "score")


def reached(asked: DataFrame, reach) -> DataFrame:
    """asked with ``last``: blocks 1 to that one have a longest vector that can reach the query's floor."""

    def ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            norm, floor = frame["norm"].to_numpy(), frame["floor"].to_numpy()
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where(norm > 0, floor / norm * (1 - 1e-9), np.where(floor > 0, np.inf, -np.inf))
            yield frame.assign(last=np.searchsorted(-reach.value[1:], -least, side="right").astype(np.int32))  # lengths fall

    kinds = ", ".join(f"{n} {t}" for n, t in asked.dtypes)
    return asked.mapInPandas(ends, f"{kinds}, last int")


def shipped(asked: DataFrame, dealt: DataFrame, reach) -> DataFrame:
    """(vec_id, v, norm, block, chunk): the candidates of each block, for each chunk of queries of which one visits it."""
    visited = reached(asked.select("norm", "floor", "chunk"), reach).groupBy("chunk").agg(F.max("last").alias("last"))  # a row a chunk
    return dealt.join(F.broadcast(visited), F.col("block").between(1, F.col("last"))).select("vec_id", "v", "norm", "block", "chunk")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: for every vector whose id 50 divides, the five best of all others."""
    vectors = prepared(table(spark, sf_dir, "embeddings"))
    return top_k(vectors.where(F.col("vec_id") % EVERY == 0), vectors)


OP2_SQL = """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM ok q JOIN ok c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
WHERE rank <= 5
"""
