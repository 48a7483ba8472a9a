"""Exact vector search: all pairs, ranges and k nearest, by blocks of matrix products.

Vectors are dealt to blocks and every two blocks meet in one partition, where
a matrix product gives all their cosines; of these only what passes a
threshold, or the k nearest of each vector, leaves the partition. Work is
quadratic, as exact search is; ``approximate_top_k`` is the other way.
Similarities are rounded to six digits before they are compared, so that ties
and thresholds don't hang on the order of a sum.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamsift.functions.vectors import normalize
from loamsift.functions.words import mix

BLOCK_ROWS = 1 << 15  # vectors of a block
CELLS = 1 << 21  # cosines held at a time
PAIRS = 1 << 16  # pairs whose cosines are taken in double precision at a time
DIGITS = 6
PAIR = "id_a long, id_b long, similarity double"


def _vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return df.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{vector_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), normalize(F.col(f"`{vector_col}`")).alias("v"))


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of a batch."""
    v = batch.column("v")
    return batch.column("id").to_numpy(), v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


def _blobs(key: np.ndarray, ids: np.ndarray, m: np.ndarray, of: np.ndarray, name: str) -> pa.RecordBatch:
    """(key, ids, m): what belongs to a key as bytes; ``of`` says which vector each key is of."""
    order = np.argsort(key, kind="stable")
    key, of = key[order], of[order]
    cuts = [*np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist(), len(key)]
    parts = [of[x:y] for x, y in zip(cuts, cuts[1:])]
    return pa.RecordBatch.from_arrays([pa.array(key[cuts[:-1]].astype(np.int64)), pa.array([ids[x].tobytes() for x in parts], pa.binary()), pa.array([m[x].tobytes() for x in parts], pa.binary())], [name, "ids", "m"])


def _held(rows: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of blobs, in order of ids."""
    ids = np.frombuffer(b"".join(r[0] for r in rows), np.int64)
    m = np.frombuffer(b"".join(r[1] for r in rows), np.float64).reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    return ids[order], m[order]


def _slack(dim: int) -> float:
    """What a cosine of unit vectors in single precision and one in double, rounded, differ by at most."""
    return (dim + 4) * 2.0**-24 + 10.0**-DIGITS


def _exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Rounded cosines of the pairs, a few at a time."""
    parts = [np.einsum("ij,ij->i", a[i[k : k + PAIRS]], b[j[k : k + PAIRS]]) for k in range(0, len(i), PAIRS)]
    return np.round(np.concatenate(parts), DIGITS) if parts else np.zeros(0)


def _batch(a, b, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s)], ["id_a", "id_b", "similarity"])


def _above(ids_a, a, ids_b, b, same: bool, threshold: float):
    """(x, y, cosine) of every pair at or above the threshold; in one block each once, the lesser id first.

    Single precision tells which pairs may be; these are taken in double.
    """
    a32, b32, low = a.astype(np.float32), b.astype(np.float32), np.float32(threshold - 2 * _slack(a.shape[1]))
    rows = max(1, CELLS // len(b))
    for at in range(0, len(a), rows):
        start = at if same else 0
        s = a32[at : at + rows] @ b32[start:].T
        hit = np.flatnonzero(~(s < low).ravel())
        for k in range(0, len(hit), 16 * PAIRS):
            i, j = np.divmod(hit[k : k + 16 * PAIRS], s.shape[1])
            i, j = i + at, j + start
            if same:
                later = ids_a[i] < ids_b[j]
                i, j = i[later], j[later]
            w = _exact(a, b, i, j)
            keep = w >= threshold
            if keep.any():
                yield ids_a[i[keep]], ids_b[j[keep]], w[keep]


def _best(ids_a, a, ids_b, b, k: int, include_self: bool = False):
    """(x, y, cosine) of the k nearest in b, whose ids ascend, of each of a; of equals the lesser id.

    Columns lie in groups. The best of k groups are k vectors, so that the
    least of them bounds from below what the k nearest reach, in single
    precision; what may pass it is taken in double.
    """
    a32, b32, slack = a.astype(np.float32), b.astype(np.float32), np.float32(3 * _slack(a.shape[1]))
    rows, group = max(1, CELLS // len(b)), max(1, min(64, len(b) // (16 * k)))
    whole = len(b) // group * group
    for at in range(0, len(a), rows):
        s = a32[at : at + rows] @ b32.T
        if not include_self:
            low, high = (np.searchsorted(ids_b, ids_a[at : at + rows], side) for side in ("left", "right"))
            n = high - low
            own = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            s[np.repeat(np.arange(len(n)), n), own] = -np.inf
        top = s[:, :whole].reshape(len(s), group, -1).max(axis=1)
        least = np.partition(top, top.shape[1] - k, axis=1)[:, -k] - slack if top.shape[1] >= k else np.full(len(s), -np.inf, np.float32)
        hit = ~(s < least[:, None])
        ends = np.cumsum(np.count_nonzero(hit, axis=1))
        x = 0
        while x < len(s):  # so many rows that their pairs fit
            y = max(x + 1, int(np.searchsorted(ends, (int(ends[x - 1]) if x else 0) + 16 * PAIRS, "right")))
            i, j = np.divmod(np.flatnonzero(hit[x:y].ravel()), len(b))
            i += at + x
            if not include_self:
                other = ids_a[i] != ids_b[j]
                i, j = i[other], j[other]
            w = _exact(a, b, i, j)
            order = np.lexsort((j, -w, i))
            i, j, w = i[order], j[order], w[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            yield ids_a[i[keep]], ids_b[j[keep]], w[keep]
            x = y


def _meet(vectors: DataFrame, pick, block_rows: int) -> DataFrame:
    """What ``pick`` finds in every cell of two blocks, (ids, vectors) of each, ids ascending; all with one id are in one block.

    Blocks are sent to as many cells as there are blocks, so they are large:
    what a task holds besides is a slab of cosines.
    """
    spark, count = vectors.sparkSession, vectors.count()
    spread = math.ceil(math.sqrt(8 * spark.sparkContext.defaultParallelism))  # cells enough for all cores
    n = max(1, math.ceil(count / block_rows), min(spread, math.ceil(count / 1024)))

    def dealt(batches):
        for batch in batches:
            if batch.num_rows:
                ids, m = _matrix(batch)
                yield _blobs((mix(ids.view(np.uint64)) % np.uint64(n)).astype(np.int64), ids, m, np.arange(len(ids)), "b")

    def run(batches):
        cell, sides = None, ([], [])

        def flush():
            left, right = sides
            if left and (right or same):
                own = _held(left)
                for found in pick(*own, *(own if same else _held(right)), same):
                    yield _batch(*found)
            left.clear(), right.clear()

        for batch in batches:
            for c, upper, one, ids, m in zip(*(batch.column(k).to_pylist() for k in ("cell", "upper", "same", "ids", "m"))):
                if c != cell:
                    if cell is not None:
                        yield from flush()
                    cell, same = c, one
                sides[upper].append((ids, m))
        if cell is not None:
            yield from flush()

    each = vectors.mapInArrow(dealt, "b long, ids binary, m binary").select("b", "ids", "m", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("o"))
    low, high = F.least("b", "o"), F.greatest("b", "o")
    cell = low * n - F.floor(low * (low - 1) / 2) + high - low  # 0, 1, ... of the pairs
    cells = each.select(cell.cast("long").alias("cell"), (F.col("b") > F.col("o")).alias("upper"), (F.col("b") == F.col("o")).alias("same"), "ids", "m")
    parts = min(n * (n + 1) // 2, max(1, 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return cells.repartitionById(parts, F.pmod("cell", F.lit(parts)).cast("int")).sortWithinPartitions("cell").mapInArrow(run, PAIR)


def all_pairs(df: DataFrame, threshold: float, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id_a, id_b, similarity), id_a < id_b, of every pair at or above the threshold."""

    def pick(ids_a, a, ids_b, b, same):
        for x, y, w in _above(ids_a, a, ids_b, b, same, threshold):
            yield np.minimum(x, y), np.maximum(x, y), w

    return _meet(_vectors(df, id_col, vector_col), pick, block_rows)


def range_search(df: DataFrame, threshold: float, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, doc_id, similarity): every other vector at or above the threshold, for every vector."""

    def pick(ids_a, a, ids_b, b, same):
        for x, y, w in _above(ids_a, a, ids_b, b, same, threshold):
            yield np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([w, w])

    p = _meet(_vectors(df, id_col, vector_col), pick, block_rows)
    return p.select(F.col("id_a").alias("query_id"), F.col("id_b").alias("doc_id"), "similarity")


def _nearest(rows: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def top_k(df: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", include_self: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, doc_id, similarity, rank): the k nearest of every vector; of equals the lesser id.

    Each cell gives k for each of its vectors, so what is shuffled grows with
    vectors times blocks and not with pairs.
    """

    def pick(ids_a, a, ids_b, b, same):
        yield from _best(ids_a, a, ids_b, b, k, include_self)
        if not same:
            yield from _best(ids_b, b, ids_a, a, k, include_self)

    met = _meet(_vectors(df, id_col, vector_col), pick, block_rows)
    return _nearest(met.select(F.col("id_a").alias("query_id"), F.col("id_b").alias("doc_id"), "similarity"), k)


def knn_pairs(df: DataFrame, threshold: float, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_a, id_b, similarity): of the k nearest of each, itself among them, those after it and at the threshold."""
    near = top_k(df, k, id_col, vector_col, include_self=True)
    return near.where((F.col("doc_id") > F.col("query_id")) & (F.col("similarity") >= threshold)).select(F.col("query_id").alias("id_a"), F.col("doc_id").alias("id_b"), "similarity")


def approximate_top_k(df: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = 64, planes: int = 6, dim: int = 64, seed: int = 42) -> DataFrame:
    """As ``top_k``, by random hyperplanes: vectors that share a bucket of any table are ranked exactly.

    Each bucket is a matrix product that gives k for each of its vectors, so
    what is shuffled grows with vectors times tables and not with pairs.
    """
    planes_of = np.random.default_rng(seed).standard_normal((tables * planes, dim))
    weights = 1 << np.arange(planes)

    def dealt(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # every vector goes to all tables
                ids, m = _matrix(batch.slice(at, 512))
                code = ((m @ planes_of.T > 0).reshape(-1, tables, planes) * weights).sum(axis=2) + np.arange(tables) * (1 << planes)
                yield _blobs(code.ravel(), ids, m, np.repeat(np.arange(len(ids)), tables), "bucket")

    def rank(batches):
        bucket, held = None, []

        def flush():
            if held:
                own = _held(held)
                for found in _best(*own, *own, k):
                    yield _batch(*found)
                held.clear()

        for batch in batches:
            for c, ids, m in zip(*(batch.column(x).to_pylist() for x in ("bucket", "ids", "m"))):
                if c != bucket:
                    yield from flush()
                    bucket = c
                held.append((ids, m))
        yield from flush()

    keys = _vectors(df, id_col, vector_col).mapInArrow(dealt, "bucket long, ids binary, m binary")
    met = keys.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(rank, PAIR)
    once = met.select(F.col("id_a").alias("query_id"), F.col("id_b").alias("doc_id"), "similarity").repartition("query_id").groupBy("query_id", "doc_id").agg(F.max("similarity").alias("similarity"))
    return _nearest(once, k)
