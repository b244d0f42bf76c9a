"""Exact top-k inner products of a query set against all vectors by columnar branch and bound.

Vectors are turned into integers floor(256 x). Candidates lie in vertical layout (one row per dimension). For a
query the products are accumulated block by block of dimensions; what the remaining dimensions can still add is
at most the product of the remaining norms of both sides (Cauchy and Schwarz), so after every block the
candidates whose bound is below the k-th best lower bound so far are dropped and the survivors compacted. Scores
are whole numbers; where products could leave the exact range of a double, the same runs on Python integers.

Queries come in chunks of at most about ``QUERY_BYTES``; a chunk is broadcast and every partition of the
candidates returns its k best, which are merged. A vector that is null, empty or holds a null or non-finite
component takes no part, nor does a row without id. Vectors of different lengths are not compared. Every row that
shares the query's id is its own. Equal query rows are answered each. Scores beyond 64 bits are cut to their range.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

K = 5
STEP = 16
CANDIDATES = 32_768
QUERY_BYTES = 16 << 20
#: Queries whose first block of products with all buffered candidates is held at once.
SLICE = 256
SCHEMA = "query_row bigint, query_id bigint, vec_id bigint, score bigint"


def integers(vectors: list[np.ndarray]) -> np.ndarray:
    """floor(256 x) of equally long vectors as a matrix; objects where 64-bit sums might overflow."""
    scaled = np.floor(256 * np.asarray(vectors, np.float64))
    if scaled.size and np.abs(scaled).max() ** 2 * scaled.shape[1] >= 2 ** 53:
        return np.array([[int(x) for x in row] for row in scaled.tolist()], object)
    return scaled


def best(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int = K, step: int = STEP):
    """For every query the (score, id) of its k best candidates by score, ties to the smaller id."""
    if queries.dtype == object or vectors.dtype == object:
        for q, i in zip(queries.astype(object), own):
            scores = vectors.astype(object) @ q
            yield sorted(((int(s), int(v)) for s, v in zip(scores, ids) if v != i), key=lambda r: (-r[0], r[1]))[:k]
        return
    layout = np.ascontiguousarray(vectors.T)
    dims = len(layout)
    cuts = list(range(0, dims, step)) + [dims]
    # Norms of what follows each block, slightly enlarged against rounding.
    rest = [np.sqrt((layout[c:] ** 2).sum(0)) * (1 + 1e-9) for c in cuts[1:]]
    rest_q = [np.sqrt((queries[:, c:] ** 2).sum(1)) * (1 + 1e-9) for c in cuts[1:]]
    for j, (q, i) in enumerate(zip(queries, own)):
        if j % SLICE == 0:
            first = queries[j:j + SLICE, :cuts[1]] @ layout[:cuts[1]]
        alive = np.flatnonzero(ids != i)
        score = first[j % SLICE][alive]
        for b in range(len(cuts) - 1):
            if b:
                score = score + q[cuts[b]:cuts[b + 1]] @ layout[cuts[b]:cuts[b + 1]][:, alive]
            slack = rest_q[b][j] * rest[b][alive]
            if len(alive) > k:
                floor = np.partition(score - slack, len(alive) - k)[len(alive) - k]
                stay = score + slack >= floor - 0.5
                alive, score = alive[stay], score[stay]
        order = np.lexsort((ids[alive], -score))[:k]
        yield [(int(score[o]), int(ids[alive[o]])) for o in order]


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, embedding)`` with doubles, without rows that take no part."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.coalesce(finite, F.lit(False))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("embedding"))


def _search(shared, k: int):
    def groups(ids, vectors):
        by: dict[int, list] = {}
        for i, v in zip(ids, vectors):
            by.setdefault(len(v), []).append((i, v))
        return {d: (np.array([i for i, _ in rows], np.int64), integers([v for _, v in rows])) for d, rows in by.items()}

    def run(batches):
        asked: dict[int, list] = {}
        for row, (i, v) in enumerate(shared.value):
            asked.setdefault(len(v), []).append((row, i, v))
        asked = {d: ([r for r, _, _ in q], np.array([i for _, i, _ in q], np.int64), integers([v for _, _, v in q])) for d, q in asked.items()}
        held: dict[int, list] = {}
        ids, vectors = [], []

        def merge():
            for d, (have, matrix) in groups(ids, vectors).items():
                if d in asked:
                    rows, own, queries = asked[d]
                    for row, found in zip(rows, best(queries, own, matrix, have, k)):
                        held[row] = sorted(held.get(row, []) + found, key=lambda r: (-r[0], r[1]))[:k]
            ids.clear()
            vectors.clear()

        for batch in batches:
            column = batch.column("embedding")
            ids += batch.column("vec_id").to_pylist()
            values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            vectors += [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
            if len(ids) >= CANDIDATES:
                merge()
        merge()
        clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
        flat = [(row, clip(s), v) for row, found in held.items() for s, v in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r for r, _, _ in flat], pa.int64()), pa.array([shared.value[r][0] for r, _, _ in flat], pa.int64()),
             pa.array([v for _, _, v in flat], pa.int64()), pa.array([s for _, s, _ in flat], pa.int64())],
            ["query_row", "query_id", "vec_id", "score"])
    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for every row of ``queries``; both sides are ``(vec_id, embedding)``."""
    vectors, queries = usable(vectors), usable(queries)
    weight = queries.agg(F.coalesce(F.sum(F.size("embedding") * 8 + 16), F.lit(0))).first()[0]
    chunks = max(1, math.ceil(weight / QUERY_BYTES))
    context, out = vectors.sparkSession.sparkContext, None
    for c in range(chunks):
        part = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == c)
        rows = sorted(((r.vec_id, np.array(r.embedding)) for r in part.toLocalIterator()), key=lambda r: r[0])
        found = vectors.mapInArrow(_search(context.broadcast(rows), k), SCHEMA).withColumn("chunk", F.lit(c))
        out = found if out is None else out.unionByName(found)
    place = F.row_number().over(Window.partitionBy("chunk", "query_row").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
