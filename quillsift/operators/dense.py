"""Exact nearest neighbours by inner product over an embedding column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quillsift.operators.sizing import lookup_join

DIGITS = 9
# Questions whose blocks may be broadcast, questions of a block, bytes of a pack of vectors.
QUESTION_BOUND, BLOCK, PACK_BYTES = 20_000, 2_048, 1 << 20
# Bytes of an Arrow batch: a row is a pack beside a block, so by rows alone a batch would hold all packs of a task.
BATCH_BYTES = 8 << 20
OUT = "qid long, id long, score double"
PACK = "ids binary, matrix binary, first long"


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _packed(batches) -> Iterator[pa.RecordBatch]:
    """Vectors of a task to packs of bounded size, one row each."""
    ids, rows, held = [], [], 0

    def flush():
        numbers = np.concatenate(ids)
        return pa.RecordBatch.from_arrays(
            [pa.array([numbers.tobytes()]), pa.array([np.vstack(rows).tobytes()]), pa.array([int(numbers[0])])], ["ids", "matrix", "first"])

    for batch in batches:
        if not batch.num_rows:
            continue
        ids.append(batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64))
        rows.append(_matrix(batch.column("vector")))
        held += rows[-1].nbytes
        if held >= PACK_BYTES:
            yield flush()
            ids, rows, held = [], [], 0
    if ids:
        yield flush()


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` best scores of every row, by (score descending, id ascending).

    The k-th score of a row comes from a partial selection; everything that ties with it takes part in the order.
    """
    if scores.shape[1] > k:
        kth = np.partition(scores, -k, axis=1)[:, -k]
        row, column = np.nonzero(scores >= kth[:, None])
    else:
        row, column = (x.ravel() for x in np.indices(scores.shape))
    order = np.lexsort((ids[column], -scores[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def _met(k: int):
    """A pack of vectors beside a block of questions to the pack's best of every question."""
    def run(batches):
        for batch in batches:
            for pack, matrix, asked in zip(*(batch.column(c) for c in ("ids", "matrix", "asked"))):
                ids = np.frombuffer(pack.as_buffer(), np.int64)
                vectors = np.frombuffer(matrix.as_buffer(), np.float64).reshape(len(ids), -1)
                qids = asked.values.field("qid").to_numpy(zero_copy_only=False)
                scores = np.round(_matrix(asked.values.field("vector")) @ vectors.T, DIGITS)
                row, column = best(scores, ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(qids[row]), pa.array(ids[column]), pa.array(scores[row, column])], ["qid", "id", "score"])
    return run


def nearest(questions: DataFrame, vectors: DataFrame, k: int = 100,
            question_bound: int = QUESTION_BOUND, block: int = BLOCK) -> DataFrame:
    """``(qid, id, score, rank)`` of the ``k`` best vectors of every question.

    ``questions`` is ``(qid, vector)`` and ``vectors`` is ``(id, vector)``, all of one length. Questions are gathered
    into blocks of about ``block``, vectors into packs where they lie. Every pack meets every block once, and only
    the ``k`` best of a pack leave the task, so no pair table is formed. Blocks are broadcast up to
    ``question_bound`` questions; beyond that packs and blocks meet in a salted join.
    """
    vectors.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    count = questions.count()
    blocks = max(1, -(-count // block))
    asked = (questions.select(F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("block"), F.col("qid").cast("long").alias("qid"), "vector")
             .groupBy("block").agg(F.collect_list(F.struct("qid", "vector")).alias("asked")))
    packs = vectors.select(F.col("id").cast("long").alias("id"), "vector").mapInArrow(_packed, PACK)
    spread = packs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = lookup_join(spread, asked, "block", count, spread_by=["first"], limit=question_bound)
    return _ranked(met.select("ids", "matrix", "asked").mapInArrow(_met(k), OUT), k)


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
