"""Reciprocal-rank fusion, diversification per parent and splicing of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def fuse(ranked: DataFrame, branches, constant: int = 60) -> DataFrame:
    """``(qid, chunk_id, rrf, rank)`` from rows ``(branch, qid, chunk_id, rank)``.

    Contributions are added in the order of ``branches``: floating-point sums depend on it and a
    plain ``sum`` would let task order decide ties. A chunk listed twice in a branch counts once,
    with the better rank.
    """
    score = F.lit(0.0)
    for name in branches:
        best = F.min(F.when(F.col("branch") == name, F.col("rank")))
        score = score + F.coalesce(F.lit(1.0) / (F.lit(constant) + best), F.lit(0.0))
    fused = ranked.groupBy("qid", "chunk_id").agg(score.alias("rrf"))
    w = Window.partitionBy("qid").orderBy(F.desc("rrf"), "chunk_id")
    return fused.withColumn("rank", F.row_number().over(w))


def diversify(ranked: DataFrame, limit: int, per_parent: int) -> DataFrame:
    """At most ``per_parent`` rows of a parent, then the first ``limit`` rows of each question.

    Needs ``qid, parent_id, rank``. The greedy walk accepts a row exactly when its number within the
    parent is small enough, hence two rank filters. A limit of zero means no limit.
    """
    parent = Window.partitionBy("qid", "parent_id").orderBy("rank")
    kept = ranked.withColumn("_n", F.row_number().over(parent)).where(F.col("_n") <= per_parent)
    kept = kept.drop("_n").withColumnRenamed("rank", "source_rank")
    whole = Window.partitionBy("qid").orderBy("source_rank")
    out = kept.withColumn("rank", F.row_number().over(whole))
    return out.where(F.col("rank") <= limit) if limit > 0 else out


def splice(pool: DataFrame, reserve: DataFrame, limit: int) -> DataFrame:
    """Put the reserve list in front of the pool's last places, drop repeats and cut at ``limit``.

    Both inputs are ``(qid, chunk_id, rank)``. The head kept in front is ``limit`` minus the size of
    the question's reserve. An item met twice keeps its first place.
    """
    size = reserve.groupBy("qid").agg(F.count("*").alias("_reserve"))
    base = pool.select("qid", "chunk_id", "rank").join(size, "qid", "left")
    keep = F.greatest(F.lit(limit) - F.coalesce("_reserve", F.lit(0)), F.lit(0))
    placed = base.select("qid", "chunk_id", F.when(F.col("rank") <= keep, 0).otherwise(2).alias("part"), "rank")
    merged = placed.unionByName(reserve.select("qid", "chunk_id", F.lit(1).alias("part"), "rank"))
    first = merged.groupBy("qid", "chunk_id").agg(F.min(F.struct("part", "rank")).alias("place"))
    w = Window.partitionBy("qid").orderBy("place")
    return (first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
            .select("qid", "chunk_id", "rank", (F.col("place.part") == 1).alias("from_reserve")))
