"""From ranked chunks to the parents shown as evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillsift.config import Retrieval
from quillsift.functions import text as tx
from quillsift.operators.sizing import lookup_join


def rank_prior(rank: Column) -> Column:
    """Score of a place in the pool when no reranker is given; the first place has rank one."""
    return F.lit(4.0) / (F.lit(1.0) + (rank - 1) / F.lit(8.0))


def order_final(candidates: DataFrame) -> DataFrame:
    """Order by score plus adjustment; both stay visible. Adds ``final_score`` and ``place``."""
    final = F.round(F.col("score") + F.col("adjustment"), 9)
    w = Window.partitionBy("qid").orderBy(F.desc("final_score"), "chunk_id")
    return candidates.withColumn("final_score", final).withColumn("place", F.row_number().over(w))


def materialize(ordered: DataFrame, parent_rows: DataFrame, questions: int,
                cfg: Retrieval | None = None) -> DataFrame:
    """The best chunk of each parent, the first ``parents_k`` parents per question, with their text.

    With ``parent_chars`` longer parents are cut to a window around the chunk, its offsets shifted.
    ``ordered`` needs ``qid, chunk_id, parent_id, start, end, place``; ``parent_rows`` needs
    ``parent_id, text``. At most ``questions * parents_k`` parents are looked up. ``parents_k = 0``
    keeps all.
    """
    cfg = cfg or Retrieval()
    w = Window.partitionBy("qid", "parent_id").orderBy("place")
    best = ordered.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    across = Window.partitionBy("qid").orderBy("place")
    best = best.withColumn("context", F.row_number().over(across) - 1)
    per_question = cfg.parents_k or cfg.pool_k
    if cfg.parents_k:
        best = best.where(F.col("context") < cfg.parents_k)
    best = best.drop("text", "doc_id", "number", "heading")
    rows = lookup_join(parent_rows, best, "parent_id", questions * per_question,
                       spread_by=["parent_id"], limit=200_000)
    size = F.length("text")
    most = size if cfg.parent_chars is None else F.lit(cfg.parent_chars)
    first = F.when(size > most, F.greatest(F.lit(0), F.least(
        F.col("start") - cfg.parent_lead, size - most))).otherwise(F.lit(0))
    rows = rows.withColumn("window_start", first)
    shown = F.least(most, size)
    return (rows.withColumn("window_end", F.col("window_start") + shown)
            .withColumn("text", F.substring("text", F.col("window_start") + 1, shown))
            .withColumn("seed_start", F.col("start") - F.col("window_start"))
            .withColumn("seed_end", F.col("end") - F.col("window_start"))
            .drop("start", "end"))


def token_coverage(gold: DataFrame, picked: DataFrame, questions: int, total: int,
                   cuts=(1, 5, 20)) -> DataFrame:
    """Share of answer tokens (with repeats) found in the first chunks of each ranking.

    ``gold`` is ``(qid, answer)``; ``picked`` is ``(stage, qid, rank, header, text)``. The mean is
    over all ``total`` questions: one without hits adds nothing but still counts.
    """
    want = (gold.select("qid", F.explode(tx.tokens(F.col("answer"))).alias("token"))
            .groupBy("qid", "token").agg(F.count("*").alias("wanted")))
    size = F.greatest(F.size(tx.tokens(F.col("answer"))), F.lit(1))
    sizes = gold.select("qid", size.alias("n"))
    depth = F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c >= F.col("rank"))
    words = tx.tokens(F.concat_ws(" ", "header", "text"))
    # Count inside each (stage, depth, question, token) before meeting the answers.
    have = (picked.select("stage", "qid", F.explode(depth).alias("k"), words.alias("w"))
            .select("stage", "qid", "k", F.explode("w").alias("token"))
            .groupBy("stage", "k", "qid", "token").agg(F.count("*").alias("found")))
    per_question = (have.join(want, ["qid", "token"])
                    .groupBy("stage", "k", "qid").agg(F.sum(F.least("found", "wanted")).alias("hit"))
                    .join(sizes, "qid"))
    return per_question.groupBy("stage", "k").agg(
        (F.sum(F.col("hit") / F.col("n")) / F.lit(total)).alias("coverage"))
