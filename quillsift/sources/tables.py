"""Readers of the parquet tables the registered queries run on, in the shapes operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillsift.operators.sizing import spread


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Documents spread over the cores; only the named columns are read."""
    return spread(load(spark, folder, "documents").select(*(columns or ("doc_id", "text", "source"))))


def questions(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "benchmark").select(
        F.col("item_id").alias("qid"), F.col("text").alias("question"))


def qa_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """A user turn with the assistant turn right after it.

    An equi-join on (conversation, turn): unlike a window over the conversation it stays spread when
    one conversation holds a large part of all turns.
    """
    turns = spread(load(spark, folder, "conversations"))
    asked = turns.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("question"))
    replied = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return asked.join(replied, ["conv_id", "turn"]).select(
        F.concat_ws(":", "conv_id", "turn").alias("id"), "question", "answer")


def with_question_turn(turns: DataFrame, stretch: int = 1024) -> DataFrame:
    """Turns with ``asked``: the latest user turn up to each, null before the first one.

    Conversations are cut into stretches of turns. Each is searched for itself, and what earlier stretches end
    with comes from one row per stretch, so a conversation that holds a large part of all turns stays spread.
    """
    cut = turns.withColumn("_part", F.floor(F.col("turn") / stretch))
    user = F.when(F.col("role") == "user", F.col("turn"))
    inside = Window.partitionBy("conv_id", "_part").orderBy("turn")
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = cut.groupBy("conv_id", "_part").agg(F.max(user).alias("_last"))
    carried = ends.select("conv_id", "_part", F.last("_last", True).over(before).alias("_carried"))
    rows = cut.withColumn("_own", F.last(user, True).over(inside)).join(carried, ["conv_id", "_part"])
    return rows.withColumn("asked", F.coalesce("_own", "_carried")).drop("_part", "_own", "_carried")
