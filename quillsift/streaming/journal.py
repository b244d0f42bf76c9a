"""Append-only journals, resumable work and attempt histories.

A journal is a folder of parquet files with one row per finished id, next to the identity of the run
it belongs to. Spark's commit protocol takes the place of line-wise recovery: files of an interrupted
write are never visible. The stream checkpoint takes the place of the read position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillsift.config import Attempts
from quillsift.operators.sizing import lookup_join
from quillsift.sources.integrity import claim, exists, pending


def open_journal(spark: SparkSession, path: str, identity: dict, schema: str) -> DataFrame:
    """Rows committed so far (none for a new journal); another identity is an error."""
    claim(spark, path, identity)
    if exists(spark, f"{path}/rows"):
        return spark.read.schema(schema).parquet(f"{path}/rows")
    return spark.createDataFrame([], schema)


def append(spark: SparkSession, rows: DataFrame, path: str, identity: dict, schema: str, key: str = "id") -> None:
    """Commit rows not yet in the journal; repeating the call changes nothing.

    An id that occurs twice among the new rows is an error. The journal is only scanned for the ids at
    hand; it does not move while the new rows are few.
    """
    done = open_journal(spark, path, identity, schema)
    twice = repeated(rows, key).first()
    if twice is not None:
        raise ValueError(f"duplicate journal id: {twice[key]}")
    ids = rows.select(key)
    seen = lookup_join(done.select(key), ids, key, ids.count(), "left_semi", spread_by=[key])
    pending(rows, seen, key).write.mode("append").parquet(f"{path}/rows")


def repeated(journal: DataFrame, key: str = "id") -> DataFrame:
    """Ids committed more than once; a sound journal has none."""
    return journal.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def follow(source: DataFrame, path: str, identity: dict, schema: str, key: str = "id"):
    """Carry a stream into a journal and stop when all available files are processed.

    Every micro-batch commits only ids the journal does not hold, so a batch replayed after a failure
    is harmless. Limit a session with ``maxFilesPerTrigger`` on the source or by stopping the query;
    the next call goes on from the checkpoint.
    """

    def commit(batch: DataFrame, _: int) -> None:
        append(batch.sparkSession, batch, path, identity, schema, key)

    query = (source.writeStream.foreachBatch(commit).option("checkpointLocation", f"{path}/_progress")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def token_ladder(model_limit: int, policy: Attempts = Attempts()) -> list:
    """Output budgets that fit beside the input into the model's window, smallest first."""
    room = min(policy.total_tokens, model_limit) - policy.input_tokens
    if room < policy.budgets[0]:
        raise ValueError("the model window cannot hold the input and the smallest output budget")
    return sorted({min(b, room) for b in policy.budgets})


def next_attempts(history: DataFrame, ladder, policy: Attempts = Attempts()) -> DataFrame:
    """What to try next for each id: ``(id, budget, focused)``; finished ids are left out.

    ``history`` is ``(id, attempt, budget, focused, accepted, faulty, hit_token_limit)``, at most a few
    rows per id. Only the last attempt and two summaries decide, all partial aggregates, so the same
    function works on a batch and, in update mode, on a stream of attempts.
    """
    last = F.max_by(F.struct("budget", "focused", "accepted", "faulty", "hit_token_limit"), "attempt")
    state = history.groupBy("id").agg(last.alias("last"), F.count("*").alias("n"), F.bool_or("focused").alias("was_focused"))
    larger = F.array_min(F.filter(F.array(*[F.lit(b) for b in ladder]), lambda b: b > F.col("last.budget")))
    running = ~F.col("last.accepted") & (F.col("n") < policy.max_attempts)
    refocus = F.when(~F.col("was_focused"), F.struct(F.col("last.budget").alias("budget"), F.lit(True).alias("focused")))
    extend = F.when(F.col("last.hit_token_limit") & larger.isNotNull(),
                    F.struct(larger.alias("budget"), F.col("last.focused").alias("focused")))
    step = F.when(running, F.when(F.col("last.faulty"), refocus).otherwise(extend))
    return state.select("id", step.alias("s")).where(F.col("s").isNotNull()).select("id", "s.budget", "s.focused")
