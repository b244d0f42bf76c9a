"""Size checks behind broadcasts, and joins that survive hot keys.

A side of a join is broadcast only when a row bound for it has been proved (usually from a count of
the question table, which bounds everything derived from the questions). Beyond the bound the same
join runs as a shuffle whose hot keys are spread over salts or handled apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Rows of a narrow table (a few short columns) that fit comfortably in every executor.
BROADCAST_ROWS = 2_000_000
SALTS = 32


def hinted(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if ``rows``, a proven upper bound of its size, is within the limit."""
    return F.broadcast(df) if rows <= limit else df


def lookup_join(facts: DataFrame, side: DataFrame, on: str, rows: int, how: str = "inner",
                spread_by=None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join ``facts`` with a side of at most ``rows`` rows on one column.

    Small sides are broadcast, so ``facts`` does not move. Larger ones are joined by a shuffle over
    (key, salt): the salt of a fact comes from ``spread_by`` and every row of the side is repeated
    once per salt, so one key with a third of all facts is still cut into ``SALTS`` parts.
    """
    if rows <= limit:
        return facts.join(F.broadcast(side), on, how)
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int"))
    copies = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [on, "_salt"], how).drop("_salt")


def hot_split_join(facts: DataFrame, dims: DataFrame, on: str, weight: str, total: int,
                   share: int = 1000) -> DataFrame:
    """Inner join where ``dims`` holds one row per key and ``weight`` counts the facts of the key.

    Keys owning more than ``total / share`` facts are hot. There can be at most ``share`` of them,
    which bounds the broadcast; all other keys are small and go through an ordinary shuffle join.
    """
    threshold = max(total // share, 1)
    hot = dims.where(F.col(weight) > threshold)
    cold = dims.where(F.col(weight) <= threshold)
    marked = facts.join(F.broadcast(hot.select(on, F.lit(True).alias("_hot"))), on, "left")
    on_hot = facts.join(F.broadcast(hot), on)
    on_cold = marked.where(F.col("_hot").isNull()).drop("_hot").join(cold, on)
    return on_hot.unionByName(on_cold)


def spread(df: DataFrame) -> DataFrame:
    """Give a small table that arrives in fewer files than there are cores one task per core.

    Anything that would fill a scan task per core anyway is left as it is.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    split = 128 << 20
    return df.repartition(cores) if size < cores * split and len(df.inputFiles()) < cores else df
