"""Mixing sources to target weights, with DataFrame functions only.

The documents of a source are laid end to end in a fixed pseudorandom order; their words are packed into
blocks of ``BLOCK`` words. The mix is a row of output shards. Every shard draws multinomial source counts: the
whole part of a source's expected slots is certain, the remaining slots are drawn with the remaining
probabilities (residual multinomial, so that totals stay near their targets). The slots of a source are numbered
through all shards; slot j is pass ``j div blocks`` over the source and block ``permutation(j mod blocks)`` of a
pseudorandom permutation of that pass. Joining by block index gives the words that the mix takes.

Targets share the words of all documents by weight, weights ``WEIGHTS`` repeating over the sources in code-point
order, null last. No target exceeds ``REPEATS`` times its source; the excess is shared again by weight. Passes
beyond ``REPEATS`` are not made, so no document is taken more than ``REPEATS`` times its size.

Null texts and wordless texts have size 0 and take 0. Repeated rows are documents of their own. Rows without id
are mixed like others; their order among equals does not change any result. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillsift.llm.common import word_count
from quillsift.operators.sizing import lookup_join
from quillsift.session import settled

WEIGHTS = (5, 2, 1)
REPEATS = 3
BLOCK = 64
#: Least slots of an output shard; shards grow with the number of sources and the root of all slots.
SHARD = 4096
ROUNDS = 10
#: A source row of a lookup is below 100 bytes (hashed key, numbers), so a broadcast stays below 10 MB.
LOOKUP_ROWS = 100_000


def permuted(index: Column, size: Column, *seed: Column) -> Column:
    """A pseudorandom permutation of 0 .. size - 1 by swap-or-not rounds; ``seed`` columns choose it."""
    def step(x, r):
        partner = F.pmod(F.pmod(F.xxhash64(*seed, r), size) - x, size)
        coin = F.xxhash64(F.greatest(x, partner), r, *seed) % 2
        return F.when(coin == 0, partner).otherwise(x)
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, step)


def uniform(*seed: Column) -> Column:
    """Hash of the seed as a number in [0, 1)."""
    return F.pmod(F.xxhash64(*seed), F.lit(1 << 52)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame) -> DataFrame:
    """Add ``weight`` and ``target`` to ``(source, key, source_size)``, one row per source."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int"))
    ranked = settled(sizes.withColumn("weight", weight.cast("double")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    limit, level, count = F.col("source_size") * float(REPEATS), 0.0, -1
    while True:
        # Sources at their limit leave the sharing; every round fixes at least one more or is the last.
        full = limit <= F.col("weight") * level
        row = ranked.agg(F.sum(F.when(full, limit).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))),
                         F.sum(full.cast("int"))).first()
        if row[2] == count or not row[1]:
            break
        count, level = row[2], (total - row[0]) / row[1]
    return ranked.withColumn("target", F.least(limit, F.col("weight") * level))


def laid_out(documents: DataFrame) -> DataFrame:
    """Rows with ``key`` (source as a fixed-length text) and ``start``, the words before them in their source.

    Prefix sums run inside about root-of-n cells per source and over the cells, never over a whole source.
    """
    rows = documents.withColumn("key", F.coalesce(F.md5("source"), F.lit("-")))
    n = rows.agg(F.count("*")).first()[0]
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("doc_id", "size"), F.lit(max(1, math.isqrt(n)))))
    cells = rows.groupBy("key", "cell").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("key", "cell", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("key", "cell").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(cells, ["key", "cell"]).withColumn("start", F.col("offset") + F.col("own")).drop("cell", "own", "offset")


def shard_counts(sources: DataFrame, block: int, shard: int) -> DataFrame:
    """``(key, blocks, shard, slots)``: multinomial source counts of every output shard."""
    wanted = sources.where("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block)).cast("bigint"))
    wanted = wanted.withColumn("want", F.col("target") * F.col("blocks") / F.col("source_size"))
    total, n = wanted.agg(F.coalesce(F.sum("want"), F.lit(0.0)), F.count("*")).first()
    size = max(shard, 64 * n, math.isqrt(int(total)))
    shards = max(1, round(total / size))
    per_shard = max(1, round(total / shards)) if total else 0
    share = F.col("want") * float(per_shard / total if total else 0)
    wanted = wanted.select("key", "blocks", F.floor(share).alias("sure"), (share - F.floor(share)).alias("rest"))
    upto = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    wanted = settled(wanted.withColumn("low", F.coalesce(F.sum("rest").over(upto), F.lit(0.0))))
    sure, rest = wanted.agg(F.coalesce(F.sum("sure"), F.lit(0)), F.coalesce(F.sum("rest"), F.lit(0.0))).first()
    draws = max(0, per_shard - sure)
    spark = sources.sparkSession
    drawn = spark.range(shards).select(F.col("id").alias("shard"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")) \
        if draws else spark.range(0).select(F.col("id").alias("shard"), F.lit(1).alias("draw"))
    # A draw meets only the sources whose stretch of the remaining probability lies in its unit cell.
    drawn = drawn.withColumn("u", uniform(F.lit("draw"), "shard", "draw") * float(rest)).withColumn("cell", F.floor("u"))
    cells = wanted.select("key", "low", (F.col("low") + F.col("rest")).alias("high")).withColumn(
        "cell", F.explode(F.sequence(F.floor("low"), F.floor("high"))))
    hits = drawn.join(cells, "cell").where("low <= u and u < high").groupBy("key", "shard").agg(F.count("*").alias("more"))
    sure_rows = wanted.select("key", "blocks", "sure", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))).alias("shard"))
    return sure_rows.join(hits, ["key", "shard"], "left").select(
        "key", "blocks", "shard", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("slots")).where("slots > 0")


def mix(documents: DataFrame, size: Column | None = None, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """``(doc_id, source, mark, size, source_size, target, taken)`` of every row; ``mark`` is a hash of the text."""
    spark = documents.sparkSession
    size = word_count(F.col("text")) if size is None else size
    narrow = documents.select("doc_id", "source", F.xxhash64("text").alias("mark"), size.alias("size"))
    laid = settled(laid_out(narrow))
    sizes = laid.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    sources = settled(targets(sizes))
    n = sources.count()
    counts = shard_counts(sources, block, shard)
    before = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slots = counts.withColumn("first", F.coalesce(F.sum("slots").over(before), F.lit(0))).repartition(tasks, "key", "shard").select(
        "key", "blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("slots") - 1)).alias("slot"))
    slots = slots.withColumn("turn", F.floor(F.col("slot") / F.col("blocks"))).where(F.col("turn") < REPEATS)
    taken = slots.groupBy("key", permuted(F.pmod("slot", "blocks"), F.col("blocks"), F.col("key"), F.col("turn")).alias("block")).agg(
        F.count("*").alias("times"))
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    parts = laid.where("size > 0").select("key", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block)
    got = parts.withColumn("words", words).join(taken, ["key", "block"]).groupBy("key", "start", "size").agg(
        F.sum(F.col("words") * F.col("times")).alias("taken"))
    # Start and size name a document of its source: only wordless documents share a start.
    out = laid.join(got, ["key", "start", "size"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("bigint"))
    out = lookup_join(out, sources.select("key", "source_size", "target"), "key", n, spread_by=("start",), limit=LOOKUP_ROWS)
    return out.select("doc_id", "source", "mark", "size", "source_size", "target", "taken")


def copies(taken: Column, size: Column, *seed: Column) -> Column:
    """Whole copies of a document that realise the words taken from it, the fraction drawn by a hash of ``seed``."""
    whole = F.floor(taken / size)
    return F.when(size > 0, whole + (uniform(F.lit("copy"), *seed) < taken / size - whole).cast("int")).otherwise(0).cast("int")


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The rows of ``documents``, each as often as the mix takes it; equal rows share what they take."""
    taken = mix(documents).groupBy("doc_id", "source", "mark", "size").agg(F.avg("taken").alias("taken"))
    taken = taken.select(*(F.col(c).alias(f"_{c}") for c in taken.columns))
    same = (F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("source").eqNullSafe(F.col("_source"))
            & (F.xxhash64("text") == F.col("_mark")))
    found = documents.join(taken, same)
    times = copies(F.col("_taken"), F.col("_size"), F.col("_doc_id"), F.col("_mark"))
    repeated = found.withColumn("_times", times).where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return repeated.select(*(documents[c] for c in documents.columns))
