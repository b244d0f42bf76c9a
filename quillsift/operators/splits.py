"""Duplicate-aware groups, hash-ordered splits and subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quillsift.functions import text as tx
from quillsift.operators.sizing import hot_split_join
from quillsift.session import settled


def global_rank(rows: DataFrame, digest: str, by: tuple = (), prefix: int = 4) -> DataFrame:
    """Add ``rank`` (from 1, within ``by``) in the order of a hex digest without sorting on one machine.

    Digests spread evenly over their first characters. Rows are counted per prefix, the at most
    ``16 ** prefix`` counts of each of a few ``by`` groups are summed up, and each prefix is ranked for
    itself. ``rows`` is read twice, so hand over something stored.
    """
    keyed = rows.withColumn("_p", F.substring(digest, 1, prefix))
    sizes = keyed.groupBy(*by, "_p").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    inside = Window.partitionBy(*by, "_p").orderBy(digest)
    ranked = keyed.join(F.broadcast(offsets), [*by, "_p"])
    return ranked.withColumn("rank", F.row_number().over(inside) + F.col("_off")).drop("_p", "_off")


def connected(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from every node of an edge list ``(u, v)``.

    Alternates two star steps until nothing changes: every node first links its larger neighbours,
    then its smaller ones, to the smallest node it sees. Rounds grow with the logarithm of the size.
    The smallest neighbour is a partial aggregate and hot nodes are joined apart, so a node with a
    third of all edges does not end in one task. Returns ``(node, root)``, isolated nodes left out.
    """
    current = settled(edges.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        total = current.count()
        if not total:
            break
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        near = near.select("u", F.least("u", "m").alias("m"), "n")
        large = hot_split_join(both, near, "u", "n", 2 * total).where("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        near = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        joined = hot_split_join(large, near, "u", "n", total)
        small = joined.select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        current = settled(small.where("u <> v").distinct())
        mark = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == state:
            break
        state = mark
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))


def duplicate_groups(records: DataFrame) -> DataFrame:
    """``(id, root)``: records sharing a normalised question or answer, directly or through others.

    Every key links its records to its smallest id: one edge per record and key, never all pairs.
    """
    keyed = records.select(F.col("id").cast("string").alias("id"),
                           F.sha2(tx.group_key(F.col("question")), 256).alias("qk"),
                           F.sha2(tx.group_key(F.col("answer")), 256).alias("ak"))
    keyed = settled(keyed)
    rows = keyed.select("id", F.explode(F.array(F.concat(F.lit("q"), "qk"), F.concat(F.lit("a"), "ak"))).alias("key"))
    heads = rows.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1")
    total = 2 * keyed.count()
    edges = hot_split_join(rows, heads, "key", "n", total).select(F.col("id").alias("u"), F.col("head").alias("v"))
    roots = connected(edges)
    return settled(keyed.select("id").join(roots.withColumnRenamed("node", "id"), "id", "left").select(
        "id", F.coalesce("root", "id").alias("root")))


def group_digests(groups: DataFrame, seed: int) -> DataFrame:
    """``(root, n, digest)``: sha256 over the seed, the group's size and two sums of parts of its ids' sha256.

    Sums are partial aggregates, so the same definition serves a group of any size and nobody lists its ids.
    """
    part = lambda k: F.conv(F.substring(F.sha2("id", 256), 12 * k + 1, 12), 16, 10).cast("decimal(20,0)")
    sums = groups.groupBy("root").agg(F.count("*").alias("n"), F.sum(part(0)).alias("a"), F.sum(part(1)).alias("b"))
    return sums.select("root", "n", F.sha2(F.concat_ws("|", F.lit(str(seed)), "n", "a", "b"), 256).alias("digest"))


def hash_split(groups: DataFrame, seed: int = 2026) -> DataFrame:
    """``(id, split, pos)``: whole groups dealt 80/10/10 in hash order, items in hash order inside.

    The cuts round half to even. Fewer than ten groups are an error.
    """
    digests = settled(group_digests(groups, seed))
    n = digests.count()
    if n < 10:
        raise ValueError("need at least 10 independent groups for an 80/10/10 split")
    first, second = max(1, round(0.8 * n)), min(n - 1, round(0.9 * n))
    split = F.when(F.col("rank") <= first, "train").when(F.col("rank") <= second, "dev").otherwise("holdout")
    dealt = settled(global_rank(digests, "digest").select("root", "n", split.alias("split")))
    # Group sizes are known by now, so hot groups are told apart without another count.
    placed = hot_split_join(groups, dealt, "root", "n", groups.count())
    keyed = settled(placed.select("id", "split", tx.digest(
        seed, F.concat(F.lit('"'), "split", F.lit('"')), tx.json_text(F.col("id"))).alias("digest")))
    return global_rank(keyed, "digest", by=("split",)).select("id", "split", F.col("rank").cast("bigint").alias("pos"))


def hashed_subset(ids: DataFrame, size: int, seed: int = 2026) -> DataFrame:
    """The first ``size`` ids in the order of sha256 over seed and id, with their position."""
    if size <= 0:
        raise ValueError("size must be positive")
    keyed = ids.select(F.col("id").cast("string").alias("id")).withColumn(
        "digest", tx.digest_object(id=tx.json_text(F.col("id")), seed=seed))
    chosen = keyed.orderBy("digest").limit(size)
    place = F.row_number().over(Window.orderBy("digest"))
    return chosen.select("id", place.cast("bigint").alias("pos"), "digest")
