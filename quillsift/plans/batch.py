"""Retrieval over a stream of questions that can be interrupted, and checks before its records are used again.

Questions arrive as files. Every micro-batch ranks its questions against a stored index and writes one folder named
after the batch and the identity of the run. A batch that is replayed after a failure overwrites its own folder, so
nothing written earlier is scanned and nothing is written twice. Only the settings, questions and index that a run
was started with may continue it.
"""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from quillsift.config import Retrieval
from quillsift.operators import boosts, context, fusion, lexical
from quillsift.operators.sizing import hinted, lookup_join
from quillsift.session import settled
from quillsift.sources import integrity
from quillsift.sources.sinks import Index

QUESTION = "qid long, question string"
STAGES = (*lexical.BRANCHES, "rrf", "reranked")
#: Parts of an identity that have to agree before records are used again, in the order in which they are reported.
CHECKS = ("missing", "question", "models", "retrieval", "code", "mode", "mode_config", "index")


class Interrupted(RuntimeError):
    """A session ended before its questions did; calling ``run`` again goes on."""


def code_hash() -> str:
    """Digest of this package's sources."""
    root, whole = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), hashlib.sha256()
    for folder, _, files in sorted(os.walk(root)):
        for name in sorted(f for f in files if f.endswith(".py")):
            with open(os.path.join(folder, name), "rb") as source:
                whole.update(name.encode() + b"\0" + source.read() + b"\0")
    return whole.hexdigest()


def identity(questions: DataFrame, index: Index, cfg: Retrieval, mode: str = "lexical", models: dict | None = None) -> dict:
    """What a run's records depend on. ``mode_config`` holds the pool size of lexical runs."""
    if mode not in ("full", "lexical"):
        raise ValueError("mode must be full or lexical")
    asked = integrity.table_digest(questions, "qid", "question").first().identity
    return {"questions": asked, "index": index.identity, "retrieval": json.dumps(asdict(cfg), sort_keys=True), "mode": mode,
            "mode_config": str(cfg.lexical_pool_k) if mode == "lexical" else None,
            "models": json.dumps(models or {}, sort_keys=True), "code": code_hash()}


def records(questions: DataFrame, index: Index, cfg: Retrieval, dense: DataFrame | None = None) -> DataFrame:
    """``(qid, question, stages, contexts)``: one record per question, ids of each stage in rank order.

    ``dense`` rows ``(qid, chunk_id, rank)`` take part in the fusion. Questions without any candidate have empty lists.
    """
    asked = lexical.Questions.of(questions)
    branches = [*lexical.BRANCHES, *(["dense"] if dense is not None else [])]
    ranked = index.rankings(asked, cfg).select("branch", "qid", "chunk_id", "rank")
    if dense is not None:
        ranked = ranked.unionByName(dense.select(F.lit("dense").alias("branch"), "qid", "chunk_id", "rank"))
    ranked = settled(ranked)
    fused = settled(fusion.fuse(ranked, branches, cfg.rrf_constant))
    rows = asked.count * (cfg.broad_k + 2 * cfg.precise_k + (cfg.dense_k if dense is not None else 0))
    # The pool needs the parents of all candidates but the text of its own rows only.
    owners = index.chunks.select("chunk_id", "parent_id")
    placed = lookup_join(owners, fused, "chunk_id", rows, spread_by=["chunk_id"])
    pool = settled(fusion.diversify(placed, cfg.lexical_pool_k if dense is None else cfg.pool_k, cfg.per_parent))
    most = asked.count * max(cfg.lexical_pool_k, cfg.pool_k)
    body = index.chunks.select("chunk_id", "start", "end", "header", "text")
    candidates = lookup_join(body, pool, "chunk_id", most, spread_by=["chunk_id"])
    features = hinted(boosts.question_features(questions), asked.count)
    scored = boosts.adjustments(candidates, features, cfg).withColumn("score", context.rank_prior(F.col("rank")))
    ordered = settled(context.order_final(scored).drop("text"))
    shown = context.materialize(ordered, index.parents, asked.count, cfg)
    stage = ranked.select("qid", F.col("branch").alias("stage"), "chunk_id", "rank").unionByName(
        fused.select("qid", F.lit("rrf").alias("stage"), "chunk_id", "rank")).unionByName(
        ordered.select("qid", F.lit("reranked").alias("stage"), "chunk_id", F.col("place").alias("rank")))
    lists = (stage.groupBy("qid", "stage").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("ids"))
             .groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("stage", F.col("ids.chunk_id")))).alias("found")))
    fields = ["context", "parent_id", F.col("chunk_id").alias("seed_chunk_id"), "seed_start", "seed_end", "final_score", "text"]
    contexts = shown.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("contexts"))
    none = F.array().cast("array<bigint>")
    stages = F.map_from_arrays(F.array(*[F.lit(s) for s in (*branches, "rrf", "reranked")]),
                               F.array(*[F.coalesce(F.col("found")[s], none) for s in (*branches, "rrf", "reranked")]))
    return questions.join(lists, "qid", "left").join(contexts, "qid", "left").select("qid", "question", stages.alias("stages"), "contexts")


def run(spark: SparkSession, queue: str, target: str, index: Index, cfg: Retrieval, known: dict, batches: int | None = None,
        after_write=None) -> DataFrame:
    """Carry the question files of ``queue`` into records below ``target``; returns all records.

    ``batches`` ends the session before the batch after so many; ``after_write(batch)`` runs between the write of a
    batch and its commit. Either way ``Interrupted`` (or the hook's error) is raised and the next call goes on.
    """
    integrity.claim(spark, target, known)
    mark = hashlib.sha256(json.dumps(known, sort_keys=True).encode()).hexdigest()[:16]
    done, failures = [0], []

    def commit(batch: DataFrame, number: int) -> None:
        try:
            if batches is not None and done[0] >= batches:
                raise Interrupted(f"paused before batch {number}")
            rows = integrity.with_provenance(records(batch.select("qid", "question"), index, cfg), known)
            rows.write.mode("overwrite").parquet(f"{target}/records/run={mark}/batch={number}")
            if after_write is not None:
                after_write(number)
            done[0] += 1
        except Exception as error:
            failures.append(error)
            raise

    source = spark.readStream.schema(QUESTION).option("maxFilesPerTrigger", 1).parquet(queue)
    query = (source.writeStream.foreachBatch(commit).option("checkpointLocation", f"{target}/_progress")
             .trigger(availableNow=True).start())
    try:
        query.awaitTermination()
    except Exception:
        if failures:
            raise failures[0] from None
        raise
    return spark.read.parquet(f"{target}/records").drop("run", "batch")


# --- records used again -----------------------------------------------------------------------------------------------


def violated(expected: dict) -> Column:
    """Names of the checks that a row ``(cached, question, identity)`` fails; ``expected`` holds what is asked for.

    A mode or index that is not expected (``None``) is not checked; the pool size matters to lexical records only.
    """
    has = lambda name: F.col("identity")[name]
    differs = lambda name: ~has(name).eqNullSafe(F.lit(expected.get(name)))
    none = F.lit(False)
    rules = {
        "missing": F.col("cached").isNull(), "question": ~F.col("cached").eqNullSafe(F.col("question")),
        "models": differs("models"), "retrieval": differs("retrieval"), "code": differs("code"),
        "mode": differs("mode") if expected.get("mode") else none,
        "mode_config": (has("mode") == "lexical") & differs("mode_config"),
        "index": differs("index") if expected.get("index") else none,
    }
    failed = F.array(*[F.when(F.coalesce(rules[name], none), F.lit(name)) for name in CHECKS[1:]])
    return F.when(rules["missing"], F.array(F.lit("missing"))).otherwise(F.filter(failed, lambda x: x.isNotNull()))


def checked(questions: DataFrame, cache: DataFrame, expected: dict) -> DataFrame:
    """Every question with its cached record's columns and the array ``violations``.

    ``cache`` holds ``qid, question, identity`` (a map of texts) and whatever else a record has. Records of other
    questions are left out; a question cached twice is reported per record.
    """
    kept = cache.withColumnRenamed("question", "cached")
    return questions.select("qid", "question").join(kept, "qid", "left").withColumn("violations", violated(expected))


def violations(judged: DataFrame) -> DataFrame:
    """``(check, n, first_qid)`` of every check that some row fails."""
    return (judged.select("qid", F.explode("violations").alias("check"))
            .groupBy("check").agg(F.count("*").alias("n"), F.min("qid").alias("first_qid")))


def reusable(questions: DataFrame, cache: DataFrame, expected: dict) -> DataFrame:
    """Cached records of the questions, or an error that counts every failed check.

    All checks are observed while the records are written once: no job of their own, no second read.
    """
    seen = Observation()
    counts = [F.count_if(F.array_contains("violations", name)).alias(name) for name in CHECKS]
    rows = settled(checked(questions, cache, expected).observe(seen, *counts))
    failed = {name: n for name, n in seen.get.items() if n}
    if failed:
        raise ValueError(f"the cache cannot be used again: {failed}")
    return rows.drop("violations", "cached")


def with_identity(rows: DataFrame) -> DataFrame:
    """Records with their provenance as the map ``identity``."""
    return rows.withColumn("identity", F.from_json("provenance", "map<string,string>")).drop("provenance")
