"""Registered retrieval queries: the driver's benchmark items asked against its documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillsift.config import Retrieval
from quillsift.operators import context, corpus, dense, evidence, fusion, lexical
from quillsift.operators.sizing import lookup_join
from quillsift.plans import batch, retrieval as plans, variants
from quillsift.plans.retrieval import variant
from quillsift.session import ensure_checkpoint_dir, settled
from quillsift.sources import sinks, tables

CFG = Retrieval()


def _inputs(spark: SparkSession, folder: str):
    return (plans.Corpus(tables.documents(spark, folder)),
            lexical.Questions.of(tables.questions(spark, folder)))


def _branch(spark, folder, name):
    docs, qs = _inputs(spark, folder)
    return lexical.rankings(docs.chunks(), qs, CFG, (name,)).withColumn("score", F.round("score", 6))


def bm25_topk(spark, folder) -> DataFrame:
    return _branch(spark, folder, "bm25").select("qid", "chunk_id", "rank", "score")


def bm25_phrases(spark, folder) -> DataFrame:
    return _branch(spark, folder, "bm25_phrases").select("qid", "chunk_id", "rank", "score")


def bm25_precise(spark, folder) -> DataFrame:
    return _branch(spark, folder, "bm25_precise").select("qid", "chunk_id", "level", "rank", "score")


#: Indexes built so far, by session and the files they were built from.
INDEXES: dict[tuple, str] = {}


def _built(spark, folder) -> tuple[sinks.Index, lexical.Questions]:
    """An index of all windows in the shared folder, opened again; queries of one session over the same files share it."""
    docs, qs = _inputs(spark, folder)
    key = (spark.sparkContext.applicationId, *sorted(docs.raw.inputFiles()))
    if key not in INDEXES:
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
        parents = docs.unique().select(F.concat(F.col("doc_id").cast("string"), F.lit(":0")).alias("parent_id"), "doc_id", "source", "text")
        sinks.write_index(lambda kept: corpus.document_chunks(kept, docs.settings.chunking), parents, path)
        INDEXES[key] = path
    return sinks.read_index(spark, INDEXES[key]), qs


def batch_retrieval(spark, folder) -> DataFrame:
    """Questions in two files, retrieved by a job that is paused once and fails once between write and commit."""
    index, qs = _built(spark, folder)
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/batch-{uuid.uuid4().hex}"
    questions = qs.rows.select(F.col("qid").cast("long").alias("qid"), "question")
    part = F.pmod(F.xxhash64("qid"), F.lit(2)).cast("int")
    questions.repartitionByRange(2, part).write.parquet(f"{root}/queue")
    known = batch.identity(questions, index, CFG)

    def lost(number: int) -> None:
        if number == 1 and not failed:
            failed.append(number)
            raise batch.Interrupted(f"lost after writing batch {number}")

    failed: list[int] = []
    for limit in (1, None):
        try:
            batch.run(spark, f"{root}/queue", f"{root}/out", index, CFG, known, limit, lost)
        except batch.Interrupted:
            continue
    rows = batch.run(spark, f"{root}/queue", f"{root}/out", index, CFG, known)
    ids = lambda name: F.array_join(F.col("stages")[name].cast("array<string>"), ",").alias(name)
    return rows.select("qid", "question", *[ids(s) for s in batch.STAGES],
                       F.coalesce(F.array_join(F.transform("contexts", lambda c: c["parent_id"]), ","), F.lit("")).alias("contexts"))


def retrieval_cache_checks(spark, folder) -> DataFrame:
    """Document texts stand for questions, labels say which are asked; part of the cache was made by another run.

    The cached record of a document departs by its number: no record, another text, models, settings, code, mode,
    pool size or index.
    """
    docs = tables.load(spark, folder, "documents").select(F.col("doc_id").alias("qid"), F.col("text").alias("question"))
    asked = docs.join(tables.load(spark, folder, "labels").select(F.col("doc_id").alias("qid")), "qid", "left_semi")
    kind = F.pmod("qid", F.lit(20))
    good = {"models": "m1", "retrieval": "r1", "code": "c1", "mode": "lexical", "mode_config": "24", "index": "i1"}
    own = {"models": 2, "retrieval": 3, "code": 4, "mode": 5, "mode_config": 6, "index": 7}
    known = F.create_map(*[x for name, value in good.items() for x in (
        F.lit(name), F.when(kind == own[name], F.lit("other")).otherwise(F.lit(value)))])
    text = F.when(kind == 1, F.concat("question", F.lit("?"))).otherwise(F.col("question"))
    cache = docs.where(kind != 0).select("qid", text.alias("question"), known.alias("identity"))
    return batch.violations(batch.checked(asked, cache, good))


def stored_rankings(spark, folder) -> DataFrame:
    """All three rankings from the stored index: blocks that cannot matter left unread, phrases looked up in the stored chunks."""
    index, qs = _built(spark, folder)
    rows = index.rankings(qs, CFG)
    return rows.select("branch", "qid", "chunk_id", "level", "rank", F.round("score", 6).alias("score"))


#: Word lists that occur in the driver's invented prose stand for those of the lexicon.
RULES = {"scope_markers": ("tion", "heit"), "intent_rule": (("the", "der"), ("and", "und"), "with that for have this")}


def variant_grid(spark, folder) -> DataFrame:
    """Five settings at once; a scope is a syllable, and an added query asks for common English words."""
    index, qs = _built(spark, folder)
    settings = variants.named(variant(CFG, **RULES), pool_64={"lexical_pool_k": 64}, weight_1={"coverage_weight": 1.0},
                              scope={"scope_penalty": 0.75}, intent={"intent_expansion": True})
    rows = variants.grid(index, qs, settings)
    return rows.select("variant", "qid", "chunk_id", "parent_id", "place", F.round("final_score", 6).alias("final_score"))


def rrf_fusion(spark, folder) -> DataFrame:
    docs, qs = _inputs(spark, folder)
    fused = fusion.fuse(lexical.rankings(docs.chunks(), qs, CFG), lexical.BRANCHES, CFG.rrf_constant)
    return fused.select("qid", "chunk_id", "rank", F.round("rrf", 9).alias("rrf"))


def diversified_pool(spark, folder) -> DataFrame:
    docs, qs = _inputs(spark, folder)
    pool = fusion.diversify(plans.fused_candidates(docs.chunks(), docs.chunks_of, qs, CFG),
                            CFG.pool_k, CFG.per_parent)
    return pool.select("qid", "chunk_id", "parent_id", "rank")


def retrieval_boosts(spark, folder) -> DataFrame:
    docs, qs = _inputs(spark, folder)
    rows = plans.lexical_retrieval(docs.chunks(), docs.chunks_of, qs, CFG)
    return rows.select("qid", "chunk_id", F.round("coverage", 9).alias("coverage"),
                       F.round("adjustment", 9).alias("adjustment"))


def lexical_retrieval(spark, folder) -> DataFrame:
    docs, qs = _inputs(spark, folder)
    rows = plans.lexical_retrieval(docs.chunks(), docs.chunks_of, qs, CFG)
    return rows.select("qid", "chunk_id", "parent_id", "place", F.round("final_score", 6).alias("final_score"))


def contexts(spark, folder) -> DataFrame:
    docs, qs = _inputs(spark, folder)
    # Ordered candidates are needed for the parents to read and for the result.
    ordered = settled(plans.lexical_retrieval(docs.chunks(), docs.chunks_of, qs, CFG).drop("text"))
    parents = docs.parents_of(ordered.select("chunk_id"), qs.count * CFG.lexical_pool_k)
    return context.materialize(ordered, parents, qs.count, CFG)


def context_materialize(spark, folder) -> DataFrame:
    return contexts(spark, folder).select(
        "qid", "parent_id", F.col("chunk_id").alias("seed_chunk_id"), "context", "window_start",
        "window_end", "seed_start", "seed_end", F.sha2("text", 256).alias("text_sha"))


def _dense(spark, folder, indexed: DataFrame | None = None) -> DataFrame:
    """The vector with an item's number stands for its question; all (or all indexed) vectors are searched."""
    vectors = tables.load(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    items = tables.load(spark, folder, "benchmark").select(F.col("item_id").alias("id"))
    asked = vectors.join(items, "id").select(F.col("id").alias("qid"), "vector")
    if indexed is not None:
        vectors = vectors.join(indexed.select(F.col("doc_id").alias("id")), "id", "left_semi")
    return dense.nearest(asked, vectors, CFG.dense_k)


def dense_knn(spark, folder) -> DataFrame:
    return _dense(spark, folder).select("qid", F.col("id").alias("vec_id"), "rank",
                                        F.round("score", 6).alias("score"))


def _near(spark, folder) -> DataFrame:
    """The vectors nearest to each item, with their label as document."""
    labels = tables.load(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("doc_id"))
    found = _dense(spark, folder)
    return lookup_join(labels, found.select("qid", "id", "rank"), "id", 1 << 62, spread_by=["id"])


def same_document_contexts(spark, folder) -> DataFrame:
    """The first three contexts of an item that share the best one's document."""
    contexts = _near(spark, folder).withColumn("context", F.col("rank") - 1)
    return evidence.same_document(contexts, 3, True).select("qid", "context", "id", "doc_id")


def spliced_pool(spark, folder) -> DataFrame:
    """Sixteen places: the first of the ranking, a reserve of vectors of even number, then the rest."""
    near = _near(spark, folder).select("qid", F.col("id").alias("chunk_id"), "rank")
    even = near.where("chunk_id % 2 = 0").withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    return fusion.splice(near.where("rank <= 20"), even.where("rank BETWEEN 6 AND 9"), 16)


def hybrid_fusion(spark, folder) -> DataFrame:
    """A vector stands for the first window of the document with its number."""
    docs, qs = _inputs(spark, folder)
    lex = lexical.rankings(docs.chunks(), qs, CFG).select("branch", "qid", "chunk_id", "rank")
    vec = _dense(spark, folder).select(
        F.lit("dense").alias("branch"), "qid", corpus.chunk_key(F.col("id"), F.lit(0)).alias("chunk_id"), "rank")
    fused = fusion.fuse(lex.unionByName(vec), (*lexical.BRANCHES, "dense"), CFG.rrf_constant)
    return fused.select("qid", "chunk_id", "rank", F.round("rrf", 9).alias("rrf"))


def hybrid_retrieval(spark, folder) -> DataFrame:
    """Lexical and dense rankings fused, pooled, boosted and ordered; vectors of kept documents only."""
    docs, qs = _inputs(spark, folder)
    vec = _dense(spark, folder, docs.unique()).select(
        "qid", corpus.chunk_key(F.col("id"), F.lit(0)).alias("chunk_id"), "rank")
    rows = plans.full_retrieval(docs.chunks(), docs.chunks_of, qs, vec, cfg=CFG)
    return rows.select("qid", "chunk_id", "parent_id", "place", F.round("final_score", 6).alias("final_score"))


def answer_token_coverage(spark, folder) -> DataFrame:
    """The item's own text serves as its answer."""
    docs, qs = _inputs(spark, folder)
    ranked = settled(lexical.rankings(docs.chunks(), qs, CFG).select("branch", "qid", "chunk_id", "rank"))
    fused = fusion.fuse(ranked, lexical.BRANCHES, CFG.rrf_constant)
    deepest = 20
    picked = ranked.withColumnRenamed("branch", "stage").unionByName(
        fused.select(F.lit("rrf").alias("stage"), "qid", "chunk_id", "rank")).where(F.col("rank") <= deepest)
    rows = qs.count * deepest * 4
    text = docs.chunks_of(picked.select("chunk_id"), rows)
    picked = lookup_join(text, picked, "chunk_id", rows, spread_by=["chunk_id"])
    gold = qs.rows.select("qid", F.col("question").alias("answer"))
    out = context.token_coverage(gold, picked, qs.count, qs.count)
    return out.withColumn("coverage", F.round("coverage", 9))


QUERIES = {
    "variant_grid": variant_grid, "stored_rankings": stored_rankings, "batch_retrieval": batch_retrieval,
    "retrieval_cache_checks": retrieval_cache_checks, "bm25_topk": bm25_topk, "bm25_phrases": bm25_phrases, "bm25_precise": bm25_precise,
    "rrf_fusion": rrf_fusion, "diversified_pool": diversified_pool,
    "retrieval_boosts": retrieval_boosts, "lexical_retrieval": lexical_retrieval,
    "context_materialize": context_materialize, "dense_knn": dense_knn,
    "same_document_contexts": same_document_contexts, "spliced_pool": spliced_pool,
    "hybrid_fusion": hybrid_fusion, "hybrid_retrieval": hybrid_retrieval,
    "answer_token_coverage": answer_token_coverage,
}
