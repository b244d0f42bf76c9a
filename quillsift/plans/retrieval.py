"""Retrieval jobs: all questions of a batch at once."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window, functions as F

from quillsift.config import Retrieval, Settings
from quillsift.functions import text as tx
from quillsift.operators import boosts, context, corpus, fusion, lexical
from quillsift.operators.sizing import hinted, lookup_join
from quillsift.session import settled


class Corpus:
    """Documents ``(doc_id BIGINT, text, source)`` seen as parents with windows.

    ``unique`` removes empty and repeated texts and is what rankings run on. ``chunks_of`` and
    ``parents_of`` fetch text for a bounded set of ids and skip that step: ranked ids come from
    documents that survived it.
    """

    def __init__(self, docs: DataFrame, settings: Settings | None = None):
        self.settings = settings or Settings()
        self.raw = docs

    @staticmethod
    def _cleaned(docs: DataFrame) -> DataFrame:
        return docs.withColumn("text", tx.clean_document(F.col("text")))

    @property
    def docs(self) -> DataFrame:
        return self._cleaned(self.raw)

    def unique(self) -> DataFrame:
        return corpus.first_passages(self.docs)

    def chunks(self) -> DataFrame:
        return corpus.document_chunks(self.unique(), self.settings.chunking)

    def _named(self, ids: DataFrame, rows: int) -> DataFrame:
        """Documents owning the given chunks; others are dropped before their text is touched."""
        owners = ids.select(F.shiftright("chunk_id", corpus.WINDOW_BITS).alias("doc_id")).distinct()
        return self._cleaned(lookup_join(self.raw, owners, "doc_id", rows, "left_semi", spread_by=["doc_id"]))

    def chunks_of(self, ids: DataFrame, rows: int) -> DataFrame:
        """Chunks of the documents behind ``ids`` (at most ``rows`` chunk ids)."""
        return corpus.document_chunks(self._named(ids, rows), self.settings.chunking)

    def parents_of(self, ids: DataFrame, rows: int) -> DataFrame:
        """Parents of the chunks in ``ids`` (at most ``rows``)."""
        return self._named(ids, rows).select(
            F.concat(F.col("doc_id").cast("string"), F.lit(":0")).alias("parent_id"),
            "doc_id", F.lit("").alias("number"), F.lit("").alias("heading"), "text")


def fused_candidates(chunks: DataFrame, fetch, questions: lexical.Questions, cfg: Retrieval,
                     dense: DataFrame | None = None) -> DataFrame:
    """Fusion of the lexical rankings (and a dense one) with parent, header and text attached.

    ``fetch(ids, rows)`` returns chunk rows for the given ids. Dense rows are
    ``(qid, chunk_id, rank)``.
    """
    ranked = lexical.rankings(chunks, questions, cfg).select("branch", "qid", "chunk_id", "rank")
    branches = list(lexical.BRANCHES)
    if cfg.intent_expansion:
        ranked, branches = _with_expansions(ranked, chunks, questions, cfg)
    per_question = (cfg.broad_k + 2 * cfg.precise_k) * (2 if cfg.intent_expansion else 1)
    if dense is not None:
        ranked = ranked.unionByName(dense.select(F.lit("dense").alias("branch"), "qid", "chunk_id", "rank"))
        branches, per_question = [*branches, "dense"], per_question + cfg.dense_k
    # The only wide part ends here with a few hundred rows per question, used twice below.
    fused = settled(fusion.fuse(ranked, branches, cfg.rrf_constant))
    rows = questions.count * per_question
    return lookup_join(fetch(fused.select("chunk_id"), rows), fused, "chunk_id", rows,
                       spread_by=["chunk_id"])


def _with_expansions(ranked, chunks, questions, cfg):
    """Add the rankings of the rule-made query of each question that has one."""
    extra = boosts.expanded_questions(questions.rows, cfg.intent_rule).where("variant > 0").select("qid", "question")
    more = lexical.rankings(chunks, lexical.Questions.of(extra), cfg)
    renamed = more.select(F.concat(F.lit("intent_"), "branch").alias("branch"), "qid", "chunk_id", "rank")
    return ranked.unionByName(renamed), [*lexical.BRANCHES, *(f"intent_{b}" for b in lexical.BRANCHES)]


def adjacent_reserve(pool: DataFrame, parents: DataFrame, chunks: DataFrame, features: DataFrame,
                     questions: int, cfg: Retrieval) -> DataFrame:
    """Chunks of the neighbouring parents of the top seeds, best adjustment first.

    ``parents`` is ``(parent_id, doc_id, position)``; ``chunks`` needs ``parent_id, chunk_id, header,
    text``. Returns ``(qid, chunk_id, rank)`` with at most ``reserve`` rows per question.
    """
    seeds = pool.where(F.col("rank") <= cfg.adjacent_seeds).select("qid", "parent_id").distinct()
    bound = questions * cfg.adjacent_seeds
    placed = lookup_join(parents, seeds, "parent_id", bound, spread_by=["parent_id"])
    near = corpus.neighbours(parents.select("parent_id", "doc_id", "position"),
                             placed.select("doc_id", "position", "qid"), cfg.adjacent_distance)
    wanted = near.select("qid", "parent_id").distinct()
    found = lookup_join(chunks, wanted, "parent_id", bound * 2 * cfg.adjacent_distance,
                        spread_by=["chunk_id"])
    scored = boosts.adjustments(found.select("qid", "parent_id", "chunk_id", "header", "text"),
                                hinted(features, questions), cfg)
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("adjustment", 9)), "chunk_id")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    kept = fusion.diversify(ranked, cfg.reserve, cfg.per_parent) if cfg.reserve else ranked.where("false")
    return kept.select("qid", "chunk_id", "rank")


def lexical_retrieval(chunks: DataFrame, fetch, questions: lexical.Questions,
                      cfg: Retrieval | None = None) -> DataFrame:
    """Lexical-only retrieval: fused, diversified and boosted candidates in final order."""
    cfg = cfg or Retrieval()
    pool = fusion.diversify(fused_candidates(chunks, fetch, questions, cfg), cfg.lexical_pool_k, cfg.per_parent)
    features = hinted(boosts.question_features(questions.rows), questions.count)
    scored = boosts.adjustments(pool, features, cfg).withColumn("score", context.rank_prior(F.col("rank")))
    return context.order_final(scored)


def full_retrieval(chunks: DataFrame, fetch, questions: lexical.Questions, dense: DataFrame,
                   scorer=None, cfg: Retrieval | None = None, parents: DataFrame | None = None) -> DataFrame:
    """Lexical and dense rankings fused, optional adjacent reserve, scored and put in final order.

    ``scorer(candidates)`` adds the column ``score``; without one the place in the pool decides.
    """
    cfg = cfg or Retrieval()
    candidates = fused_candidates(chunks, fetch, questions, cfg, dense)
    pool = fusion.diversify(candidates, cfg.pool_k, cfg.per_parent)
    features = hinted(boosts.question_features(questions.rows), questions.count)
    if cfg.adjacent_distance > 0 and parents is not None:
        extra = adjacent_reserve(pool, parents, chunks, features, questions.count, cfg)
        places = fusion.splice(pool, extra, cfg.pool_k)
        rows = questions.count * cfg.pool_k
        body = chunks.select("chunk_id", "parent_id", "doc_id", "start", "end", "header", "text")
        pool = lookup_join(body, places, "chunk_id", rows, spread_by=["chunk_id"])
    scored = boosts.adjustments(pool, features, cfg)
    scored = scorer(scored) if scorer else scored.withColumn("score", context.rank_prior(F.col("rank")))
    return context.order_final(scored)


def variant(cfg: Retrieval, **changes) -> Retrieval:
    return replace(cfg, **changes)
