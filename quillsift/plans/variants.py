"""Several settings of lexical retrieval compared in one plan.

Rankings, fusions and the look at each candidate's text are shared by all variants; a variant is a weighing of the
same observations. Variants may differ in the fusion constant, pool size, cap per parent, bonuses, scope penalty and
intent expansion; ranking depths and word lists are common.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from quillsift.config import Retrieval
from quillsift.operators import boosts, context, fusion, lexical
from quillsift.operators.sizing import hinted, lookup_join
from quillsift.session import settled
from quillsift.sources.sinks import Index

COMMON = ("broad_k", "precise_k", "and_levels", "max_query_tokens", "max_query_phrases", "scope_markers", "intent_rule")


def _common(variants: dict[str, Retrieval]) -> Retrieval:
    first = next(iter(variants.values()))
    for name, cfg in variants.items():
        odd = [c for c in COMMON if getattr(cfg, c) != getattr(first, c)]
        if odd or cfg.adjacent_distance:
            raise ValueError(f"{name} differs in {odd or ['adjacent_distance']}, which needs rankings of its own")
    return first


def grid(index: Index, questions: lexical.Questions, variants: dict[str, Retrieval]) -> DataFrame:
    """``(variant, qid, chunk_id, parent_id, adjustment, final_score, place)`` of every variant."""
    base = _common(variants)
    expands = any(cfg.intent_expansion for cfg in variants.values())
    # An even number stands for a question, the odd one behind it for its added query.
    asked = boosts.expanded_questions(questions.rows, base.intent_rule).where(F.lit(expands) | (F.col("variant") == 0))
    asked = settled(asked.select((F.col("qid") * 2 + F.col("variant")).cast("long").alias("qid"), "question"))
    ranked = index.rankings(lexical.Questions.of(asked), base).select("branch", "qid", "chunk_id", "rank")
    added = F.pmod("qid", F.lit(2)) == 1
    ranked = settled(ranked.select(F.when(added, F.concat(F.lit("intent_"), "branch")).otherwise(F.col("branch")).alias("branch"),
                                   F.floor(F.col("qid") / 2).cast("long").alias("qid"), "chunk_id", "rank"))
    own, more = list(lexical.BRANCHES), [f"intent_{b}" for b in lexical.BRANCHES]
    rows = questions.count * 2 * (base.broad_k + 2 * base.precise_k)
    owners = index.chunks.select("chunk_id", "parent_id")
    fused: dict[tuple, DataFrame] = {}
    pools = []
    for name, cfg in variants.items():
        key = (cfg.intent_expansion, cfg.rrf_constant)
        if key not in fused:
            branches = own + more if cfg.intent_expansion else own
            fused[key] = settled(lookup_join(owners, fusion.fuse(ranked.where(F.col("branch").isin(branches)), branches, cfg.rrf_constant),
                                             "chunk_id", rows, spread_by=["chunk_id"]))
        pool = fusion.diversify(fused[key], cfg.lexical_pool_k, cfg.per_parent)
        pools.append(pool.select(F.lit(name).alias("variant"), "qid", "chunk_id", "parent_id", "rank"))
    pools = settled(reduce(DataFrame.unionByName, pools))
    most = questions.count * sum(cfg.lexical_pool_k for cfg in variants.values())
    seen = pools.select("qid", "chunk_id").distinct()
    body = lookup_join(index.chunks.select("chunk_id", "header", "text"), seen, "chunk_id", most, spread_by=["chunk_id"])
    features = hinted(boosts.question_features(questions.rows), questions.count)
    looked = settled(boosts.observed(body, features, base.scope_markers).drop("header", "text"))
    out = []
    for name, cfg in variants.items():
        own_pool = pools.where(F.col("variant") == name).join(looked, ["qid", "chunk_id"])
        scored = boosts.weighed(own_pool, cfg).withColumn("score", context.rank_prior(F.col("rank")))
        out.append(context.order_final(scored).select("variant", "qid", "chunk_id", "parent_id", "adjustment", "final_score", "place"))
    return reduce(DataFrame.unionByName, out)


def named(base: Retrieval, **changes: dict) -> dict[str, Retrieval]:
    """``base`` itself and one variant per keyword."""
    return {"base": base, **{name: replace(base, **change) for name, change in changes.items()}}
