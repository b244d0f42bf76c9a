"""Explainable rule boosts for candidate chunks, and question expansion by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillsift.config import Retrieval
from quillsift.functions import lexicon as lx, text as tx


def question_features(questions: DataFrame) -> DataFrame:
    """What the rules need to know about a question, computed once per question."""
    q = questions.select("qid", "question", tx.tokens(F.col("question")).alias("q_tokens"))
    folded = tx.fold(F.col("question"))
    return q.select(
        "qid", tx.content_terms(F.col("q_tokens")).alias("q_terms"),
        tx.loaded_ngrams(F.col("q_tokens"), 3).alias("q_phrases"),
        tx.document_numbers(F.col("question")).alias("q_numbers"),
        F.array_distinct(tx.years(F.col("question"))).alias("q_years"),
        tx.contains_any(folded, lx.RECENCY_MARKERS).alias("q_recent"),
        folded.alias("q_folded"))


def foreign_scope(question: Column, candidate: Column, markers: tuple | None = None) -> Column:
    """Does the candidate name a scope that the question does not?"""
    foreign = F.lit(False)
    for marker in lx.SCOPE_MARKERS if markers is None else markers:
        foreign = foreign | (F.contains(candidate, F.lit(marker)) & ~F.contains(question, F.lit(marker)))
    return foreign


def scope_penalty(question: Column, candidate: Column, weight: float, markers: tuple | None = None) -> Column:
    """Minus ``weight`` when the candidate names a scope the question does not."""
    if weight <= 0:
        return F.lit(0.0)
    return F.when(foreign_scope(question, candidate, markers), F.lit(-weight)).otherwise(F.lit(0.0))


def observed(candidates: DataFrame, features: DataFrame, markers: tuple | None = None) -> DataFrame:
    """What the rules see in each candidate ``(qid, header, text, ...)``, whatever they weigh.

    Adds ``coverage``, ``names_number``, ``names_year``, ``names_phrase``, ``asks_newest``, ``year`` and ``foreign``.
    ``features`` has one row per question.
    """
    rows = candidates.join(features, "qid")
    body = tx.fold(F.concat(F.coalesce("header", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))))
    rows = rows.withColumn("_body", body).withColumn("_words", tx.tokens(F.col("_body")))
    matched = F.size(F.filter("q_terms", lambda t: F.array_contains("_words", t)))
    names = lambda array: F.exists(array, lambda x: F.contains("_body", x))
    return rows.select(
        *candidates.columns, (matched / F.greatest(F.size("q_terms"), F.lit(1))).alias("coverage"), names("q_numbers").alias("names_number"),
        names("q_years").alias("names_year"), names("q_phrases").alias("names_phrase"), F.col("q_recent").alias("asks_newest"),
        tx.document_year(F.coalesce("header", F.lit(""))).alias("year"), foreign_scope(F.col("q_folded"), F.col("_body"), markers).alias("foreign"))


SEEN = ("names_number", "names_year", "names_phrase", "asks_newest", "year", "foreign")


def weighed(rows: DataFrame, cfg: Retrieval, newest_over=("qid",)) -> DataFrame:
    """Turn what the rules saw into ``adjustment``.

    The newest header year is taken over the candidates of the question, a group whose size the pool limit bounds.
    """
    def bonus(condition: Column, value: float) -> Column:
        return F.when(condition, F.lit(float(value))).otherwise(F.lit(0.0))

    newest = F.max("year").over(Window.partitionBy(*newest_over))
    total = F.lit(cfg.coverage_weight) * F.col("coverage")
    total = total + bonus(F.col("names_number"), cfg.document_bonus)
    total = total + bonus(F.col("names_year"), cfg.year_bonus)
    total = total + bonus(F.col("names_phrase"), cfg.phrase_bonus)
    total = total + bonus(F.col("asks_newest") & (F.col("year") == newest), cfg.recency_bonus)
    total = total + bonus(F.col("foreign") & F.lit(cfg.scope_penalty > 0), -cfg.scope_penalty)
    return rows.withColumn("adjustment", total).drop(*SEEN)


def adjustments(candidates: DataFrame, features: DataFrame, cfg: Retrieval,
                newest_over=("qid",)) -> DataFrame:
    """Add ``coverage`` and ``adjustment`` to candidates ``(qid, header, text, ...)``."""
    return weighed(observed(candidates, features, cfg.scope_markers), cfg, newest_over)


def expanded_questions(questions: DataFrame, rule: tuple | None = None) -> DataFrame:
    """``(qid, variant, question)``: the question itself and at most one query added by rule."""
    topics, markers, query = rule or (lx.SANCTION_TOPICS, lx.SANCTION_MARKERS, lx.SANCTION_QUERY)
    folded = tx.fold(F.col("question"))
    fires = tx.contains_any(folded, topics) & tx.contains_any(folded, markers)
    extra = F.when(fires, F.array("question", F.lit(query))).otherwise(F.array("question"))
    return questions.select("qid", F.posexplode(extra).alias("variant", "question"))
