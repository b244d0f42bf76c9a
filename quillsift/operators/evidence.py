"""Does the evidence support the question, and what can be quoted from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillsift.functions import answers as an, lexicon as lx, text as tx

PIECE = f"{lx.NOT_WORD}*{lx.WORD}"


def padded(words: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def shared_phrase(left: Column, right: Column, maximum: int, minimum: int) -> Column:
    """Words in the longest run of ``left`` that occurs in ``right`` (a padded word string)."""
    out = F.lit(0)
    for size in range(minimum, maximum + 1):
        found = F.exists(tx.ngrams(left, size), lambda g: F.contains(right, F.concat(F.lit(" "), g, F.lit(" "))))
        out = F.when(found, F.lit(size)).otherwise(out)
    return out


def _window_starts(n: Column, window: int) -> Column:
    """Starts every half window; one more at the end when the last step leaves words uncovered."""
    step = max(32, window // 2)
    regular = F.sequence(F.lit(0), n - 1, F.lit(step))
    tail = n - window
    return F.when(F.element_at(regular, -1) + window < n, F.concat(regular, F.array(tail))).otherwise(regular)


def evidence_windows(contexts: DataFrame, window: int = 160) -> DataFrame:
    """Score every word window of every context: one row per (qid, context, start).

    ``contexts`` is ``(qid, question, context, heading, text)``. A context without words keeps one row
    with a null ``window_start`` and ``score``, so that no question gets lost.
    """
    base = contexts.select(
        "qid", "question", "context", tx.tokens(F.col("question")).alias("qw"),
        tx.tokens(F.coalesce("heading", F.lit(""))).alias("hw"), tx.tokens(F.coalesce("text", F.lit(""))).alias("tw"))
    base = base.withColumn("terms", tx.content_terms(F.col("qw")))
    starts = F.when(F.size("tw") > 0, _window_starts(F.greatest(F.size("tw"), F.lit(1)), window))
    rows = base.select("*", F.explode_outer(starts).alias("window_start"))
    scored = F.col("window_start").isNotNull()
    words = F.when(scored, F.concat("hw", F.slice("tw", F.col("window_start") + 1, F.lit(window))))
    end = F.when(scored, F.least(F.size("tw"), F.col("window_start") + window))
    rows = rows.select("qid", "question", "context", "qw", "terms", "window_start", end.alias("window_end"),
                       F.coalesce(words, F.array().cast("array<string>")).alias("words"))
    rows = rows.withColumn("joined", padded(F.col("words")))
    matched = F.size(F.filter("terms", lambda t: F.array_contains("words", t)))
    rows = rows.withColumn("matched_terms", matched).withColumn("question_terms", F.size("terms"))
    rows = rows.withColumn("coverage", F.col("matched_terms") / F.greatest(F.col("question_terms"), F.lit(1)))
    rows = rows.withColumn("longest_phrase", shared_phrase(F.col("qw"), F.col("joined"), 8, 2))
    anchor = F.concat(F.lit(" "), F.array_join(F.slice("terms", 1, 2), " "), F.lit(" "))
    rows = rows.withColumn("anchor_match", (F.size("terms") >= 2) & F.contains("joined", anchor))
    score = F.col("coverage") + F.col("longest_phrase") * 0.02 + F.lit(0.10) / (F.col("context") + 1)
    return rows.withColumn("score", F.when(F.col("window_start").isNotNull(), F.round(score, 9)))


def local_support(contexts: DataFrame, threshold: float = 0.78, window: int = 160) -> DataFrame:
    """Best evidence window per question and whether it is strong.

    Questions whose contexts hold no words get a row with a null ``context`` as well.
    """
    rows = evidence_windows(contexts, window)
    order = Window.partitionBy("qid").orderBy(F.desc_nulls_last("score"), "context", "window_start")
    best = rows.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    folded, joined = tx.fold(F.col("question")), F.array_join("words", " ")
    markers = F.lit(True)
    for m in lx.EVIDENCE_MARKERS:
        markers = markers & (~F.contains(folded, F.lit(m)) | F.contains(joined, F.lit(m)))
    wants_age = F.array_contains("qw", "tuổi") & F.contains(folded, F.lit("bao nhiêu"))
    ages = F.transform(F.regexp_extract_all(joined, F.lit(f"(?U)(?<!\\d)(\\d{{1,3}})(?={an.S}*tuổi)"), F.lit(1)),
                       lambda a: a.cast("int"))
    age_ok = ~wants_age | F.exists(ages, lambda a: (a > 0) & (a <= 120))
    actor = F.col("question").rlike("(?iuU)" + lx.DIRECT_ACTOR) & (F.col("coverage") >= 0.80)
    found = F.col("score").isNotNull()
    best = best.withColumn("marker_ok", F.when(found, markers)).withColumn("age_value_present", F.when(found, age_ok))
    strong = (found & (F.col("question_terms") >= 3) & (F.col("coverage") >= threshold)
              & (F.col("longest_phrase") >= 3) & (F.col("anchor_match") | actor)
              & F.col("marker_ok") & F.col("age_value_present"))
    return best.select(
        "qid", F.when(found, F.col("context")).alias("context"),
        F.coalesce("window_start", F.lit(0)).alias("window_start"), F.coalesce("window_end", F.lit(0)).alias("window_end"),
        "coverage", "matched_terms", "question_terms", "longest_phrase", "anchor_match", "marker_ok",
        "age_value_present", strong.alias("strong"), "score")


def refusal_support(contexts: DataFrame, threshold: float = 0.65) -> DataFrame:
    """Support with the stricter threshold used before a refusal is overruled."""
    return local_support(contexts, max(0.78, threshold))


def citation_conflict(answers: DataFrame, contexts: DataFrame, minimum: int = 8) -> DataFrame:
    """Does an answer cite one document but copy its words from another?

    ``answers`` is ``(qid, question, answer)``, ``contexts`` is ``(qid, context, number, heading,
    text)``. The first conflicting context is reported.
    """
    asked = answers.select(
        "qid", F.col("question").rlike("(?iuU)" + lx.DIRECT_ACTOR).alias("direct"),
        tx.document_numbers(F.col("answer")).alias("cited"), tx.tokens(F.col("answer")).alias("aw"))
    named = tx.document_numbers(F.concat(
        F.coalesce("number", F.lit("")), F.lit(" "), F.coalesce("heading", F.lit("")), F.lit(" "),
        F.coalesce("text", F.lit(""))))
    rows = (asked.where(F.col("direct") & (F.size("cited") > 0))
            .join(contexts.select("qid", "context", named.alias("named"),
                                  tx.tokens(F.coalesce("text", F.lit(""))).alias("tw")), "qid")
            .withColumn("is_cited", F.arrays_overlap("cited", "named"))
            .withColumn("copied", shared_phrase(F.col("aw"), padded(F.col("tw")), 12, minimum)))
    # Only a bounded number of contexts belong to a question, and only their numbers travel.
    of_question = Window.partitionBy("qid")
    joined = F.array_sort(F.collect_list(F.when(F.col("is_cited"), F.struct("context", "tw"))).over(of_question))
    rows = rows.withColumn("supported", shared_phrase(
        F.col("aw"), padded(F.flatten(F.transform(joined, lambda s: s["tw"]))), 12, minimum))
    rows = rows.withColumn("any_cited", F.max("is_cited").over(of_question))
    bad = rows.where(F.col("any_cited") & ~F.col("is_cited") & (F.col("copied") >= minimum)
                     & (F.col("copied") > F.col("supported")))
    first = bad.groupBy("qid").agg(F.min_by("copied", "context").alias("copied_phrase_words"),
                                   F.min("context").alias("conflicting_context_index"))
    return (answers.select("qid").join(first, "qid", "left").select(
        "qid", F.col("conflicting_context_index").isNotNull().alias("conflict"), "conflicting_context_index",
        F.coalesce("copied_phrase_words", F.lit(0)).alias("copied_phrase_words")))


def extract(text: Column, start: Column, words: int) -> Column:
    """``words`` words of a text from word ``start`` on, with what stands between them."""
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    body = F.array_join(F.slice(pieces, start + 1, F.lit(words)), "")
    return F.regexp_replace(body, f"^{lx.NOT_WORD}+", "")


def extractive_fallback(contexts: DataFrame, support: DataFrame, max_words: int = 420) -> DataFrame:
    """A verbatim excerpt around the winning window, headed by number and heading.

    ``(qid, answer)`` for every question in ``support``; a fixed sentence when nothing can be quoted.
    """
    best = support.select("qid", "context", "window_start").join(
        contexts.select("qid", "context", "number", "heading", "text"), ["qid", "context"], "left")
    n = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(lx.WORD), F.lit(0)))
    rows = best.withColumn("n", n)
    end = F.least(F.col("n"), F.greatest(F.lit(0), F.col("window_start") - max_words // 4) + max_words)
    start = F.greatest(F.lit(0), end - max_words)
    rows = rows.withColumn("excerpt", F.when(F.col("n") <= max_words, F.col("text")).otherwise(
        extract(F.col("text"), start, max_words)))
    prefix = F.concat_ws(" ", F.nullif("number", F.lit("")), F.nullif("heading", F.lit("")))
    headed = F.when((F.length(prefix) > 0) & ~F.contains("excerpt", prefix),
                    F.concat(prefix, F.lit("\n"), F.col("excerpt"))).otherwise(F.col("excerpt"))
    return rows.select("qid", F.when(F.col("n") >= 24, an.clean_answer(headed)).otherwise(
        F.lit(lx.NO_EVIDENCE)).alias("answer"))


def focused_contexts(contexts: DataFrame, support: DataFrame) -> DataFrame:
    """The best supported context and the first other one of the same document, in their order."""
    best = support.select("qid", F.coalesce("context", F.lit(0)).alias("best"),
                          F.col("context").isNotNull().alias("found"))
    rows = contexts.join(best, "qid")
    w = Window.partitionBy("qid")
    home = F.max(F.when(F.col("context") == F.col("best"), F.nullif("doc_id", F.lit("")))).over(w)
    rows = rows.withColumn("home", home)
    mate = F.when(F.col("found") & (F.col("context") != F.col("best")) & (F.col("doc_id") == F.col("home")),
                  F.col("context"))
    rows = rows.withColumn("mate", F.min(mate).over(w))
    return rows.where((F.col("context") == F.col("best")) | (F.col("context") == F.col("mate"))).drop(
        "best", "found", "home", "mate")


def same_document(contexts: DataFrame, limit: int, only_top_document: bool = False) -> DataFrame:
    """First ``limit`` contexts in order, if asked only those of the first one's document."""
    rows = contexts
    order = Window.partitionBy("qid").orderBy("context")
    if only_top_document:
        top = F.first("doc_id").over(order)
        rows = rows.withColumn("_top", top).where(
            F.coalesce(F.col("_top"), F.lit("")).isin("") | (F.col("doc_id") == F.col("_top"))).drop("_top")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")
