"""Registered queries on answer checks, clean-up, loops and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quillsift.config import RepairPolicy
from quillsift.functions import answers as an, loops, text as tx
from quillsift.operators import evidence as ev
from quillsift.operators.sizing import spread
from quillsift.sources import tables


def _docs(spark, folder) -> DataFrame:
    """Document texts stand for generated answers."""
    return tables.documents(spark, folder, "doc_id", "text")


def clean_answer(spark, folder) -> DataFrame:
    rows = _docs(spark, folder).select("doc_id", an.clean_answer(F.col("text")).alias("t"))
    return rows.select("doc_id", F.length("t").cast("bigint").alias("n_chars"), F.sha2("t", 256).alias("text_sha"))


def answer_flags(spark, folder) -> DataFrame:
    """Pages are included: raw HTML is where markup left in an answer shows."""
    pages = tables.load(spark, folder, "pages").select(
        F.concat(F.lit("page "), F.col("page_id")).alias("id"), F.col("html").alias("text"))
    docs = _docs(spark, folder).select(F.concat(F.lit("doc "), F.col("doc_id")).alias("id"), "text")
    rows = docs.unionByName(pages).select("id", an.answer_flags(F.col("text"), F.lit("")).alias("f"))
    return rows.select("id", "f.empty", "f.refusal", "f.artifact",
                       F.array_join("f.unsupported_document_numbers", " ").alias("unsupported"))


def unfinished_lead_in(spark, folder) -> DataFrame:
    return _docs(spark, folder).select("doc_id", an.is_unfinished(F.col("text")).alias("unfinished"))


def repetition_ratio(spark, folder) -> DataFrame:
    return _docs(spark, folder).select("doc_id", F.round(an.repetition_ratio(F.col("text")), 9).alias("ratio"))


def completed_prefix(spark, folder) -> DataFrame:
    rows = _docs(spark, folder).select("doc_id", an.completed_prefix(F.col("text")).alias("t"))
    return rows.select("doc_id", F.length("t").cast("bigint").alias("n_chars"), F.sha2("t", 256).alias("text_sha"))


def line_loops(spark, folder) -> DataFrame:
    """Lines of three words or more standing at least twice in a row."""
    policy = RepairPolicy()
    rows = _docs(spark, folder).select("doc_id", loops.plain_lines(F.col("text")).alias("lines"))
    found = F.filter(loops.runs(F.col("lines")), lambda r: r["length"] >= 2)
    removable = F.size(loops.line_loops(F.col("lines"), policy))
    return (rows.select("doc_id", F.coalesce(removable, F.lit(0)).alias("removable"), F.explode(found).alias("r"))
            .select("doc_id", "removable", F.col("r.start").alias("first_line"), F.col("r.length").alias("copies"),
                    F.sha2("r.value", 256).alias("line_sha")))


def numbered_loops(spark, folder) -> DataFrame:
    """Runs of list items with equal content, of any length, and how many would be removed."""
    rows = _docs(spark, folder).select("doc_id", loops.numbered_keys(F.col("text")).alias("keys"))
    return rows.select(
        "doc_id", F.size(F.filter("keys", lambda k: k.isNotNull())).cast("bigint").alias("n_items"),
        F.coalesce(F.size(loops.numbered_loops(F.col("keys"))), F.lit(0)).cast("bigint").alias("n_loops"))


def dedup_answers(spark, folder) -> DataFrame:
    """Repeated blocks removed under the extended policy; only changed documents are listed."""
    rows = loops.with_loops_removed(_docs(spark, folder), "text", loops.EXTENDED)
    return rows.where(F.size("changes") > 0).select(
        "doc_id", F.size("changes").alias("n_cuts"), F.length("text").alias("chars_before"),
        F.length("proposed").alias("chars_after"), F.sha2("proposed", 256).alias("text_sha"))


def loop_reasons(spark, folder) -> DataFrame:
    docs = _docs(spark, folder).withColumn("text", tx.nfc(F.col("text")))
    rows = loops.with_loops_removed(docs, "text", loops.EXTENDED)
    return rows.select("doc_id", F.array_join(
        loops.measurement_reasons(F.col("text"), F.col("changes")), "|").alias("reasons"))


def _contexts(spark, folder) -> DataFrame:
    """All replies up to the next user turn as evidence for a user turn; a turn without any keeps one empty row."""
    turns = spread(tables.load(spark, folder, "conversations"))
    asked = turns.where(F.col("role") == "user").select("conv_id", F.col("turn").alias("asked"), F.col("text").alias("question"))
    replies = tables.with_question_turn(turns).where((F.col("role") == "assistant") & F.col("asked").isNotNull())
    place = Window.partitionBy("conv_id", "asked").orderBy("turn")
    replies = replies.select("conv_id", "asked", (F.row_number().over(place) - 1).alias("context"), "text")
    rows = asked.join(replies, ["conv_id", "asked"], "left")
    return rows.select(F.concat_ws(":", "conv_id", "asked").alias("qid"), "question", F.coalesce("context", F.lit(0)).alias("context"),
                       F.lit("").alias("number"), F.lit("").alias("heading"),
                       F.concat(F.col("conv_id").cast("string"), F.lit("")).alias("doc_id"), "text")


def local_evidence_support(spark, folder) -> DataFrame:
    rows = ev.local_support(_contexts(spark, folder))
    return rows.select("qid", "context", "window_start", "window_end", "matched_terms", "question_terms",
                       "longest_phrase", "anchor_match", "strong", F.round("coverage", 9).alias("coverage"))


def shared_phrase(spark, folder) -> DataFrame:
    """Longest run of question words found again in the answer."""
    rows = tables.qa_pairs(spark, folder).select(
        "id", tx.tokens(F.col("question")).alias("q"), ev.padded(tx.tokens(F.col("answer"))).alias("a"))
    return rows.select("id", ev.shared_phrase(F.col("q"), F.col("a"), 8, 2).alias("words"))


def citation_conflict(spark, folder) -> DataFrame:
    pairs = tables.qa_pairs(spark, folder).withColumnRenamed("id", "qid")
    return ev.citation_conflict(pairs, _contexts(spark, folder)).select(
        "qid", "conflict", "conflicting_context_index", "copied_phrase_words")


def extractive_fallback(spark, folder) -> DataFrame:
    contexts = _contexts(spark, folder)
    rows = ev.extractive_fallback(contexts, ev.local_support(contexts))
    return rows.select("qid", F.length("answer").cast("bigint").alias("n_chars"), F.sha2("answer", 256).alias("answer_sha"))


def focused_contexts(spark, folder) -> DataFrame:
    contexts = _contexts(spark, folder)
    return ev.focused_contexts(contexts, ev.local_support(contexts)).select("qid", "context")


def route_decision(spark, folder) -> DataFrame:
    """Replies that do not end a sentence stand for those that hit the token limit; evidence are all replies to the turn."""
    pairs = tables.qa_pairs(spark, folder).withColumnRenamed("id", "qid")
    contexts = _contexts(spark, folder)
    support = ev.refusal_support(contexts).select("qid", "strong")
    conflict = ev.citation_conflict(pairs, contexts).select("qid", "conflict")
    shown = contexts.groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("evidence"))
    rows = pairs.join(support, "qid").join(conflict, "qid").join(shown, "qid").select(
        "qid", "strong", "conflict", an.answer_flags(F.col("answer"), F.col("evidence")).alias("flags"),
        (~F.col("answer").rlike("[.!?]$")).alias("hit"),
        (F.length(an.completed_prefix(F.col("answer"))) > 0).alias("completable"))
    return rows.select("qid", an.route(F.col("conflict"), F.col("hit"), F.col("flags"), F.col("strong"),
                                       F.col("completable")).alias("route"))


QUERIES = {f.__name__: f for f in (
    clean_answer, answer_flags, unfinished_lead_in, repetition_ratio, completed_prefix, line_loops,
    numbered_loops, dedup_answers, loop_reasons, local_evidence_support, shared_phrase,
    citation_conflict, extractive_fallback, focused_contexts, route_decision)}
