"""Registered queries on repair, scores, comparisons, decisions and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillsift.functions import answers as an, text as tx
from quillsift.operators import evaluate as ev, repair, splits
from quillsift.sources import tables


def _audited(spark, folder) -> DataFrame:
    """All documents as answers; their labels stand for the audit of a run, route ``unaudited`` for those without."""
    docs = tables.documents(spark, folder, "doc_id", "text")
    labels = tables.load(spark, folder, "labels")
    route = F.when(F.col("quality").isNull(), "unaudited").when(F.col("quality") == 1, "generated").otherwise("source_fallback")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("answer"), route.alias("route"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("hit_token_limit"), "quality", "toxic")


def repair_report(spark, folder) -> DataFrame:
    rows = repair.repair(_audited(spark, folder))
    return rows.select("id", F.array_join("reasons", "|").alias("reasons"), F.array_join("remaining", "|").alias("remaining"),
                       "action", (F.col("after") != F.col("answer")).alias("changed"))


def review_queue(spark, folder) -> DataFrame:
    return repair.review_queue(_audited(spark, folder)).select(
        "id", "group", F.array_join("reasons", "|").alias("reasons"), "priority")


def rouge_l(spark, folder) -> DataFrame:
    pairs = tables.qa_pairs(spark, folder).select("id", "answer", F.col("question").alias("reference"))
    rows = ev.score_answers(pairs)
    return rows.select("id", F.round("rougeL", 9).alias("rougeL"), F.round("meteor_exact", 9).alias("meteor_exact"),
                       "prediction_words", "reference_words")


def metric_summary(spark, folder) -> DataFrame:
    words = tables.documents(spark, folder, "lang", "text").select("lang", tx.word_count(F.col("text")).alias("w"))
    out = ev.length_summary(words, ["lang"], "w")
    return out.select("lang", "n", F.round("mean", 6).alias("mean"), F.round("p90", 6).alias("p90"),
                      "max", "median_low", "p90_low")


def _scores(spark, folder, metric: str, value) -> DataFrame:
    return tables.load(spark, folder, "labels").select(F.col("doc_id").alias("id"), value.cast("double").alias(metric))


def paired_comparison(spark, folder) -> DataFrame:
    """Control and candidate scores are the two labels of a document."""
    control = _scores(spark, folder, "m", F.col("quality"))
    candidate = _scores(spark, folder, "m", 1 - F.col("toxic"))
    out = ev.resampled_interval(ev.paired(control, candidate, "m"))
    return out.select("samples", "wins", "losses", *[F.round(c, 6).alias(c) for c in ("mean_delta", "low", "high")])


def route_counts(spark, folder) -> DataFrame:
    """Answers per route of the audit, with the share that hit the token limit."""
    return ev.route_counts(_audited(spark, folder)).withColumn("token_limit_rate", F.round("token_limit_rate", 9))


def acceptance_decision(spark, folder) -> DataFrame:
    """Cleaned documents against the originals, deltas from the labels."""
    rows = _audited(spark, folder)
    cleaned = rows.select("id", an.clean_answer(F.col("answer")).alias("answer"))
    facts = ev.change_facts(rows, cleaned)
    deltas = rows.agg(F.avg(1 - F.col("toxic") - F.col("quality")).alias("m"),
                      F.avg(F.col("toxic") - F.col("quality")).alias("r"))
    facts = facts.select("*", deltas.select("m").scalar().alias("delta_meteor"), deltas.select("r").scalar().alias("delta_rouge"))
    out = ev.decisions(facts)
    return out.withColumn("delta_meteor", F.round("delta_meteor", 9)).withColumn("delta_rouge", F.round("delta_rouge", 9))


def select_best(spark, folder) -> DataFrame:
    """One report per document source; the labels stand for its two metrics."""
    docs = tables.documents(spark, folder, "doc_id", "source").join(tables.load(spark, folder, "labels"), "doc_id")
    reports = docs.groupBy(F.col("source").alias("label")).agg(
        F.round(F.avg("quality"), 9).alias("meteor"), F.round(F.avg("toxic"), 9).alias("rougeL"),
        F.min("doc_id").alias("position"), F.lit("labels").alias("reference_hash"), F.lit("labels").alias("metric_identity"),
        F.lit("labelled").alias("ids_hash"))
    return ev.select_best(reports).select("label", "meteor", "rougeL")


def split_groups(spark, folder) -> DataFrame:
    return splits.duplicate_groups(tables.qa_pairs(spark, folder))


def hash_order_split(spark, folder) -> DataFrame:
    return splits.hash_split(splits.duplicate_groups(tables.qa_pairs(spark, folder)))


def training_subset(spark, folder) -> DataFrame:
    """The first 100 QA pairs in hash order (the size is what the operator is asked for)."""
    return splits.hashed_subset(tables.qa_pairs(spark, folder), 100).select("id", "pos")


def damage_counts(spark, folder) -> DataFrame:
    """Per source of the documents."""
    docs = tables.documents(spark, folder, "source", "text").withColumnRenamed("text", "answer")
    return ev.damage_counts(docs, ("source",))


def _outcomes(spark, folder) -> DataFrame:
    """Events as outcomes of repaired items: the value decides, the type is the group."""
    value = F.col("value")
    reasons = F.filter(F.array(F.when(value < 20, "loop"), F.when(F.col("user_id") % 2 == 0, "no_natural_stop"), F.when(value >= 60, "hit_token_limit")),
                       lambda r: r.isNotNull())
    return tables.load(spark, folder, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("group"), (F.size(reasons) == 0).alias("accepted"), (value >= 30).alias("changed"),
        (1 + F.col("event_id") % 4).alias("attempts"), F.floor(value).alias("output_tokens"), value.cast("decimal(20,6)").alias("seconds"), reasons.alias("rejected"))


def outcome_sums(spark, folder) -> DataFrame:
    return ev.outcome_sums(_outcomes(spark, folder)).withColumn("seconds", F.col("seconds").cast("double"))


def rejection_counts(spark, folder) -> DataFrame:
    return ev.rejection_counts(_outcomes(spark, folder))


def score_drift(spark, folder) -> DataFrame:
    """Fresh scores lack some documents and are off by a little for others."""
    stored = tables.load(spark, folder, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("meteor"),
                                                         F.col("toxic").cast("double").alias("rougeL"))
    fresh = stored.where("id % 77 <> 0").withColumn("meteor", F.col("meteor") + F.when(F.col("id") % 10 == 0, 1e-9).otherwise(1e-12))
    return ev.drifted(stored, fresh, ["meteor", "rougeL"])


def group_overlay(spark, folder) -> DataFrame:
    """Cleaned documents replace the originals where the label's group is enabled."""
    docs = tables.documents(spark, folder, "doc_id", "text").select(F.col("doc_id").alias("id"), F.col("text").alias("answer"))
    cleaned = docs.select("id", an.clean_answer(F.col("answer")).alias("answer"))
    queue = tables.load(spark, folder, "labels").select(
        F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "fallback").otherwise("truncated").alias("group"))
    return repair.overlay(docs, cleaned, queue, ["fallback"]).select("id", F.sha2("answer", 256).alias("answer_sha"))


def penalty_choice(spark, folder) -> DataFrame:
    """Documents dealt over four penalties by their number, labels as measurements."""
    loops = F.when((F.col("doc_id") % 4 == 0) | (F.col("toxic") == 1), F.array(F.lit("loop"))).otherwise(F.array().cast("array<string>"))
    heading = F.when((F.col("quality") == 0) & (F.col("doc_id") % 4 == 0), F.array(F.lit("heading_only"))).otherwise(F.array().cast("array<string>"))
    details = tables.load(spark, folder, "labels").select(
        (1 + F.col("doc_id") % 4 * 0.05).cast("double").alias("repetition_penalty"), (F.col("quality") + F.col("doc_id") % 4).cast("double").alias("meteor"),
        (1 - F.col("toxic") + F.col("doc_id") % 4).cast("double").alias("rougeL"), loops.alias("raw_reasons"), heading.alias("final_reasons"),
        (F.col("quality") / (1 + F.col("doc_id") % 4)).cast("double").alias("raw_repetition"), F.lit(0.0).alias("final_repetition"))
    summary = ev.penalty_summary(details)
    chosen = ev.choose_penalty(summary)
    return summary.select(F.round("repetition_penalty", 6).alias("repetition_penalty"), "samples", "raw_loop_count", "final_heading_only_count",
                          F.round("meteor", 6).alias("meteor"), F.round(chosen.select("recommended_penalty").scalar(), 6).alias("recommended_penalty"),
                          chosen.select("improvement_found").scalar().alias("improvement_found"))


QUERIES = {f.__name__: f for f in (
    repair_report, review_queue, rouge_l, metric_summary, paired_comparison, route_counts,
    acceptance_decision, select_best, split_groups, hash_order_split, training_subset,
    damage_counts, outcome_sums, rejection_counts, score_drift, group_overlay, penalty_choice)}
