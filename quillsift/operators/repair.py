"""Repair of generated answers: exact loops removed, everything doubtful queued for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillsift.config import RepairPolicy
from quillsift.functions import answers as an, loops, text as tx


def _reasons(*pairs) -> Column:
    found = F.array(*[F.when(condition, F.lit(name)) for condition, name in pairs])
    return F.filter(found, lambda r: r.isNotNull())


def repair(answers: DataFrame, policy: RepairPolicy = RepairPolicy()) -> DataFrame:
    """Repair ``(id, answer, route, hit_token_limit, ...)``; one output row per input row.

    Adds ``proposed``, ``after``, ``changes``, ``blocked`` (why a proposal was refused),
    ``reasons`` (why the answer was looked at), ``remaining`` (what is still open) and ``action``.
    References never take part.
    """
    rows = loops.with_loops_removed(answers, "answer", policy)
    changed = F.size("changes") > 0
    rows = rows.withColumn("blocked", _reasons(
        (changed & an.is_unfinished(F.col("proposed")), "dedup_leaves_unfinished_answer"),
        (changed & (F.length("proposed") < 0.2 * F.length("answer"))
         & (tx.word_count(F.col("proposed")) < 40), "dedup_leaves_too_little_content")))
    rows = rows.withColumn("after", F.when(F.size("blocked") > 0, F.col("answer")).otherwise(F.col("proposed")))
    rows = (rows.withColumn("ratio_before", an.repetition_ratio(F.col("answer")))
            .withColumn("ratio_after", an.repetition_ratio(F.col("after")))
            .withColumn("open_before", an.is_unfinished(F.col("answer")))
            .withColumn("open_after", an.is_unfinished(F.col("after"))))
    fallback = F.contains("route", F.lit("fallback"))
    numbered = F.exists("changes", lambda c: c["unit"] == "numbered_loop")
    exact = F.exists("changes", lambda c: c["unit"] != "numbered_loop")
    rows = rows.withColumn("reasons", _reasons(
        (F.col("ratio_before") >= 0.25, "repetition_screen"), (exact, "exact_adjacent_loop"),
        (numbered, "numbered_loop"), (F.col("hit_token_limit"), "token_limit_review"),
        (fallback, "fallback_review"), (F.col("open_before"), "unfinished_lead_in")))
    remaining = F.concat("blocked", _reasons(
        (F.col("ratio_after") >= 0.25, "repetition_remaining"),
        (F.col("hit_token_limit"), "check_answer_completeness"),
        (fallback, "check_context_relevance"), (F.col("open_after"), "unfinished_lead_in")))
    rows = rows.withColumn("remaining", F.array_sort(F.array_distinct(remaining)))
    action = (F.when(fallback, "review_context_first")
              .when((F.size("blocked") > 0) | F.col("open_after"), "review_for_selective_regeneration")
              .otherwise("review_completeness_or_repetition"))
    return rows.withColumn("action", F.when(F.size("remaining") > 0, action))


def regeneration_candidates(answers: DataFrame, support: DataFrame, loops_only: bool = False) -> DataFrame:
    """Answers worth generating again: ``(id, selected)``, false where the evidence is not strong.

    ``answers`` is ``(id, answer, route, hit_token_limit)``, ``support`` is ``(id, strong)``.
    """
    rows = repair(answers, loops.EXTENDED)
    rows = rows.withColumn("loops", loops.loop_reasons(F.col("answer"), F.col("changes")))
    flagged = F.size("loops") > 0
    if not loops_only:
        flagged = (flagged | F.col("open_before") | (F.size("blocked") > 0) | F.col("hit_token_limit")
                   | (F.col("ratio_before") >= 0.25) | F.contains("route", F.lit("fallback")))
    return rows.where(flagged).select("id").join(support.select("id", "strong"), "id", "left").select(
        "id", F.coalesce("strong", F.lit(False)).alias("selected"))


def accept_generated(attempts: DataFrame) -> DataFrame:
    """Decide on regenerated answers; ``accepted`` when no reason speaks against one.

    Needs ``id, answer, route, hit_token_limit, strong, conflict, flags``.
    """
    rows = repair(attempts, loops.EXTENDED)
    flags = {name: F.col(f"flags.{name}") for name in ("empty", "artifact", "refusal")}
    flags["unsupported_document_numbers"] = F.size("flags.unsupported_document_numbers") > 0
    any_flag = flags["empty"] | flags["artifact"] | flags["refusal"] | flags["unsupported_document_numbers"]
    rejected = _reasons(
        ((F.col("route") != "generated") | F.col("hit_token_limit"), "not_a_complete_generation"),
        (F.col("open_after") | (F.col("ratio_after") >= 0.25) | (F.size("blocked") > 0), "incomplete_or_repetitive"),
        (~F.coalesce("strong", F.lit(False)), "packed_evidence_not_strong"),
        (F.coalesce("conflict", F.lit(False)), "entity_conflict"), (any_flag, "generation_guard"),
        *[(flag, f"guard:{name}") for name, flag in flags.items()],
        (F.col("hit_token_limit"), "hit_token_limit"))
    return rows.select("id", F.col("after").alias("answer"), rejected.alias("rejected"),
                       (F.size(rejected) == 0).alias("accepted"))


def check_candidate(attempts: DataFrame, coverage: float = 0.65, phrase_words: int = 3) -> DataFrame:
    """Recheck a regenerated answer against exactly the evidence it was given.

    Needs ``id, answer, raw_answer, route, hit_token_limit, ended, flags, earlier_flags, conflict`` and
    ``support`` (struct of coverage, longest_phrase, marker_ok, age_value_present). ``faulty`` says
    that another attempt needs a different context, not just more tokens.
    """
    rows = loops.with_loops_removed(attempts, "answer", RepairPolicy(), "kept", "cuts")
    rows = loops.with_loops_removed(rows, "kept", loops.EXTENDED, "_k", "_kept_cuts")
    rows = loops.with_loops_removed(rows, "raw_answer", loops.EXTENDED, "_r", "_raw_cuts")
    guard = lambda name: F.coalesce(F.col(f"flags.{name}"), F.lit(False)) | F.coalesce(
        F.col(f"earlier_flags.{name}"), F.lit(False))
    numbers = lambda side: F.size(F.coalesce(f"{side}.unsupported_document_numbers",
                                             F.array().cast("array<string>"))) > 0
    kept_loops = F.size(loops.loop_reasons(F.col("kept"), F.col("_kept_cuts"))) > 0
    raw_loops = F.size(loops.loop_reasons(F.col("raw_answer"), F.col("_raw_cuts"))) > 0
    s = lambda name: F.col(f"support.{name}")
    weak = ((s("coverage") < coverage) | (s("longest_phrase") < phrase_words)
            | ~F.coalesce(s("marker_ok"), F.lit(True)) | ~F.coalesce(s("age_value_present"), F.lit(True)))
    rejected = _reasons(
        (F.col("hit_token_limit"), "hit_token_limit"),
        (~F.coalesce("ended", F.lit(False)), "no_natural_stop"),
        (an.is_unfinished(F.col("kept")), "unfinished_lead_in"), (kept_loops, "loop"),
        ((F.length("kept") < 0.2 * F.length("answer")) & (tx.word_count(F.col("kept")) < 40), "dedup_too_short"),
        (guard("empty"), "guard:empty"), (guard("artifact"), "guard:artifact"),
        (guard("refusal"), "guard:refusal"),
        (numbers("flags") | numbers("earlier_flags"), "guard:unsupported_document_numbers"),
        (F.col("conflict"), "entity_conflict"), (weak, "insufficient_evidence"))
    by_route = F.when(F.col("route") != "generated", F.array(F.concat(F.lit("route:"), "route")))
    rejected = F.concat(rejected, F.coalesce(by_route, F.array().cast("array<string>")))
    rows = rows.withColumn("rejected", rejected)
    bad = F.exists("rejected", lambda r: F.startswith(r, F.lit("guard:"))
                   | r.isin("loop", "entity_conflict", "insufficient_evidence"))
    return rows.select("id", F.col("kept").alias("answer"), "rejected",
                       (F.size("rejected") == 0).alias("accepted"),
                       (raw_loops | bad | F.contains("route", F.lit("fallback"))).alias("faulty"))


def review_queue(answers: DataFrame, near_limit: int | None = None) -> DataFrame:
    """What to regenerate first: fallbacks, then clearly cut answers, then those near the limit.

    ``answers`` is ``(id, answer, route, hit_token_limit, tokens)``; ``tokens`` matters only with
    ``near_limit``, which replaces the audit columns by a guess from the length.
    """
    unfinished = an.is_unfinished(F.col("answer"))
    if near_limit is None:
        fallback = F.contains("route", F.lit("fallback"))
        reasons = _reasons((fallback, "audit_fallback"),
                           (F.col("hit_token_limit") | (F.col("route") == "generated_truncated"), "audit_token_limit"),
                           (unfinished, "unfinished_lead_in"))
    else:
        fallback = F.coalesce("is_rebuilt_fallback", F.lit(False))
        reasons = _reasons((F.col("tokens") >= near_limit, "suspected_truncated_near_limit"),
                           (fallback, "suspected_fallback_exact_reconstruction"),
                           (unfinished, "unfinished_lead_in"))
    rows = answers.withColumn("reasons", reasons).where(F.size("reasons") > 0)
    rows = rows.withColumn("group", F.when(fallback, "fallback").otherwise("truncated"))
    clear = F.arrays_overlap("reasons", F.array(F.lit("unfinished_lead_in"), F.lit("audit_token_limit")))
    priority = F.when(F.col("group") == "fallback", 0).when(clear, 1).otherwise(2)
    return rows.select("id", "group", "reasons", priority.alias("priority")).orderBy("priority", "id")


def overlay(baseline: DataFrame, candidate: DataFrame, queue: DataFrame, enabled) -> DataFrame:
    """Candidate answers where the item's group is enabled, the baseline everywhere else."""
    chosen = queue.where(F.col("group").isin(list(enabled))).select("id") if enabled else queue.select("id").limit(0)
    new = candidate.join(chosen, "id", "left_semi").select("id", F.col("answer").alias("_new"))
    return baseline.join(new, "id", "left").select("id", F.coalesce("_new", "answer").alias("answer"))
