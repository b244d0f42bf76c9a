"""Checks and clean-up of one answer, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quillsift.functions import lexicon as lx, text as tx

S = f"[{lx.WS}]"  # one white-space character, as the rules understand it


def _wide(pattern: str) -> str:
    """A rule pattern with its ``\\s`` widened to all white space."""
    return pattern.replace("\\s", S)


def clean_answer(text: Column) -> Column:
    """Remove markup, labels, links and list bullets, in a fixed order."""
    out = F.replace(F.replace(text, F.lit("**"), F.lit("")), F.lit("__"), F.lit(""))
    steps = [
        ("(?is)<think>.*?</think>", ""),
        ("<\\|[^>]+\\|>", ""),
        (f"^{S}*```[^\\n]*\\n?|```{S}*$", ""),
        (f"(?md)^{S}{{0,3}}#{{1,6}}{S}+", ""),
        ("(?iu)" + _wide(lx.ANSWER_LABEL), ""),
        ("\\[([^\\]]+)\\]\\(https?://[^)]+\\)", "$1"),
        (f"https?://[^{lx.WS}]+", ""),
        (f"(?md)^{S}*[-*+]{S}+", ""),
        ("\\n{3,}", "\n\n"),
    ]
    for pattern, replacement in steps:
        out = F.regexp_replace(out, pattern, replacement)
    return tx.strip(out)


def is_blank(text: Column) -> Column:
    return F.length(tx.strip(text)) == 0


def is_refusal(text: Column) -> Column:
    return text.rlike("(?iu)" + _wide(lx.REFUSAL))


def has_artifact(text: Column) -> Column:
    return text.rlike("(?d)" + _wide(lx.ARTIFACT))


def answer_flags(answer: Column, evidence: Column) -> Column:
    """Struct of empty, unsupported_document_numbers, refusal and artifact."""
    foreign = F.array_except(tx.document_numbers(answer), tx.document_numbers(evidence))
    return F.struct(
        is_blank(answer).alias("empty"), F.array_sort(foreign).alias("unsupported_document_numbers"),
        is_refusal(answer).alias("refusal"), has_artifact(answer).alias("artifact"))


def is_unfinished(text: Column) -> Column:
    """Blank, ending with a colon, or ending with words that announce a list."""
    trimmed = F.rtrim(text, F.lit(lx.WS_CHARS))
    lead = text.rlike("(?iu)" + _wide(lx.LEAD_IN).removesuffix("$") + "\\z")
    return (F.length(trimmed) == 0) | F.endswith(trimmed, F.lit(":")) | lead


def spare(items: Column) -> Column:
    """How many items of an array repeat an earlier one."""
    return F.size(items) - F.size(F.array_distinct(items))


def repetition_ratio(text: Column) -> Column:
    """Share of repeated lines among the lines of 35 characters and more."""
    return repeated_share(tx.lines(text))


def repeated_share(lines: Column) -> Column:
    return tx.let(tx.long_of(lines), lambda found: F.when(
        F.size(found) > 0, spare(found) / F.size(found)).otherwise(F.lit(0.0)))


def completed_prefix(answer: Column, minimum: int = 24) -> Column:
    """A cut-off answer up to its last finished sentence, else without its last line, else empty."""
    def shortened(text: Column) -> Column:
        sentence = tx.strip(F.regexp_extract(text, f"(?s)^(.*[.!?;:])(?={S}|$)", 1))
        kept = F.filter(F.transform(tx.lines(text), tx.strip), lambda x: F.length(x) > 0)
        shorter = tx.let(kept, lambda k: F.array_join(
            F.slice(k, F.lit(1), F.greatest(F.size(k) - 1, F.lit(0))), "\n"))
        parts = F.struct(sentence.alias("sentence"), shorter.alias("shorter"))
        return tx.let(parts, lambda p: F.when(tx.word_count(p["sentence"]) >= minimum, p["sentence"])
                      .when(tx.word_count(p["shorter"]) >= minimum, p["shorter"]).otherwise(F.lit("")))

    return tx.let(clean_answer(answer), shortened)


def route(conflict: Column, hit_limit: Column, flags: Column, strong: Column,
          completable: Column) -> Column:
    """Which way an answer takes; the order of the cases is the precedence."""
    invalid = (flags["empty"] | flags["artifact"]
               | (F.size(flags["unsupported_document_numbers"]) > 0))
    return (F.when(conflict, "entity_guard_fallback")
            .when(hit_limit & ~invalid & ~flags["refusal"] & completable, "generated_truncated")
            .when(hit_limit & ~invalid & ~flags["refusal"], "source_fallback")
            .when(invalid | (flags["refusal"] & strong), "source_fallback")
            .when(flags["refusal"], "generated_refusal")
            .otherwise("generated"))
