"""Scores, summaries, paired comparisons and the decisions built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillsift.functions import answers as an, overlap, text as tx
from quillsift.operators.sizing import spread
from quillsift.sources.integrity import id_difference

# Cumulative probabilities of a Poisson variable with mean one.
POISSON_STEPS = [
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
    0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253,
    0.9999988747974020, 0.9999998885745217, 0.9999999899522336, 0.9999999991683892,
]


def score_answers(pairs: DataFrame) -> DataFrame:
    """Per-item scores of ``(id, answer, reference)``."""
    return pairs.select(
        "id", overlap.rouge_l("reference", "answer").alias("rougeL"),
        overlap.meteor_exact("reference", "answer").alias("meteor_exact"),
        tx.word_count(F.col("answer")).alias("prediction_words"),
        tx.word_count(F.col("reference")).alias("reference_words"))


def lower_rank(histogram: DataFrame, by: list, value: str, count: str, shares: dict) -> DataFrame:
    """Order statistics ``sorted[floor(...)]`` from a value histogram.

    ``shares`` maps a name to ``(numerator applied to n - offset, offset)``: the position is
    ``floor((n - offset) * share)``. Works on distinct values, so its size does not follow the rows.
    """
    w = Window.partitionBy(*by)
    ordered = w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = histogram.withColumn("_upto", F.sum(count).over(ordered)).withColumn("_n", F.sum(count).over(w))
    picks = []
    for name, (share, offset) in shares.items():
        index = F.floor((F.col("_n") - offset) * F.lit(share))
        picks.append(F.min(F.when(F.col("_upto") > index, F.col(value))).alias(name))
    return rows.groupBy(*by).agg(*picks)


def length_summary(rows: DataFrame, by: list, value: str) -> DataFrame:
    """Mean, interpolated p90, lower-rank median and p90, and maximum of an integer column."""
    base = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"),
                                 F.percentile(value, F.lit(0.9)).alias("p90"), F.max(value).alias("max"))
    histogram = rows.groupBy(*by, value).agg(F.count("*").alias("c"))
    ranks = lower_rank(histogram, by, value, "c", {"median_low": (0.5, 0), "p90_low": (0.9, 1)})
    return base.join(ranks, by)


def report(scores: DataFrame, target: float = 0.65, by: list | None = None) -> DataFrame:
    """One summary row per group: means, lengths and the distance to the target score."""
    if not 0 <= target <= 1:
        raise ValueError("target must lie in [0, 1]")
    out = scores.groupBy(*(by or [])).agg(
        F.count("*").alias("samples"), F.avg("meteor").alias("meteor"), F.avg("rougeL").alias("rougeL"),
        F.avg("prediction_words").alias("mean_words"),
        F.percentile("prediction_words", F.lit(0.9)).alias("p90_words"),
        F.avg("reference_words").alias("mean_reference_words"))
    return (out.withColumn("target_met", F.col("meteor") >= target)
            .withColumn("gap", F.greatest(F.lit(0.0), F.lit(target) - F.col("meteor"))))


def select_best(reports: DataFrame, order: str = "position") -> DataFrame:
    """Best row by METEOR, ROUGE-L on a tie, the earlier report on a full tie.

    Where the reports name references, metric and ids (``comparable``), differing ones are an error.
    """
    if {"reference_hash", "metric_identity", "ids_hash"} <= set(reports.columns) and not reports.agg(comparable(reports)).first()[0]:
        raise ValueError("reports over different references, metrics or ids")
    key = F.struct("meteor", "rougeL", (-F.col(order)).alias("_o"))
    columns = [F.max_by(c, key).alias(c) for c in reports.columns]
    return reports.agg(*columns)


def comparable(reports: DataFrame) -> Column:
    """Aggregate expression: do all reports share references, metric and id set?"""
    return ((F.count_distinct("reference_hash") <= 1) & (F.count_distinct("metric_identity") <= 1)
            & (F.count_distinct("ids_hash") <= 1))


def paired(control: DataFrame, candidate: DataFrame, metric: str) -> DataFrame:
    """``(id, delta)`` of two score tables over the same ids; an id on one side only is an error."""
    alone = id_difference(candidate, control).first()
    if alone is not None:
        raise ValueError(f"scores of different ids, {alone.side}: {alone.id}")
    a = control.select("id", F.col(metric).alias("a"))
    return a.join(candidate.select("id", F.col(metric).alias("b")), "id").select(
        "id", (F.col("b") - F.col("a")).alias("delta"))


def resampled_interval(deltas: DataFrame, draws: int = 2000, seed: int = 2026) -> DataFrame:
    """Paired comparison of any size: mean, 95 % interval of resampled means, wins and losses.

    Each row takes part in a draw as often as a Poisson(1) number derived from a hash says, which is
    resampling with replacement without anyone having to see all rows. Sums per draw are combined
    inside the map tasks, so ``draws`` rows per task are all that is shuffled.
    """
    rows = spread(deltas).select("delta", "id", F.explode(F.sequence(F.lit(0), F.lit(draws // 4 - 1))).alias("block"))
    rows = rows.select("delta", "block", F.md5(F.concat_ws("|", F.lit(str(seed)), "id", "block")).alias("digest"))
    # Eight hex digits make one uniform number, so a digest serves four draws.
    rows = rows.select("delta", "block", F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.substring("digest", 8 * k + 1, 8).alias("digits")) for k in range(4)])).alias("d"))
    unit = F.conv("d.digits", 16, 10).cast("double") / F.lit(4294967296.0)
    rows = rows.select("delta", (F.col("block") * 4 + F.col("d.k")).alias("draw"), unit.alias("unit"))
    times = F.lit(0)
    for step in POISSON_STEPS:
        times = times + F.when(F.col("unit") >= step, 1).otherwise(0)
    drawn = rows.where(F.col("unit") >= POISSON_STEPS[0]).select("delta", "draw", times.alias("times"))
    means = drawn.groupBy("draw").agg((F.sum(F.col("delta") * F.col("times")) / F.sum("times")).alias("mean"))
    interval = means.agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))
    totals = deltas.agg(F.count("*").alias("samples"), F.avg("delta").alias("mean_delta"),
                        F.count_if(F.col("delta") > 0).alias("wins"), F.count_if(F.col("delta") < 0).alias("losses"))
    return totals.select("*", interval.select("low").scalar().alias("low"),
                         interval.select("high").scalar().alias("high"))


def route_counts(audit: DataFrame) -> DataFrame:
    """Answers per route: how many, how many hit the token limit, and their share."""
    hits = F.count_if("hit_token_limit")
    return audit.groupBy("route").agg(F.count("*").alias("samples"), hits.alias("token_limit_hits"),
                                      (hits / F.count("*")).alias("token_limit_rate"))


def change_facts(control: DataFrame, candidate: DataFrame) -> DataFrame:
    """Facts about two answer tables in one row: changed items, severe repetition, length, open ends."""
    both = control.select("id", F.col("answer").alias("a")).join(
        candidate.select("id", F.col("answer").alias("b")), "id")
    both = both.select("a", "b", an.repetition_ratio(F.col("a")).alias("ra"), an.repetition_ratio(F.col("b")).alias("rb"))
    changed = F.col("a") != F.col("b")
    return both.agg(
        F.count_if(changed).alias("changed"),
        F.count_if(F.col("ra") >= 0.5).alias("severe_before"), F.count_if(F.col("rb") >= 0.5).alias("severe_after"),
        F.count_if(an.is_unfinished(F.col("a"))).alias("open_before"),
        F.count_if(an.is_unfinished(F.col("b"))).alias("open_after"),
        F.coalesce(F.sum(F.when(changed, F.length("a") - F.length("b"))), F.lit(0)).alias("reduction"))


def decisions(facts: DataFrame) -> DataFrame:
    """All acceptance rules on one row of facts with ``delta_meteor`` and ``delta_rouge``."""
    f = F.col
    calmer = f("severe_after") <= f("severe_before")
    return facts.select(
        "*",
        ((f("changed") > 0) & (f("delta_meteor") >= -1e-12) & calmer & (f("reduction") > 0)).alias("accept_repair"),
        ((f("changed") >= 1) & (f("delta_meteor") >= -1e-12) & calmer).alias("accept_variant"),
        ((f("changed") >= 2) & (f("delta_meteor") >= 0.001) & calmer).alias("accept_regeneration"),
        ((f("changed") > 0) & (f("delta_meteor") >= 0.001) & (f("delta_rouge") >= -0.005) & calmer).alias("passes_ablation"),
        ((f("changed") > 0) & (f("delta_meteor") >= 0) & calmer & (f("open_after") <= f("open_before"))).alias("passes_group"))


def choose_penalty(rows: DataFrame) -> DataFrame:
    """The repetition penalty to recommend, the neutral 1.0 when no other passes every condition.

    ``rows`` holds one row per tried penalty: a handful.
    """
    base = rows.where(F.col("repetition_penalty") == 1.0)
    old = lambda c: base.select(c).scalar()
    ok = F.col("repetition_penalty") != 1.0
    for metric in ("meteor", "rougeL"):
        ok = ok & (F.col(metric) - old(metric) >= -1e-12)
    ok = ok & (F.col("raw_loop_count") < old("raw_loop_count"))
    for c in ("final_loop_count", "raw_heading_only_count", "final_heading_only_count"):
        ok = ok & (F.col(c) <= old(c))
    for c in ("raw_repetition_mean", "final_repetition_mean"):
        ok = ok & (F.col(c) <= old(c) + 1e-12)
    judged = rows.withColumn("passes_screen", ok)
    first = judged.where("passes_screen").orderBy(
        "raw_loop_count", "final_loop_count", F.desc("meteor"), F.desc("rougeL"), "repetition_penalty").limit(1)
    pick = first.select("repetition_penalty").scalar()
    return base.select(F.coalesce(pick, F.lit(1.0)).alias("recommended_penalty"),
                       pick.isNotNull().alias("improvement_found"))


def drifted(stored: DataFrame, fresh: DataFrame, metrics, tolerance: float = 1e-10) -> DataFrame:
    """Items whose stored scores are not reproduced; a baseline with any must not be compared with."""
    new = fresh.select("id", *[F.col(m).alias(f"_{m}") for m in metrics])
    off = F.lit(False)
    for m in metrics:
        off = off | ~F.coalesce(F.abs(F.col(m) - F.col(f"_{m}")) <= tolerance, F.lit(False))
    return stored.join(new, "id", "full").where(off).select("id")


def penalty_summary(details: DataFrame) -> DataFrame:
    """One row per repetition penalty from per-item measurements, as ``choose_penalty`` wants them.

    ``details`` is ``(repetition_penalty, meteor, rougeL, raw_reasons, final_reasons, raw_repetition,
    final_repetition)``; the reasons are arrays. An answer of headings only is counted apart.
    """
    def loops_in(c):
        return F.count_if(F.size(F.array_remove(c, "heading_only")) > 0)

    headings = lambda c: F.count_if(F.array_contains(c, "heading_only"))
    return details.groupBy("repetition_penalty").agg(
        F.count("*").alias("samples"), F.avg("meteor").alias("meteor"), F.avg("rougeL").alias("rougeL"),
        loops_in("raw_reasons").alias("raw_loop_count"), loops_in("final_reasons").alias("final_loop_count"),
        headings("raw_reasons").alias("raw_heading_only_count"), headings("final_reasons").alias("final_heading_only_count"),
        F.avg("raw_repetition").alias("raw_repetition_mean"), F.avg("final_repetition").alias("final_repetition_mean"))


def damage_counts(answers: DataFrame, by: tuple = ()) -> DataFrame:
    """How many answers repeat half of their long lines or more, and how many end in a lead-in."""
    return answers.groupBy(*by).agg(F.count_if(an.repetition_ratio(F.col("answer")) >= 0.5).alias("heavy_loop"),
                                    F.count_if(an.is_unfinished(F.col("answer"))).alias("unfinished"))


def outcome_sums(outcomes: DataFrame) -> DataFrame:
    """One row per group of ``(id, group, accepted, changed, attempts, output_tokens, seconds)``: counts and sums."""
    return outcomes.groupBy("group").agg(
        F.count("*").alias("candidates"), F.count_if("accepted").alias("accepted"), F.count_if("changed").alias("changed"),
        F.sum("attempts").alias("attempts"), F.sum("output_tokens").alias("output_tokens"), F.sum("seconds").alias("seconds"))


def rejection_counts(outcomes: DataFrame) -> DataFrame:
    """How often each reason of the array ``rejected`` was given."""
    return outcomes.select(F.explode("rejected").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
