"""Quality jobs: repair policies compared, group-wise acceptance of regenerated answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillsift.config import RepairPolicy
from quillsift.functions import loops
from quillsift.operators import evaluate as ev, repair
from quillsift.session import settled


def scored_facts(control: DataFrame, candidate: DataFrame, references: DataFrame, metric: str = "meteor_exact") -> DataFrame:
    """One row of facts about two answer tables, with score differences against the references.

    ``metric`` stands where the acceptance rules ask for METEOR; supply a scored column of that name
    through ``ev.decisions`` directly when the full metric is available.
    """
    def mean(answers: DataFrame) -> DataFrame:
        pairs = answers.select("id", "answer").join(references.select("id", F.col("answer").alias("reference")), "id")
        return ev.score_answers(pairs).agg(F.avg(metric).alias("m"), F.avg("rougeL").alias("r"))

    old, new = mean(control), mean(candidate)
    gap = lambda c: new.select(c).scalar() - old.select(c).scalar()
    return ev.change_facts(control, candidate).select("*", gap("m").alias("delta_meteor"), gap("r").alias("delta_rouge"))


def repair_job(answers: DataFrame, references: DataFrame):
    """Conservative repair against the originals, then the extended policy against the winner.

    ``answers`` is ``(id, answer, route, hit_token_limit)``. Returns the selected answers, the name of
    the selected variant and the review table that goes with it.
    """
    selected, chosen = answers.select("id", "answer"), "original"
    review = settled(repair.repair(answers, RepairPolicy()))
    for name, policy, rule in (("cpu_v1", RepairPolicy(), "accept_repair"), ("cpu_v2", loops.EXTENDED, "accept_variant")):
        outcome = review if policy.version == 1 else settled(repair.repair(answers, policy))
        candidate = outcome.select("id", F.col("after").alias("answer"))
        if ev.decisions(scored_facts(selected, candidate, references)).first()[rule]:
            selected, chosen, review = candidate, name, outcome
    return selected, chosen, review


def screen_groups(baseline: DataFrame, candidate: DataFrame, queue: DataFrame, references: DataFrame,
                  groups=("fallback", "truncated")):
    """Enable whole groups of regenerated answers, never single items.

    Each group is screened alone, then all passing groups together; when that fails the baseline
    stays. Returns the selected answers and the enabled groups.
    """
    def passes(answers: DataFrame) -> bool:
        return ev.decisions(scored_facts(baseline, answers, references)).first()["passes_group"]

    enabled = [g for g in groups if passes(repair.overlay(baseline, candidate, queue, [g]))]
    merged = repair.overlay(baseline, candidate, queue, enabled)
    if not enabled or not passes(merged):
        return baseline.select("id", "answer"), []
    return merged, enabled
