import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillsift.functions import overlap
from quillsift.operators import evaluate as ev, repair, sizing, splits
from quillsift.plans import quality
from quillsift.plans.retrieval import variant
from quillsift.config import RETRIEVAL_VARIANTS, Settings

LINE = "Tổ chức vi phạm bị phạt tiền theo quy định của pháp luật hiện hành về xử phạt"


def table_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_common_subsequence_equals_the_table():
    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 90))] for _ in range(2))
        assert overlap.common_subsequence(a, b) == table_lcs(a, b)


def test_scores(spark):
    rows = spark.createDataFrame([("1", "alpha beta gamma delta", "alpha beta gamma delta"), ("2", "", "x y"), ("3", "x q y", "x y")],
                                 "id string, answer string, reference string")
    got = {r.id: r for r in ev.score_answers(rows).collect()}
    assert got["1"].rougeL == 1.0 and got["1"].meteor_exact == pytest.approx(1 - 0.5 * (1 / 4) ** 3)
    assert got["2"].rougeL == 0.0 and got["2"].meteor_exact == 0.0 and got["3"].rougeL == pytest.approx(0.8)
    assert overlap.rouge_tokens("pháp luật") == ["ph", "p", "lu", "t"]


def test_length_summary(spark):
    r = random.Random(2)
    values = [r.randint(1, 30) for _ in range(57)]
    row = ev.length_summary(spark.createDataFrame([("g", v) for v in values], "g string, v int"), ["g"], "v").first()
    s = sorted(values)
    assert (row.median_low, row.p90_low, row.max) == (s[57 // 2], s[int(56 * .9)], s[-1])
    assert row.p90 == pytest.approx(np.quantile(values, .9)) and row.mean == pytest.approx(np.mean(values))


def test_resampled_interval_is_near_the_exact_one(spark):
    r = random.Random(3)
    deltas = {str(i): r.uniform(-1, 1.2) for i in range(37)}
    values = np.array([deltas[k] for k in sorted(deltas)])
    g = np.random.default_rng(2026)
    low, high = np.quantile([values[g.integers(0, 37, 37)].mean() for _ in range(2000)], [.025, .975])
    row = ev.resampled_interval(spark.createDataFrame(list(deltas.items()), "id string, delta double")).first()
    assert row.mean_delta == pytest.approx(values.mean()) and abs(row.low - low) < 0.1 and abs(row.high - high) < 0.1
    assert row.wins == int((values > 0).sum()) and row.losses == int((values < 0).sum())


def test_report_and_selection(spark):
    scores = spark.createDataFrame([(0.4, 0.5, 10, 8), (0.6, 0.7, 20, 8)], "meteor double, rougeL double, prediction_words int, reference_words int")
    row = ev.report(scores, target=0.6).first()
    assert row.meteor == 0.5 and not row.target_met and row.gap == pytest.approx(0.1) and row.p90_words == 19
    with pytest.raises(ValueError):
        ev.report(scores, target=2)
    reports = spark.createDataFrame([("a", 0.5, 0.5, 0), ("b", 0.5, 0.6, 1), ("c", 0.5, 0.6, 2)], "label string, meteor double, rougeL double, position int")
    assert ev.select_best(reports).first().label == "b"


def test_reports_over_other_ids_are_refused(spark):
    reports = spark.createDataFrame([("a", 0.5, 0.5, 0, "r", "m", "i"), ("b", 0.6, 0.6, 1, "r", "m", "j")],
                                    "label string, meteor double, rougeL double, position int, reference_hash string, metric_identity string, ids_hash string")
    with pytest.raises(ValueError, match="different"):
        ev.select_best(reports)
    assert ev.select_best(reports.withColumn("ids_hash", F.lit("i"))).first().label == "b"
    scores = spark.createDataFrame([(1, 0.5), (2, 0.25)], "id int, m double")
    assert sorted(r.delta for r in ev.paired(scores, scores.selectExpr("id", "m + id AS m"), "m").collect()) == [1.0, 2.0]
    for one, other in ((scores, scores.where("id = 1")), (scores.where("id = 1"), scores)):
        with pytest.raises(ValueError, match="different ids"):
            ev.paired(one, other, "m")


def test_outcomes_and_damage(spark):
    rows = spark.createDataFrame([(1, "x", True, True, 2, 10, 0.5, []), (2, "x", False, False, 4, 5, 1.0, ["loop", "guard:empty"]), (3, "y", False, True, 1, 1, 2.0, ["loop"])],
                                 "id int, group string, accepted boolean, changed boolean, attempts int, output_tokens int, seconds double, rejected array<string>")
    got = {r.group: tuple(r)[1:] for r in ev.outcome_sums(rows).collect()}
    assert got == {"x": (2, 1, 1, 6, 15, 1.5), "y": (1, 0, 1, 1, 1, 2.0)}
    assert {r.reason: r.n for r in ev.rejection_counts(rows).collect()} == {"loop": 2, "guard:empty": 1}
    answers = spark.createDataFrame([(f"{LINE}\n" * 4,), ("Theo đó:",), ("Được.",)], "answer string")
    assert tuple(ev.damage_counts(answers).first()) == (1, 1)


def test_decisions(spark):
    def decide(before, after, meteor, rouge=0.0):
        make = lambda texts: spark.createDataFrame(list(enumerate(texts)), "id int, answer string")
        facts = ev.change_facts(make(before), make(after))
        return ev.decisions(facts.withColumn("delta_meteor", F.lit(meteor)).withColumn("delta_rouge", F.lit(rouge))).first()

    old, new = ["a a.", "b b."], ["a.", "b."]
    assert not decide(old, new, -.01).accept_variant and not decide(old, new, .0005).accept_regeneration
    assert decide(old, new, .005).accept_regeneration and not decide(old, ["a.", "b b."], .005).accept_regeneration
    assert decide(old, new, 0.0).accept_repair and not decide(old, old, 0.1).accept_repair
    assert not decide(old, ["a a.\n" + f"{LINE}\n" * 4, "b"], .1).accept_variant
    assert decide(old, new, .002, -.004).passes_ablation and not decide(old, new, .002, -.006).passes_ablation


def test_penalty_choice(spark):
    cols = ("repetition_penalty meteor rougeL raw_loop_count final_loop_count raw_heading_only_count final_heading_only_count "
            "raw_repetition_mean final_repetition_mean").split()
    base = [1.0, .6, .5, 5, 3, 1, 1, .1, .1]
    pick = lambda *rows: ev.choose_penalty(spark.createDataFrame([base, *rows], cols)).first()
    assert pick([1.03, .6, .5, 4, 3, 1, 1, .1, .1], [1.05, .6, .5, 3, 3, 1, 1, .1, .1]).recommended_penalty == 1.05
    none = pick([1.03, .59, .5, 4, 3, 1, 1, .1, .1], [1.05, .7, .6, 3, 4, 1, 1, .1, .1])
    assert none.recommended_penalty == 1.0 and not none.improvement_found


def test_repair(spark):
    rows = [("loop", f"{LINE}\n" * 4 + "Kết.", "generated", False), ("lead", f"{LINE} như sau:\n" * 45, "generated", True),
            ("fine", "Được.", "generated", False), ("back", "Được.", "source_fallback", False)]
    df = spark.createDataFrame(rows, "id string, answer string, route string, hit_token_limit boolean")
    got = {r.id: r for r in repair.repair(df).collect()}
    assert got["loop"].after == f"{LINE}\nKết." and got["loop"].reasons == ["repetition_screen", "exact_adjacent_loop"]
    lead = got["lead"]
    assert lead.after == lead.answer and "dedup_leaves_unfinished_answer" in lead.blocked
    assert lead.action == "review_for_selective_regeneration" and got["back"].action == "review_context_first"
    assert got["fine"].action is None and got["fine"].reasons == []
    support = spark.createDataFrame([("loop", True), ("lead", False)], "id string, strong boolean")
    assert {(r.id, r.selected) for r in repair.regeneration_candidates(df, support, loops_only=True).collect()} == {("loop", True), ("lead", False)}
    queue = repair.review_queue(df).collect()
    assert [(r.id, r.group) for r in queue] == [("back", "fallback"), ("lead", "truncated")]
    merged = repair.overlay(df, df.select("id", F.lit("new").alias("answer")), repair.review_queue(df), ["truncated"])
    assert {r.id for r in merged.where("answer = 'new'").collect()} == {"lead"}


def test_candidate_checks(spark):
    flags = "struct<empty:boolean,unsupported_document_numbers:array<string>,refusal:boolean,artifact:boolean>"
    ok = (False, [], False, False)
    s = (0.9, 4, True, True)
    rows = [("a", "Đủ căn cứ.", "Đủ căn cứ.", "generated", False, True, ok, ok, False, s),
            ("b", "Gồm:", "x", "source_fallback", True, False, (False, ["1/qđ"], False, False), ok, True, (0.1, 4, True, True))]
    df = spark.createDataFrame(rows, f"id string, answer string, raw_answer string, route string, hit_token_limit boolean, ended boolean, "
                               f"flags {flags}, earlier_flags {flags}, conflict boolean, "
                               "support struct<coverage:double,longest_phrase:int,marker_ok:boolean,age_value_present:boolean>")
    got = {r.id: r for r in repair.check_candidate(df).collect()}
    assert got["a"].accepted and not got["a"].faulty and got["b"].faulty
    assert set(got["b"].rejected) == {"hit_token_limit", "no_natural_stop", "unfinished_lead_in", "guard:unsupported_document_numbers",
                                      "entity_conflict", "insufficient_evidence", "route:source_fallback"}
    gen = df.withColumn("strong", F.col("id") == "a")
    assert {(r.id, r.accepted) for r in repair.accept_generated(gen).collect()} == {("a", True), ("b", False)}


def digest(v):
    return hashlib.sha256(json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def plain_split(records, seed=2026):
    root = {k: k for k in records}
    changed = True
    while changed:
        changed = False
        for a in records:
            for b in records:
                if (records[a][0] == records[b][0] or records[a][1] == records[b][1]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    groups = {}
    for k in sorted(records):
        groups.setdefault(root[k], []).append(k)
    part = lambda g, k: sum(int(hashlib.sha256(i.encode()).hexdigest()[12 * k:12 * k + 12], 16) for i in g)
    order = sorted(groups.values(), key=lambda g: hashlib.sha256(f"{seed}|{len(g)}|{part(g, 0)}|{part(g, 1)}".encode()).hexdigest())
    n = len(order)
    c1, c2 = max(1, round(.8 * n)), min(n - 1, round(.9 * n))
    parts = {"train": order[:c1], "dev": order[c1:c2], "holdout": order[c2:]}
    return {k: (name, i + 1) for name, gs in parts.items()
            for i, k in enumerate(sorted((k for g in gs for k in g), key=lambda k: digest([seed, name, k])))}


def test_split_equals_the_plain_rule(spark):
    r = random.Random(9)
    records = {str(i): (f"q{r.randint(0, 150)}", f"a{r.randint(0, 150)}") for i in range(60)}
    records.update({"90": ("q90", "a90"), "91": ("q90", "a91"), "92": ("q92", "a91")})
    records.update({str(i): ("hot", f"b{i}") for i in range(100, 130)})
    df = spark.createDataFrame([(k, f" {q.upper()}? ", a + ".") for k, (q, a) in records.items()], "id string, question string, answer string")
    got = {x.id: (x.split, x.pos) for x in splits.hash_split(splits.duplicate_groups(df)).collect()}
    assert got == plain_split(records)


def test_long_chain_is_one_group(spark):
    n = 120
    edges = spark.createDataFrame([(f"{i:04d}", f"{i + 1:04d}") for i in range(n)], "u string, v string")
    got = splits.connected(edges)
    assert got.count() == n and {r.root for r in got.collect()} == {"0000"}


def test_subset(spark):
    ids = [str(i) for i in range(300)]
    got = splits.hashed_subset(spark.createDataFrame([(i,) for i in ids], "id string"), 40).orderBy("pos").collect()
    assert [r.id for r in got] == sorted(ids, key=lambda i: digest({"seed": 2026, "id": i}))[:40]
    with pytest.raises(ValueError):
        splits.hashed_subset(spark.range(1), 0)


def test_hot_split_join_equals_a_join(spark):
    facts = spark.createDataFrame([("hot" if i % 3 else f"k{i % 7}", i) for i in range(200)], "k string, v int")
    dims = facts.groupBy("k").agg(F.count("*").alias("n"))
    got = sizing.hot_split_join(facts, dims, "k", "n", 200, share=4)
    assert sorted(map(tuple, got.select("k", "v", "n").collect())) == sorted(map(tuple, facts.join(dims, "k").select("k", "v", "n").collect()))


def test_settings():
    base = Settings()
    assert [base.patched(p).retrieval != base.retrieval for p in RETRIEVAL_VARIANTS.values()] == [True] * 5
    for wrong in ({"nowhere": {}}, {"retrieval": {"typo": 1}}, {"seed": {}}):
        with pytest.raises(ValueError):
            base.patched(wrong)
    assert variant(base.retrieval, pool_k=3).pool_k == 3


def test_drift_and_penalty_summary(spark):
    a = spark.createDataFrame([("1", 0.5), ("2", 0.5), ("3", 0.5)], "id string, meteor double")
    b = spark.createDataFrame([("1", 0.5), ("2", 0.5001)], "id string, meteor double")
    assert {r.id for r in ev.drifted(a, b, ["meteor"]).collect()} == {"2", "3"}
    rows = spark.createDataFrame([(1.0, .5, .5, ["heading_only"], [], .1, .0), (1.0, .7, .5, ["numbered_loop"], ["heading_only", "x"], .3, .2)],
                                 "repetition_penalty double, meteor double, rougeL double, raw_reasons array<string>, "
                                 "final_reasons array<string>, raw_repetition double, final_repetition double")
    r = ev.penalty_summary(rows).first()
    assert (r.raw_loop_count, r.final_loop_count, r.raw_heading_only_count, r.final_heading_only_count) == (1, 1, 1, 1)
    assert r.meteor == pytest.approx(.6) and r.raw_repetition_mean == pytest.approx(.2)


def test_repair_job_and_group_screens(spark):
    tail = "Hết."
    rows = [("1", f"{LINE}.\n" * 5 + tail, "generated", False), ("2", tail, "source_fallback", False)]
    df = spark.createDataFrame(rows, "id string, answer string, route string, hit_token_limit boolean")
    refs = spark.createDataFrame([("1", f"{LINE}.\n{tail}"), ("2", "Đáp án đúng.")], "id string, answer string")
    selected, name, review = quality.repair_job(df, refs)
    assert {r.id: r.answer for r in selected.collect()}["1"] == f"{LINE}.\n{tail}" and review.count() == 2 and name in ("cpu_v1", "cpu_v2")
    queue = repair.review_queue(df)
    better = spark.createDataFrame([("2", "Đáp án đúng.")], "id string, answer string")
    merged, enabled = quality.screen_groups(df, better, queue, refs)
    assert enabled == ["fallback"] and {r.answer for r in merged.where("id = '2'").collect()} == {"Đáp án đúng."}
    worse = spark.createDataFrame([("2", "Sai:")], "id string, answer string")
    kept, none = quality.screen_groups(df, worse, queue, refs)
    assert none == [] and kept.count() == 2
