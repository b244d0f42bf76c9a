"""Twins of the repair, score, decision and split queries."""

from oracle.answers import LONG, PAIRS, S, clean_answer, wide
from oracle.base import WS, fold, select, strip, words
from quillsift.functions import lexicon as lx
from quillsift.operators.evaluate import POISSON_STEPS


def unfinished(x: str) -> str:
    return (f"({strip(x)} = '' OR suffix(rtrim({x}, '{lx.WS_CHARS}'), ':') "
            f"OR regexp_matches({x}, '(?i){wide(lx.LEAD_IN)}'))")


def ratio(x: str) -> str:
    l = LONG.replace("array(text,", f"array({x},")
    return f"(CASE WHEN len({l}) > 0 THEN (len({l}) - len(list_distinct({l}))) / len({l}) ELSE 0.0 END)"


def key(x: str) -> str:
    norm = strip(f"regexp_replace(nfc_normalize({x}), '[{WS}]+', ' ', 'g')")
    return f"rtrim({fold(norm)}, ' ?.!。')"


AUDITED = """
audited AS (SELECT d.doc_id::VARCHAR AS id, text AS answer,
   CASE WHEN quality IS NULL THEN 'unaudited' WHEN quality = 1 THEN 'generated' ELSE 'source_fallback' END AS route,
   coalesce(toxic = 1, false) AS hit, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id))
"""

GROUPS = f"""
kq AS (SELECT qid AS id, {key('question')} AS k, {key('answer')} AS a FROM pairs),
reach AS (SELECT id AS u, id AS v FROM kq UNION
          SELECT r.u, y.id FROM reach r JOIN kq x ON x.id = r.v JOIN kq y ON y.k = x.k OR y.a = x.a),
groups AS (SELECT u AS id, min(v) AS root FROM reach GROUP BY u)
"""

TIMES = " + ".join(f"(CASE WHEN unit >= {s!r}::DOUBLE THEN 1 ELSE 0 END)" for s in POISSON_STEPS)

DIFF = "deltas AS (SELECT doc_id AS id, ((1 - toxic)::DOUBLE - quality::DOUBLE) AS delta FROM labels)"

ROUGE_TOKENS = "list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda w: w <> '')"

#: The longest common subsequence row by row; words aligned from the end, the k-th last with the k-th last.
OVERLAP = f"""
tk AS (SELECT qid AS id, {ROUGE_TOKENS.format(x='question')} AS a, {ROUGE_TOKENS.format(x='answer')} AS b, question, answer FROM pairs),
lcs AS (SELECT id, a, b, list_reduce(a, lambda r, w: list_reduce(range(1, len(b) + 1), lambda acc, j:
          list_append(acc, greatest(acc[j], r[j + 1], r[j] + CASE WHEN b[j] = w THEN 1 ELSE 0 END)), [0]), list_transform(range(0, len(b) + 1), lambda z: 0))[-1] AS c FROM tk),
wd AS (SELECT qid AS id, {words("lower(question)")} AS g, {words("lower(answer)")} AS m FROM pairs),
gold AS (SELECT *, row_number() OVER (PARTITION BY id, w ORDER BY i DESC) AS k FROM (SELECT id, unnest(g) AS w, generate_subscripts(g, 1) AS i FROM wd)),
mine AS (SELECT *, row_number() OVER (PARTITION BY id, w ORDER BY i DESC) AS k FROM (SELECT id, unnest(m) AS w, generate_subscripts(m, 1) AS i FROM wd)),
met AS (SELECT m.id, m.i AS x, g.i AS y, lag(m.i) OVER (PARTITION BY m.id ORDER BY m.i) AS px, lag(g.i) OVER (PARTITION BY m.id ORDER BY m.i) AS py
        FROM mine m JOIN gold g ON m.id = g.id AND m.w = g.w AND m.k = g.k),
chunks AS (SELECT id, count(*) AS n, count(*) FILTER (px IS NULL OR x <> px + 1 OR y <> py + 1) AS parts FROM met GROUP BY id)
"""

OUTCOMES = """outcomes AS (SELECT *, list_filter([CASE WHEN value < 20 THEN 'loop' END, CASE WHEN user_id % 2 = 0 THEN 'no_natural_stop' END,
  CASE WHEN value >= 60 THEN 'hit_token_limit' END], lambda r: r IS NOT NULL) AS rejected FROM events)"""

SQL = {
    "review_queue": select([AUDITED], f"""
        SELECT id, CASE WHEN fb THEN 'fallback' ELSE 'truncated' END AS "group",
          array_to_string(list_filter([CASE WHEN fb THEN 'audit_fallback' END, CASE WHEN hit THEN 'audit_token_limit' END,
            CASE WHEN u THEN 'unfinished_lead_in' END], lambda x: x IS NOT NULL), '|') AS reasons,
          (CASE WHEN fb THEN 0 ELSE 1 END)::INT AS priority
        FROM (SELECT *, contains(route, 'fallback') AS fb, {unfinished('answer')} AS u FROM audited) WHERE fb OR hit OR u"""),
    "route_counts": select([AUDITED], """
        SELECT route, count(*) AS samples, count(*) FILTER (hit) AS token_limit_hits,
               round(count(*) FILTER (hit) / count(*), 9) AS token_limit_rate FROM audited GROUP BY route"""),
    "metric_summary": f"""
        SELECT lang, count(*) AS n, round(avg(w), 6) AS mean, round(quantile_cont(w, 0.9), 6) AS p90, max(w)::INT AS max,
               (list_sort(list(w)))[len(list(w)) // 2 + 1]::INT AS median_low,
               (list_sort(list(w)))[floor((len(list(w)) - 1) * 0.9)::INT + 1]::INT AS p90_low
        FROM (SELECT lang, len({words('text')}) AS w FROM documents) GROUP BY lang""",
    "paired_comparison": select([DIFF, f"""
        drawn AS (SELECT delta, b * 4 + k AS draw, ('0x' || substr(h, 8 * k + 1, 8))::BIGINT / 4294967296.0::DOUBLE AS unit
          FROM (SELECT delta, b, md5('2026|' || id || '|' || b) AS h FROM deltas, range(500) r(b)), range(4) ks(k)),
        means AS (SELECT draw, sum(delta * t) / sum(t) AS mean FROM (SELECT delta, draw, {TIMES} AS t FROM drawn) WHERE t > 0 GROUP BY draw)"""],
        """SELECT count(*) AS samples, count(*) FILTER (delta > 0) AS wins, count(*) FILTER (delta < 0) AS losses,
               round(avg(delta), 6) AS mean_delta, round((SELECT quantile_cont(mean, 0.025) FROM means), 6) AS low,
               round((SELECT quantile_cont(mean, 0.975) FROM means), 6) AS high FROM deltas"""),
    "acceptance_decision": select([AUDITED, f"""
        two AS (SELECT answer AS a, {clean_answer('answer')} AS b, quality, toxic FROM audited),
        facts AS (SELECT count(*) FILTER (a <> b) AS changed, count(*) FILTER ({ratio('a')} >= 0.5) AS severe_before,
          count(*) FILTER ({ratio('b')} >= 0.5) AS severe_after, count(*) FILTER {'(' + unfinished('a') + ')'} AS open_before,
          count(*) FILTER {'(' + unfinished('b') + ')'} AS open_after,
          coalesce(sum(CASE WHEN a <> b THEN len(a) - len(b) END), 0)::BIGINT AS reduction,
          round(avg(1 - toxic - quality), 9) AS delta_meteor, round(avg(toxic - quality), 9) AS delta_rouge FROM two)"""],
        """SELECT *, changed > 0 AND delta_meteor >= -1e-12 AND severe_after <= severe_before AND reduction > 0 AS accept_repair,
             changed >= 1 AND delta_meteor >= -1e-12 AND severe_after <= severe_before AS accept_variant,
             changed >= 2 AND delta_meteor >= 0.001 AND severe_after <= severe_before AS accept_regeneration,
             changed > 0 AND delta_meteor >= 0.001 AND delta_rouge >= -0.005 AND severe_after <= severe_before AS passes_ablation,
             changed > 0 AND delta_meteor >= 0 AND severe_after <= severe_before AND open_after <= open_before AS passes_group FROM facts"""),
    "select_best": """
        SELECT source AS label, round(avg(quality), 9) AS meteor, round(avg(toxic), 9) AS rougeL
        FROM documents JOIN labels USING (doc_id) GROUP BY source ORDER BY meteor DESC, rougeL DESC, min(doc_id) LIMIT 1""",
    "split_groups": "WITH RECURSIVE " + ",\n".join([PAIRS.strip(), GROUPS.strip()]) + " SELECT id, root FROM groups",
    "hash_order_split": "WITH RECURSIVE " + ",\n".join([PAIRS.strip(), GROUPS.strip(), """
        g AS (SELECT root, sha256('2026|' || count(*) || '|' || sum(('0x' || substr(sha256(id), 1, 12))::BIGINT) || '|'
              || sum(('0x' || substr(sha256(id), 13, 12))::BIGINT)) AS d FROM groups GROUP BY root),
        o AS (SELECT root, row_number() OVER (ORDER BY d) AS r, count(*) OVER () AS n FROM g),
        s AS (SELECT id, CASE WHEN r <= greatest(1, round_even(0.8 * n, 0)) THEN 'train'
                WHEN r <= least(n - 1, round_even(0.9 * n, 0)) THEN 'dev' ELSE 'holdout' END AS split FROM groups JOIN o USING (root))"""]) + """
        SELECT id, split, row_number() OVER (PARTITION BY split ORDER BY sha256('[2026,"' || split || '","' || id || '"]')) AS pos FROM s""",
    "training_subset": select([PAIRS], """
        SELECT qid AS id, row_number() OVER (ORDER BY sha256('{"id":"' || qid || '","seed":2026}')) AS pos FROM pairs QUALIFY pos <= 100"""),
    "rouge_l": select([PAIRS, OVERLAP], """
        SELECT l.id, CASE WHEN c > 0 THEN round(2 * (c / len(b)) * (c / len(a)) / (c / len(b) + c / len(a)), 9) ELSE 0.0::DOUBLE END AS rougeL,
          coalesce(round((1 - 0.5 * (parts / n) ** 3) * (n / len(m)) * (n / len(g)) / (0.9 * (n / len(m)) + 0.1 * (n / len(g))), 9), 0.0::DOUBLE) AS meteor_exact,
          len(m)::INT AS prediction_words, len(g)::INT AS reference_words
        FROM lcs l JOIN wd USING (id) LEFT JOIN chunks USING (id)"""),
    "damage_counts": f"""
        SELECT source, count(*) FILTER ({ratio('text')} >= 0.5) AS heavy_loop, count(*) FILTER ({unfinished('text')}) AS unfinished
        FROM documents GROUP BY source""",
    "outcome_sums": f"""
        WITH {OUTCOMES} SELECT event_type AS "group", count(*) AS candidates, count(*) FILTER (len(rejected) = 0) AS accepted,
          count(*) FILTER (value >= 30) AS changed, sum(1 + event_id % 4)::BIGINT AS attempts, sum(floor(value))::BIGINT AS output_tokens,
          sum(value::DECIMAL(20, 6))::DOUBLE AS seconds FROM outcomes GROUP BY event_type""",
    "rejection_counts": f"""
        WITH {OUTCOMES} SELECT reason, count(*) AS n FROM (SELECT unnest(rejected) AS reason FROM outcomes) GROUP BY reason""",
    "score_drift": "SELECT doc_id AS id FROM labels WHERE doc_id % 77 = 0 OR doc_id % 10 = 0",
    "group_overlay": f"""
        SELECT doc_id AS id, sha256(CASE WHEN quality = 1 THEN {clean_answer('text')} ELSE text END) AS answer_sha
        FROM documents LEFT JOIN labels USING (doc_id)""",
    "penalty_choice": """
        WITH s AS (SELECT doc_id % 4 AS k, count(*) AS samples, count(*) FILTER (doc_id % 4 = 0 OR toxic = 1) AS raw_loop_count,
            count(*) FILTER (quality = 0 AND doc_id % 4 = 0) AS final_heading_only_count, avg(quality + doc_id % 4) AS meteor,
            avg(1 - toxic + doc_id % 4) AS rouge, avg(quality / (1 + doc_id % 4)) AS raw_repetition FROM labels GROUP BY 1),
        good AS (SELECT s.k FROM s, s AS o WHERE o.k = 0 AND s.k <> 0 AND s.meteor - o.meteor >= -1e-12 AND s.rouge - o.rouge >= -1e-12
            AND s.raw_loop_count < o.raw_loop_count AND s.final_heading_only_count <= o.final_heading_only_count
            AND s.raw_repetition <= o.raw_repetition + 1e-12 ORDER BY s.raw_loop_count, s.meteor DESC, s.rouge DESC, s.k LIMIT 1)
        SELECT round(1 + k * 0.05::DOUBLE, 6) AS repetition_penalty, samples, raw_loop_count, final_heading_only_count, round(meteor, 6) AS meteor,
          round(coalesce((SELECT 1 + k * 0.05::DOUBLE FROM good), 1.0::DOUBLE), 6) AS recommended_penalty, EXISTS (SELECT * FROM good) AS improvement_found FROM s""",
}
