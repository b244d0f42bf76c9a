"""Twins of the answer queries."""

from oracle.base import EOL, STOP, WS, clean, distinct, fold, select, strip, toks, words
from quillsift.functions import lexicon as lx

S = f"[{WS}]"


def wide(p: str) -> str:
    return p.replace("\\s", S).replace("'", "''")


def clean_answer(x: str) -> str:
    out = f"replace(replace({x}, '**', ''), '__', '')"
    for pattern, repl in [
        ("(?is)<think>.*?</think>", "''"), ("<\\|[^>]+\\|>", "''"),
        (f"^{S}*```[^\\n]*\\n?|```{S}*$", "''"), (f"(?m)^{S}{{0,3}}#{{1,6}}{S}+", "''"),
        ("(?i)" + wide(lx.ANSWER_LABEL), "''"), ("\\[([^\\]]+)\\]\\(https?://[^)]+\\)", "'\\1'"),
        (f"https?://[^{WS}]+", "''"), (f"(?m)^{S}*[-*+]{S}+", "''"), ("\\n{3,}", "chr(10) || chr(10)"),
    ]:
        out = f"regexp_replace({out}, '{pattern}', {repl}, 'g')"
    return strip(out)


REFUSAL = "(?i)" + wide(lx.REFUSAL)
ARTIFACT = wide(lx.ARTIFACT)
LONG = f"list_filter(list_transform(regexp_split_to_array(text, '[{EOL}]'), lambda x: {strip('x')}), lambda x: len(x) >= 35)"


def completed(x: str) -> str:
    """CTE bodies turning ``src(id, raw)`` into ``done(id, t)``."""
    return f"""
cl AS (SELECT id, {clean_answer(x)} AS c FROM src),
cl2 AS (SELECT id, {strip(f"regexp_extract(c, '(?s)^(.*[.!?;:])(?:{S}|$)', 1)")} AS sentence,
        list_filter(list_transform(regexp_split_to_array(c, '[{EOL}]'), lambda x: {strip('x')}), lambda x: x <> '') AS ln FROM cl),
done AS (SELECT id, CASE WHEN len({words('sentence')}) >= 24 THEN sentence
   WHEN len(ln) > 1 AND len({words("array_to_string(ln[1:len(ln)-1], chr(10))")}) >= 24 THEN array_to_string(ln[1:len(ln)-1], chr(10))
   ELSE '' END AS t FROM cl2)"""


PAIRS = """
pairs AS (SELECT u.conv_id || ':' || u.turn AS qid, u.text AS question, a.text AS answer
          FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
          WHERE u.role = 'user' AND a.role = 'assistant'),
told AS (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS asked FROM conversations),
replies AS (SELECT conv_id, asked, text, row_number() OVER (PARTITION BY conv_id, asked ORDER BY turn) - 1 AS context
            FROM told WHERE role = 'assistant' AND asked IS NOT NULL),
ctx AS (SELECT u.conv_id || ':' || u.turn AS qid, u.text AS question, coalesce(r.context, 0) AS context, r.text
        FROM conversations u LEFT JOIN replies r ON r.conv_id = u.conv_id AND r.asked = u.turn WHERE u.role = 'user')
"""


def phrase(qw: str, joined: str, most: int, least: int) -> str:
    cases = " ".join(
        f"WHEN len(list_filter(range(1, greatest(len({qw}) - {n - 1}, 0) + 1), lambda i: "
        f"contains({joined}, ' ' || array_to_string({qw}[i:i+{n - 1}], ' ') || ' '))) > 0 THEN {n}"
        for n in range(most, least - 1, -1))
    return f"(CASE {cases} ELSE 0 END)"


SUPPORT = f"""
cw AS (SELECT qid, question, context, {toks('question')} AS qw, {toks('text')} AS tw, text FROM ctx),
ct AS (SELECT *, list_filter({distinct('qw')}, lambda x: len(x) > 1 AND NOT list_contains({STOP}, x)) AS terms FROM cw WHERE len(tw) > 0),
st AS (SELECT *, unnest(CASE WHEN ((len(tw) - 1) // 80) * 80 + 160 < len(tw) THEN list_append(range(0, len(tw), 80), len(tw) - 160)
        ELSE range(0, len(tw), 80) END) AS a FROM ct),
sw AS (SELECT *, tw[a+1:a+160] AS ws, ' ' || array_to_string(tw[a+1:a+160], ' ') || ' ' AS joined FROM st),
sc AS (SELECT *, len(list_filter(terms, lambda t: list_contains(ws, t))) AS matched, {phrase('qw', 'joined', 8, 2)} AS lp,
       len(terms) >= 2 AND contains(joined, ' ' || array_to_string(terms[1:2], ' ') || ' ') AS anchor FROM sw),
best AS (SELECT *, matched / greatest(len(terms), 1) AS coverage,
         round(matched / greatest(len(terms), 1) + lp * 0.02::DOUBLE + 0.10::DOUBLE / (context + 1), 9) AS score FROM sc
         QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, context, a) = 1),
support AS (SELECT q.qid, b.context::INT AS context, coalesce(a, 0)::INT AS window_start,
   coalesce(least(len(tw), a + 160), 0)::INT AS window_end,
   coalesce(matched, 0)::INT AS matched_terms, n_terms::INT AS question_terms, coalesce(lp, 0)::INT AS longest_phrase,
   coalesce(anchor, false) AS anchor_match,
   coalesce(n_terms >= 3 AND coverage >= 0.78 AND lp >= 3
     AND (anchor OR (regexp_matches(b.question, '(?i){wide(lx.DIRECT_ACTOR)}') AND coverage >= 0.80)), false) AS strong,
   round(coalesce(coverage, 0.0), 9)::DOUBLE AS coverage
 FROM (SELECT qid, len(list_filter({distinct('qw')}, lambda x: len(x) > 1 AND NOT list_contains({STOP}, x))) AS n_terms FROM cw
       QUALIFY row_number() OVER (PARTITION BY qid ORDER BY context) = 1) q LEFT JOIN best b USING (qid))
"""

ITEM = "^{S}*(?:[0-9]+|[a-zA-ZđĐ]{{1,2}})[.)]{S}+".format(S=S)
ANY_ITEM = "^{S}*(?:(?:[0-9]+|[a-zA-ZđĐ]{{1,2}})[.)]{S}+|[-*•●]{S}+)".format(S=S)

SQL = {
    "clean_answer": f"SELECT doc_id, len(t)::BIGINT AS n_chars, sha256(t) AS text_sha FROM (SELECT doc_id, {clean_answer('text')} AS t FROM documents)",
    "answer_flags": f"""
        SELECT id, {strip('text')} = '' AS empty, regexp_matches(text, '{REFUSAL}') AS refusal,
               regexp_matches(text, '{ARTIFACT}') AS artifact,
               array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text,
                 '\\b[0-9]{{1,5}}(?:/[0-9]{{4}})?/[A-Za-zÀ-ỹĐđ0-9]+(?:-[A-Za-zÀ-ỹĐđ0-9]+)*\\b'), lambda x: lower(x)),
                 lambda x: regexp_matches(string_split(x, '/')[-1], '\\p{{L}}')))), ' ') AS unsupported
        FROM (SELECT 'doc ' || doc_id AS id, text FROM documents UNION ALL SELECT 'page ' || page_id, html FROM pages)""",
    "unfinished_lead_in": f"""
        SELECT doc_id, {strip('text')} = '' OR suffix(rtrim(text, '{lx.WS_CHARS}'), ':')
          OR regexp_matches(text, '(?i){wide(lx.LEAD_IN)}') AS unfinished FROM documents""",
    "repetition_ratio": f"""
        SELECT doc_id, CASE WHEN len(l) > 0 THEN round((len(l) - len(list_distinct(l))) / len(l), 9) ELSE 0.0 END::DOUBLE AS ratio
        FROM (SELECT doc_id, {LONG} AS l FROM documents)""",
    "completed_prefix": select(["src AS (SELECT doc_id AS id, text FROM documents)", completed("text")],
                               "SELECT id AS doc_id, len(t)::BIGINT AS n_chars, sha256(t) AS text_sha FROM done"),
    "line_loops": f"""
        WITH l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[\\r\\n]+'), lambda x: {strip('x')}), lambda x: x <> '') AS p FROM documents),
        u AS (SELECT doc_id, unnest(p) AS v, generate_subscripts(p, 1) AS i FROM l),
        g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, v ORDER BY i) AS island FROM u),
        r AS (SELECT doc_id, v, min(i) AS first_line, count(*) AS copies FROM g GROUP BY doc_id, v, island)
        SELECT doc_id, (count(*) FILTER (copies >= 3 AND len(v) >= 60 AND len({words('v')}) >= 8) OVER (PARTITION BY doc_id))::INT AS removable,
               first_line::INT AS first_line, copies::INT AS copies, sha256(v) AS line_sha FROM r QUALIFY copies >= 2""",
    "numbered_loops": f"""
        WITH u AS (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM (
               SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\r\\n]+'), lambda x: x <> '') AS p FROM documents)),
        k AS (SELECT doc_id, i, CASE WHEN regexp_matches(x, '{ITEM}') THEN {strip(f"regexp_replace(regexp_replace(x, '{ANY_ITEM}', ''), '[{WS}]+', ' ', 'g')")} END AS v FROM u),
        g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, v ORDER BY i) AS island FROM k WHERE v IS NOT NULL),
        r AS (SELECT doc_id, v, count(*) AS c FROM g GROUP BY doc_id, v, island)
        SELECT d.doc_id, coalesce(sum(c), 0)::BIGINT AS n_items,
               count(*) FILTER (c >= 6 AND len(v) >= 25 AND len({words('v')}) >= 5) AS n_loops
        FROM documents d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id""",
    "local_evidence_support": select([PAIRS, SUPPORT], """SELECT qid, context, window_start, window_end, matched_terms,
        question_terms, longest_phrase, anchor_match, strong, coverage FROM support"""),
    "shared_phrase": select([PAIRS], f"""SELECT qid AS id, {phrase('q', 'a', 8, 2)}::INT AS words FROM (
        SELECT qid, {toks('question')} AS q, ' ' || array_to_string({toks('answer')}, ' ') || ' ' AS a FROM pairs)"""),
    "citation_conflict": select([PAIRS], """
        SELECT qid, false AS conflict, NULL::INT AS conflicting_context_index, 0 AS copied_phrase_words FROM pairs"""),
    "extractive_fallback": select([PAIRS, SUPPORT, f"""
        pick AS (SELECT s.qid, c.text, len({toks('c.text')}) AS n,
           least(len({toks('c.text')}), greatest(0, s.window_start - 105) + 420) AS e FROM support s LEFT JOIN ctx c USING (qid, context)),
        cutp AS (SELECT qid, n, CASE WHEN n <= 420 THEN text ELSE regexp_replace(array_to_string(
           regexp_extract_all(text, '[^\\p{{L}}\\p{{N}}]*[\\p{{L}}\\p{{N}}]+')[greatest(0, e - 420) + 1:e], ''), '^[^\\p{{L}}\\p{{N}}]+', '') END AS x FROM pick),
        ans AS (SELECT qid, CASE WHEN n >= 24 THEN {clean_answer('x')} ELSE '{lx.NO_EVIDENCE}' END AS a FROM cutp)"""],
        "SELECT qid, len(a)::BIGINT AS n_chars, sha256(a) AS answer_sha FROM ans"),
    "focused_contexts": select([PAIRS, SUPPORT], """
        SELECT c.qid, c.context::INT AS context FROM ctx c JOIN support s USING (qid)
        WHERE s.context IS NOT NULL OR c.context = 0"""),
    "route_decision": select([PAIRS, SUPPORT, "src AS (SELECT qid AS id, answer FROM pairs)", completed("answer")], f"""
        SELECT qid, CASE WHEN NOT regexp_matches(answer, '[.!?]$') AND NOT bad AND NOT refusal AND t <> '' THEN 'generated_truncated'
            WHEN NOT regexp_matches(answer, '[.!?]$') AND NOT bad AND NOT refusal THEN 'source_fallback'
            WHEN bad OR (refusal AND strong) THEN 'source_fallback' WHEN refusal THEN 'generated_refusal' ELSE 'generated' END AS route
        FROM (SELECT p.qid, answer, t, strong, regexp_matches(answer, '{REFUSAL}') AS refusal,
                {strip('answer')} = '' OR regexp_matches(answer, '{ARTIFACT}') AS bad
              FROM pairs p JOIN support USING (qid) JOIN done ON done.id = p.qid)"""),
}
