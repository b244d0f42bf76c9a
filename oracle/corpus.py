"""Twins of the corpus queries."""

from oracle.base import CORPUS, EOL, STOP, WS, YEARS, distinct, fold, select, strip, toks, words

LINES = f"""
ls AS (SELECT doc_id, list_filter(list_transform(list_filter(string_split(text, chr(10)), lambda x: len(x) > 0),
         lambda x, i: (i - 1, {strip('x')})), lambda z: z[2] <> '') AS p FROM docs),
parents AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) - 1 AS position FROM ls),
lines AS (SELECT doc_id || ':' || piece[1] AS parent_id, doc_id, piece[1]::INT AS ordinal,
                 position::INT AS position, len(piece[2])::BIGINT AS n_chars FROM parents)
"""

SQL = {
    "token_stats": f"""
        SELECT lang, count(*) AS n_docs, sum(len(t))::BIGINT AS n_tokens,
               (SELECT count(DISTINCT x) FROM (SELECT unnest({toks('text')}) AS x FROM documents d WHERE d.lang = o.lang)) AS n_distinct
        FROM (SELECT lang, {toks('text')} AS t FROM documents) o GROUP BY lang""",
    "content_terms": f"""
        SELECT doc_id, len(k)::BIGINT AS n_terms, sha256(array_to_string(k, ' ')) AS terms_sha FROM (
          SELECT doc_id, list(tok ORDER BY pos) FILTER (tok IS NOT NULL) AS k0, coalesce(k0, []) AS k FROM (
            SELECT d.doc_id, tok, min(pos) AS pos FROM documents d LEFT JOIN (
              SELECT doc_id, unnest(t) AS tok, generate_subscripts(t, 1) AS pos FROM (SELECT doc_id, {toks('text')} AS t FROM documents)) u
              ON u.doc_id = d.doc_id AND len(tok) > 1 AND NOT list_contains({STOP}, tok)
            GROUP BY d.doc_id, tok) GROUP BY doc_id)""",
    "word_counts": f"""
        SELECT doc_id, len({words('text')})::BIGINT AS n_words,
               len(list_filter(list_transform(regexp_split_to_array(text, '[{EOL}]'), lambda x: {strip('x')}), lambda x: len(x) >= 35))::BIGINT AS n_long_lines,
               list_max(list_transform({YEARS.format(x='text')}, lambda y: y::INT)) AS latest_year
        FROM documents""",
    "clean_documents": select([CORPUS], "SELECT doc_id, len(text)::BIGINT AS n_chars, sha256(text) AS text_sha FROM docs"),
    "passage_keys": f"""
        SELECT doc_id, sha256(rtrim({fold(strip(f"regexp_replace(nfc_normalize(text), '[{WS}]+', ' ', 'g')"))}, ' ?.!。')) AS group_sha
        FROM documents""",
    "dup_passages": select([CORPUS], """SELECT sha256(text) AS passage, min(doc_id) AS kept_id, count(*) - 1 AS dropped
        FROM docs WHERE text <> '' GROUP BY text"""),
    "corpus_report": select([CORPUS], """SELECT (SELECT count(*) FROM kept) AS documents,
        (SELECT count(*) FROM docs WHERE text <> '') - (SELECT count(*) FROM kept) AS duplicate_passages,
        (SELECT count(*) FROM docs WHERE text = '') AS empty_documents"""),
    "chunk_windows": select([CORPUS], """SELECT chunk_id, parent_id, start_at::INT AS start,
        (start_at + len(text))::INT AS "end", sha256(text) AS text_sha FROM chunks"""),
    "line_parents": select([CORPUS, LINES], "SELECT * FROM lines"),
    "adjacent_parents": select([CORPUS, LINES], """
        SELECT l.doc_id, l.parent_id, s.position AS seed_position, (l.position - s.position)::INT AS "offset"
        FROM (SELECT * FROM lines QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n_chars DESC, position) = 1) s
        JOIN lines l ON l.doc_id = s.doc_id AND abs(l.position - s.position) = 1"""),
}
