"""Twins of the record queries."""

from oracle.answers import PAIRS
from oracle.base import select, words

IDS = "list_transform({w}, lambda x: ascii(x))"

STEPS = """
WITH RECURSIVE r AS (SELECT user_id AS id, event_type = 'purchase' AS accepted, event_type = 'error' AS faulty, event_type IN ('view', 'click') AS hit,
                       row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
walk AS (SELECT DISTINCT user_id AS id, 0 AS n, 'open' AS status, 2048 AS budget, false AS focused FROM events
  UNION ALL
  SELECT w.id, n + 1,
    CASE WHEN accepted THEN 'accepted' WHEN n < 3 AND ((faulty AND NOT focused) OR (NOT faulty AND hit AND budget < 4096)) THEN 'open' ELSE 'unresolved' END,
    CASE WHEN NOT accepted AND NOT faulty AND hit AND n < 3 AND budget < 4096 THEN budget + 1024 ELSE budget END,
    focused OR (NOT accepted AND faulty AND n < 3)
  FROM walk w JOIN r ON r.id = w.id AND r.k = n + 1 WHERE status = 'open'),
final AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC) = 1)
SELECT id, n::INT AS attempts, status, budget::INT AS budget, focused, 0::INT AS waiting,
       (CASE WHEN status = 'open' THEN 0 ELSE (SELECT count(*) FROM r WHERE r.id = final.id) - n END)::INT AS ignored FROM final"""

SQL = {
    "attempt_stream": STEPS,
    "attempt_history": STEPS,
    "id_set_diff": """
        SELECT doc_id AS id, 'missing' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
        UNION ALL SELECT DISTINCT doc_id, 'extra' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
    "subset_check": """
        SELECT 'labels' AS part, count(*) AS n, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM documents)) AS missing,
          count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM documents)) = 0 AS is_subset FROM (SELECT DISTINCT doc_id FROM labels) UNION ALL
        SELECT 'documents', count(*), count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)),
          count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) = 0 FROM (SELECT DISTINCT doc_id FROM documents)""",
    "snapshot_check": """
        WITH p AS (SELECT page_id, page_id % 16 AS kind, 'part-' || (page_id // 64) AS archive, 'pages/' || page_id || '.html' AS plain, coalesce(html, '') AS html FROM pages)
        SELECT archive, '../' || plain AS path, 'unsafe' AS problem FROM p WHERE kind = 1 UNION ALL
        SELECT archive, plain, CASE kind WHEN 0 THEN 'missing' WHEN 1 THEN 'missing' WHEN 2 THEN 'size' WHEN 3 THEN 'hash' ELSE 'unlisted' END
        FROM p WHERE kind <= 4 AND (kind <> 3 OR html <> reverse(html))""",
    "record_stream": "SELECT doc_id, source, sha256(text) AS text_sha FROM documents",
    "leak_check": "SELECT doc_id AS id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "journal_pending": """SELECT o_orderkey AS id FROM orders
        WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')""",
    "journal_stream": "SELECT event_id, any_value(user_id) AS user_id, any_value(event_type) AS event_type, any_value(value) AS value FROM events GROUP BY event_id",
    "next_attempts": """
        SELECT user_id AS id, CASE WHEN event_type = 'error' THEN CASE WHEN value < 20 THEN 2048 ELSE 3072 END
                 ELSE CASE WHEN value < 20 THEN 3072 ELSE 4096 END END::INT AS budget, event_type = 'error' AS focused
        FROM events WHERE event_type <> 'purchase' AND event_id IN (SELECT max(event_id) FROM events GROUP BY user_id)""",
    "prompt_messages": select([PAIRS], """
        SELECT qid, count(text)::INT AS n_texts, sha256('Ngữ cảnh pháp luật:' || chr(10) || coalesce(string_agg(
          'Trích đoạn ' || (context + 1) || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY context) FILTER (text IS NOT NULL), '')
          || chr(10) || chr(10) || 'Câu hỏi: ' || any_value(question) || chr(10) || chr(10) || 'Câu trả lời:') AS content_sha
        FROM ctx GROUP BY qid"""),
    "training_examples": select([PAIRS, f"""
        t AS (SELECT qid AS id, {IDS.format(w=words('question'))} AS p, list_append({IDS.format(w=words('answer'))}, 2) AS a FROM pairs),
        r AS (SELECT *, least(200, 400 - len(a)) AS room FROM t),
        s AS (SELECT *, CASE WHEN room < 100 THEN 'full reference does not fit without losing the context'
               WHEN len(p) = 0 THEN 'no retrieved context' WHEN len(p) > room THEN 'prompt exceeds its budget' END AS skipped FROM r)"""],
        """SELECT id, skipped, CASE WHEN skipped IS NULL THEN len(p) + len(a) ELSE 0 END::BIGINT AS n_tokens,
           CASE WHEN skipped IS NULL THEN list_sum(p) + list_sum(a) ELSE 0 END::BIGINT AS id_sum,
           CASE WHEN skipped IS NULL THEN list_sum(a) - 100 * len(p) ELSE 0 END::BIGINT AS label_sum FROM s"""),
    "padded_batches": select([PAIRS, f"""
        t AS (SELECT qid AS id, {IDS.format(w=words('question'))} AS p, list_append({IDS.format(w=words('answer'))}, 2) AS a FROM pairs),
        u AS (SELECT id, list_concat(p, a) AS x, len(p) AS np, list_sum(a) AS sa, len(p) + len(a) AS n FROM t
              WHERE len(p) > 0 AND least(2048, 4096 - len(a)) >= 512 AND len(p) <= least(2048, 4096 - len(a))),
        r AS (SELECT *, row_number() OVER (ORDER BY n, id) - 1 AS place FROM u),
        b AS (SELECT *, place // 16 AS batch, max(n) OVER (PARTITION BY place // 16) AS width FROM r)"""],
        """SELECT id, batch, (place % 16)::INT AS slot, width::INT AS width, (width - n)::INT AS padding,
           (list_sum(x) + width - n)::BIGINT AS id_sum, n::BIGINT AS mask_sum, (sa - 100 * (np + width - n))::BIGINT AS label_sum FROM b"""),
}
