"""Twins of the retrieval queries."""

from oracle.base import (BOOSTED, BROAD, CORPUS, GRAMS, PHRASES, POSTINGS, PRECISE, QUESTIONS, RANKED, STOP, YEARS,
                         distinct, fold, fused, loaded_grams, pool, select, toks)

LEX = ("bm25", "bm25_phrases", "bm25_precise")
FUSED = [*RANKED, fused(LEX)]
POOLED = [*FUSED, pool(24), BOOSTED]

DENSE = """
dense AS (
  SELECT qid, chunk_id, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT b.item_id AS qid, v.vec_id, v.vec_id * 16777216 AS chunk_id,
           round(list_inner_product(qv.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score
    FROM benchmark b JOIN embeddings qv ON qv.vec_id = b.item_id CROSS JOIN embeddings v)
  QUALIFY rank <= 100)
"""

PICKED = """
picked AS (
  SELECT 'bm25' AS stage, qid, chunk_id, rank FROM bm25 UNION ALL
  SELECT 'bm25_phrases', qid, chunk_id, rank FROM bm25_phrases UNION ALL
  SELECT 'bm25_precise', qid, chunk_id, rank FROM bm25_precise UNION ALL
  SELECT 'rrf', qid, chunk_id, rank FROM fused)
"""

#: Questions and the queries that a rule adds to them, under even and odd numbers.
ADDED = QUESTIONS.replace("SELECT item_id AS qid, text AS question,", """SELECT id AS qid, text AS question,""").replace(
    "FROM benchmark)", f"""FROM (SELECT item_id * 2 AS id, text FROM benchmark UNION ALL
  SELECT item_id * 2 + 1, 'with that for have this' FROM benchmark
  WHERE (contains({fold("text")}, 'the') OR contains({fold("text")}, 'der')) AND (contains({fold("text")}, 'and') OR contains({fold("text")}, 'und'))))""")

_ALL = [(f"{p}{b}", b, odd) for odd, p in ((0, ""), (1, "intent_")) for b in LEX]


def _fused_of(name: str, branches) -> str:
    total = " + ".join(["0.0::DOUBLE"] + [
        f"coalesce(1.0::DOUBLE / (60 + min(CASE WHEN branch = '{b}' THEN rank END)), 0.0::DOUBLE)" for b in branches])
    return f"""
{name} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, chunk_id) AS rank FROM (
  SELECT qid, chunk_id, {total} AS rrf FROM listed WHERE branch IN ({', '.join(f"'{b}'" for b in branches)}) GROUP BY qid, chunk_id))"""


def _variant(name: str, source: str, limit: int, weight: float = 2.0, scope: float = 0.0) -> str:
    return f"""
  SELECT '{name}' AS variant, qid, chunk_id, parent_id, place, {weight}::DOUBLE AS weight, {scope}::DOUBLE AS scope FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS place FROM (
      SELECT f.*, parent_id, row_number() OVER (PARTITION BY qid, parent_id ORDER BY rank) AS pn FROM {source} f JOIN chunks USING (chunk_id)) WHERE pn <= 2)
  WHERE place <= {limit}"""


def _foreign(body: str, question: str) -> str:
    return "(" + " OR ".join(f"(contains({body}, '{m}') AND NOT contains({fold(question)}, '{m}'))" for m in ("tion", "heit")) + ")"


GRID = select([
    CORPUS, ADDED, *RANKED[2:],
    "listed AS (" + " UNION ALL ".join(f"SELECT '{n}' AS branch, qid // 2 AS qid, chunk_id, rank FROM {b} WHERE qid % 2 = {odd}" for n, b, odd in _ALL) + ")",
    _fused_of("plain", LEX), _fused_of("wide", [n for n, _, _ in _ALL]),
    "pools AS (" + " UNION ALL ".join([_variant("base", "plain", 24), _variant("pool_64", "plain", 64), _variant("weight_1", "plain", 24, 1.0),
                                       _variant("scope", "plain", 24, 2.0, 0.75), _variant("intent", "wide", 24)]) + ")",
    f"""
seen AS (SELECT p.*, {fold("c.header || chr(10) || c.text")} AS body, b.text AS question, {toks("b.text")} AS t
         FROM pools p JOIN chunks c USING (chunk_id) JOIN benchmark b ON b.item_id = p.qid),
facts AS (SELECT *, list_filter({distinct("t")}, lambda x: len(x) > 1 AND NOT list_contains({STOP}, x)) AS terms, {loaded_grams("t", 3)} AS grams,
          {YEARS.format(x="question")} AS ys FROM seen),
weighed AS (SELECT *, weight * (len(list_filter(terms, lambda x: list_contains({toks("body")}, x))) / greatest(len(terms), 1))
   + CASE WHEN len(list_filter(ys, lambda y: contains(body, y))) > 0 THEN 1.0::DOUBLE ELSE 0 END
   + CASE WHEN len(list_filter(grams, lambda g: contains(body, g))) > 0 THEN 1.0::DOUBLE ELSE 0 END
   - CASE WHEN {_foreign("body", "question")} THEN scope ELSE 0 END AS adjustment FROM facts),
final AS (SELECT *, round(4.0::DOUBLE / (1.0 + (place - 1) / 8.0) + adjustment, 9) AS score FROM weighed)"""],
    """SELECT variant, qid, chunk_id, parent_id, row_number() OVER (PARTITION BY variant, qid ORDER BY score DESC, chunk_id)::INT AS place,
       round(score, 6) AS final_score FROM final""")

SQL = {
    "variant_grid": GRID,
    "stored_rankings": select(RANKED, """
        SELECT 'bm25' AS branch, qid, chunk_id, 0 AS level, rank::INT AS rank, round(score, 6) AS score FROM bm25 UNION ALL
        SELECT 'bm25_phrases', qid, chunk_id, 0, rank::INT, round(score, 6) FROM bm25_phrases UNION ALL
        SELECT 'bm25_precise', qid, chunk_id, level::INT, rank::INT, round(score, 6) FROM bm25_precise"""),
    "batch_retrieval": select(POOLED, f"""
        SELECT item_id AS qid, text AS question, {', '.join(f"coalesce((SELECT string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY {r}) FROM {t} x WHERE x.qid = item_id), '') AS {n}"
            for n, t, r in (('bm25', 'bm25', 'rank'), ('bm25_phrases', 'bm25_phrases', 'rank'), ('bm25_precise', 'bm25_precise', 'rank'), ('rrf', 'fused', 'rank'), ('reranked', 'final', 'final_place')))},
          coalesce((SELECT string_agg(parent_id, ',' ORDER BY place) FROM (
            SELECT qid, parent_id, min(final_place) AS place, row_number() OVER (PARTITION BY qid ORDER BY min(final_place)) AS k FROM final GROUP BY qid, parent_id) x
            WHERE x.qid = item_id AND k <= 4), '') AS contexts
        FROM benchmark"""),
    "retrieval_cache_checks": """
        SELECT c.name AS "check", count(*) AS n, min(doc_id) AS first_qid
        FROM documents JOIN (VALUES (0, 'missing'), (1, 'question'), (2, 'models'), (3, 'retrieval'), (4, 'code'), (5, 'mode'), (6, 'mode_config'), (7, 'index')) c(k, name)
          ON doc_id % 20 = c.k
        WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY c.name""",
    "bm25_topk": select([CORPUS, QUESTIONS, POSTINGS, BROAD],
                        "SELECT qid, chunk_id, rank::INT AS rank, round(score, 6) AS score FROM bm25"),
    "bm25_phrases": select([CORPUS, QUESTIONS, GRAMS, PHRASES],
                           "SELECT qid, chunk_id, rank::INT AS rank, round(score, 6) AS score FROM bm25_phrases"),
    "bm25_precise": select([CORPUS, QUESTIONS, POSTINGS, PRECISE],
                           "SELECT qid, chunk_id, level::INT AS level, rank::INT AS rank, round(score, 6) AS score FROM bm25_precise"),
    "rrf_fusion": select(FUSED, "SELECT qid, chunk_id, rank::INT AS rank, round(rrf, 9) AS rrf FROM fused"),
    "diversified_pool": select([*FUSED, pool(32)],
                               "SELECT qid, chunk_id, parent_id, place::INT AS rank FROM pool"),
    "retrieval_boosts": select(POOLED, """SELECT qid, chunk_id, round(coverage, 9) AS coverage,
        round(adjustment, 9) AS adjustment FROM boosted"""),
    "lexical_retrieval": select(POOLED, """SELECT qid, chunk_id, parent_id, final_place::INT AS place,
        round(final_score, 6) AS final_score FROM final"""),
    "context_materialize": select(POOLED, """
        SELECT qid, parent_id, chunk_id AS seed_chunk_id, ctx::INT AS context, ws::INT AS window_start,
               (ws + n)::INT AS window_end, (start_at - ws)::INT AS seed_start,
               (start_at + len(text) - ws)::INT AS seed_end, sha256(body_text) AS text_sha
        FROM (SELECT b.*, d.text AS body_text, len(d.text) AS n,
                     0 AS ws
              FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY final_place) - 1 AS ctx
                    FROM (SELECT * FROM final QUALIFY row_number() OVER (PARTITION BY qid, parent_id ORDER BY final_place) = 1)) b
              JOIN docs d ON d.doc_id = b.chunk_id // 16777216 WHERE ctx < 4)"""),
    "dense_knn": select([DENSE], "SELECT qid, vec_id, rank::INT AS rank, round(score, 6) AS score FROM dense"),
    "same_document_contexts": select([DENSE, """
        near AS (SELECT qid, rank - 1 AS context, d.vec_id AS id, CAST(label AS VARCHAR) AS doc_id FROM dense d JOIN embeddings USING (vec_id)),
        own AS (SELECT n.* FROM near n JOIN near t ON t.qid = n.qid AND t.context = 0 AND t.doc_id = n.doc_id)"""],
        "SELECT qid, context::INT AS context, id, doc_id FROM own QUALIFY row_number() OVER (PARTITION BY qid ORDER BY context) <= 3"),
    "spliced_pool": select([DENSE, """
        even AS (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM dense WHERE vec_id % 2 = 0),
        reserve AS (SELECT * FROM even WHERE rank BETWEEN 6 AND 9),
        sizes AS (SELECT qid, count(*) AS n FROM reserve GROUP BY qid),
        parts AS (SELECT d.qid, vec_id, CASE WHEN rank <= 16 - coalesce(n, 0) THEN 0 ELSE 2 END AS part, rank FROM dense d LEFT JOIN sizes s ON s.qid = d.qid WHERE rank <= 20
                  UNION ALL SELECT qid, vec_id, 1, rank FROM reserve),
        firsts AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY qid, vec_id ORDER BY part, rank) = 1)"""],
        """SELECT qid, vec_id AS chunk_id, place::INT AS rank, part = 1 AS from_reserve
           FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY part, rank) AS place FROM firsts) WHERE place <= 16"""),
    "hybrid_fusion": select([*RANKED, DENSE, fused((*LEX, "dense"))],
                            "SELECT qid, chunk_id, rank::INT AS rank, round(rrf, 9) AS rrf FROM fused"),
    "hybrid_retrieval": select(
        [*RANKED, DENSE.replace("CROSS JOIN embeddings v)", "CROSS JOIN embeddings v WHERE v.vec_id IN (SELECT doc_id FROM kept))"),
         fused((*LEX, "dense")), pool(32), BOOSTED],
        """SELECT qid, chunk_id, parent_id, final_place::INT AS place, round(final_score, 6) AS final_score FROM final"""),
    "answer_token_coverage": select([*FUSED, PICKED], f"""
        SELECT stage, k::INT AS k, round(sum(hit / n) / (SELECT count(*) FROM benchmark), 9) AS coverage FROM (
          SELECT stage, k, qid, sum(least(found, wanted)) AS hit, any_value(n) AS n FROM (
            SELECT stage, k, qid, tok, count(*) AS found FROM (
              SELECT stage, k, qid, unnest({toks("header || ' ' || text")}) AS tok
              FROM picked JOIN chunks USING (chunk_id), (VALUES (1), (5), (20)) ks(k) WHERE rank <= k)
            GROUP BY ALL) JOIN (
            SELECT qid, tok, count(*) AS wanted, any_value(n) AS n FROM (SELECT qid, len(t) AS n, unnest(t) AS tok FROM q) GROUP BY qid, tok)
            USING (qid, tok) GROUP BY stage, k, qid)
        GROUP BY stage, k"""),
}
