"""Building blocks of the DuckDB twins: the same results written independently in plain SQL."""

from quillsift.functions import lexicon as lx

WS = lx.WS
TRIM = "'" + lx.WS_CHARS + "'"
EOL = lx.EOL
STOP = "[" + ", ".join(f"'{w}'" for w in lx.STOP_WORDS) + "]"


def fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def toks(x: str) -> str:
    return f"regexp_extract_all({fold(x)}, '[\\p{{L}}\\p{{N}}]+')"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '[^{WS}]+')"


def strip(x: str) -> str:
    return f"trim({x}, {TRIM})"


def clean(x: str) -> str:
    out = f"replace(coalesce({x}, ''), chr(13), chr(10))"
    out = f"regexp_replace({out}, '[ \\t]+', ' ', 'g')"
    out = f"regexp_replace({out}, '\\n[ \\t]*\\n(?:[ \\t]*\\n)+', chr(10) || chr(10), 'g')"
    return strip(out)


def distinct(lst: str) -> str:
    """First occurrences in order."""
    return f"list_filter({lst}, lambda x, i: list_position({lst}, x) = i)"


def loaded_grams(t: str, n: int) -> str:
    return (f"list_transform(list_filter(range(1, greatest(len({t}) - {n - 1}, 0) + 1), lambda i: "
            f"len(list_filter({t}[i:i+{n - 1}], lambda w: NOT list_contains({STOP}, w))) >= 2), "
            f"lambda i: array_to_string({t}[i:i+{n - 1}], ' '))")


CORPUS = f"""
docs AS (SELECT doc_id, source, {clean('text')} AS text FROM documents),
kept AS (SELECT * FROM docs WHERE text <> ''
         QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1),
spaced AS (SELECT doc_id, source, {words('text')} AS w, regexp_extract_all(text, '[{WS}]+') AS s FROM kept),
cuts AS (SELECT *, unnest(range(0, len(w), 256)) AS a FROM spaced),
chunks AS (
  SELECT doc_id * 16777216 + a // 256 AS chunk_id, doc_id || ':0' AS parent_id, doc_id, source AS header,
         len(array_to_string(w[1:a], '')) + len(array_to_string(s[1:a], '')) AS start_at,
         array_to_string(list_transform(range(a + 1, least(a + 320, len(w)) + 1),
            lambda i: w[i] || CASE WHEN i < least(a + 320, len(w)) THEN s[i] ELSE '' END), '') AS text
  FROM cuts WHERE a = 0 OR a + 64 < len(w)),
fields AS (SELECT chunk_id, {toks('header')} AS h, {toks('text')} AS t FROM chunks),
lens AS (SELECT chunk_id, len(h) + len(t) AS len FROM fields),
corpus_size AS (SELECT count(*) AS n, sum(len) / count(*) AS avg_len FROM lens)
"""

QUESTIONS = f"""
q AS (SELECT item_id AS qid, text AS question, {toks('text')} AS t FROM benchmark),
qterms AS (SELECT qid, t, list_filter({distinct('t')}, lambda x: len(x) > 1 AND NOT list_contains({STOP}, x)) AS terms
           FROM q)
"""

POSTINGS = """
occ AS (SELECT chunk_id, unnest(h) AS tok, 2.5 AS w FROM fields
        UNION ALL SELECT chunk_id, unnest(t) AS tok, 1.0 AS w FROM fields),
tf AS (SELECT chunk_id, tok, sum(w)::DOUBLE AS f FROM occ
       WHERE tok IN (SELECT unnest(t) FROM q) GROUP BY ALL),
df AS (SELECT tok, count(*) AS df FROM tf GROUP BY tok)
"""

GRAMS = """
runs AS (SELECT chunk_id, 2.5 AS w, h AS t FROM fields UNION ALL SELECT chunk_id, 1.0, t FROM fields),
gram_occ AS (
  SELECT chunk_id, w, unnest(list_transform(range(1, greatest(len(t) - 2, 0) + 1), lambda i: array_to_string(t[i:i+2], ' '))) AS tok FROM runs
  UNION ALL
  SELECT chunk_id, w, unnest(list_transform(range(1, greatest(len(t) - 3, 0) + 1), lambda i: array_to_string(t[i:i+3], ' '))) AS tok FROM runs),
qgrams AS (SELECT qid, unnest(g) AS tok FROM (SELECT qid, {D} AS g FROM (SELECT qid, {G} AS gs FROM q))),
gram_tf AS (SELECT chunk_id, tok, sum(w)::DOUBLE AS f FROM gram_occ WHERE tok IN (SELECT tok FROM qgrams) GROUP BY ALL),
gram_df AS (SELECT tok, count(*) AS df FROM gram_tf GROUP BY tok)
""".replace("{D}", distinct("gs")).replace(
    "{G}", f"list_concat({loaded_grams('t', 4)}, {loaded_grams('t', 3)})")


def bm25(n="n", df="df", f="f", length="len", avg="avg_len") -> str:
    idf = f"ln(({n} - {df} + 0.5) / ({df} + 0.5))"
    return (f"(CASE WHEN {idf} > 0 THEN {idf} ELSE 1e-6 END) * {f} * 2.2 "
            f"/ ({f} + 1.2 * (0.25 + 0.75 * {length} / {avg}))")


BROAD = f"""
broad_scores AS (
  SELECT qid, tf.chunk_id, round(sum({bm25()}), 9) AS score
  FROM (SELECT qid, unnest({distinct('t')}) AS tok FROM q) qq
  JOIN tf USING (tok) JOIN df USING (tok) JOIN lens USING (chunk_id) CROSS JOIN corpus_size
  GROUP BY qid, tf.chunk_id),
bm25 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank
         FROM broad_scores QUALIFY rank <= 100)
"""

PHRASES = f"""
phrase_scores AS (
  SELECT qid, gram_tf.chunk_id, round(sum({bm25()}), 9) AS score
  FROM qgrams JOIN gram_tf USING (tok) JOIN gram_df USING (tok) JOIN lens USING (chunk_id) CROSS JOIN corpus_size
  GROUP BY qid, gram_tf.chunk_id),
bm25_phrases AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank
                 FROM phrase_scores QUALIFY rank <= 40)
"""

PRECISE = f"""
ordered AS (SELECT qid, len(terms) AS n_terms, list_transform(list_sort(list_transform(terms, lambda x, i: (-len(x), i, x))),
                   lambda z: z[3]) AS o FROM qterms WHERE len(terms) >= 3),
wanted AS (SELECT qid, n_terms, unnest(o) AS tok, generate_subscripts(o, 1) AS r FROM ordered),
matched AS (
  SELECT qid, n_terms, tf.chunk_id, r, {bm25()} AS s
  FROM wanted JOIN tf USING (tok) JOIN df USING (tok) JOIN lens USING (chunk_id) CROSS JOIN corpus_size WHERE r <= 12),
levels AS (
  SELECT qid, m.chunk_id, lv, count(*) AS c, sum(s) AS s, any_value(n_terms) AS n_terms
  FROM matched m, (VALUES (0, 12), (1, 8), (2, 5)) l(lv, width) WHERE r <= width GROUP BY qid, m.chunk_id, lv),
strict AS (SELECT qid, chunk_id, lv AS level, round(s, 9) AS score FROM levels
           WHERE c >= least(CASE lv WHEN 0 THEN 12 WHEN 1 THEN 8 ELSE 5 END, n_terms)
           QUALIFY row_number() OVER (PARTITION BY qid, chunk_id ORDER BY lv) = 1),
bm25_precise AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY level, score DESC, chunk_id) AS rank
                 FROM strict QUALIFY rank <= 40)
"""

RANKED = [CORPUS, QUESTIONS, POSTINGS, GRAMS, BROAD, PHRASES, PRECISE]


def fused(branches, name="fused") -> str:
    union = " UNION ALL ".join(f"SELECT '{b}' AS branch, qid, chunk_id, rank FROM {b}" for b in branches)
    total = " + ".join(["0.0::DOUBLE"] + [
        f"coalesce(1.0::DOUBLE / (60 + min(CASE WHEN branch = '{b}' THEN rank END)), 0.0::DOUBLE)" for b in branches])
    return f"""
{name} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, chunk_id) AS rank FROM (
  SELECT qid, chunk_id, {total} AS rrf FROM ({union}) GROUP BY qid, chunk_id))"""


def pool(limit: int, source="fused", name="pool") -> str:
    return f"""
{name} AS (SELECT qid, chunk_id, rrf, parent_id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS place FROM (
   SELECT f.*, parent_id, row_number() OVER (PARTITION BY qid, parent_id ORDER BY rank) AS pn
   FROM {source} f JOIN chunks USING (chunk_id)) WHERE pn <= 2 QUALIFY place <= {limit})"""


YEARS = "list_filter(regexp_extract_all({x}, '[0-9]+'), lambda y: len(y) = 4 AND y[1:2] IN ('19', '20'))"

BOOSTED = f"""
cand AS (SELECT p.*, c.header, c.text, c.start_at, {fold("c.header || chr(10) || c.text")} AS body FROM pool p JOIN chunks c USING (chunk_id)),
facts AS (SELECT qid, terms, {loaded_grams('t', 3)} AS grams, {YEARS.format(x='question')} AS ys
          FROM qterms JOIN q USING (qid, t)),
boosted AS (
  SELECT cand.*, len(list_filter(terms, lambda x: list_contains({toks('body')}, x))) / greatest(len(terms), 1) AS coverage,
         2.0::DOUBLE * coverage
         + CASE WHEN len(list_filter(ys, lambda y: contains(body, y))) > 0 THEN 1.0::DOUBLE ELSE 0 END
         + CASE WHEN len(list_filter(grams, lambda g: contains(body, g))) > 0 THEN 1.0::DOUBLE ELSE 0 END AS adjustment
  FROM cand JOIN facts USING (qid)),
final AS (
  SELECT *, 4.0::DOUBLE / (1.0 + (place - 1) / 8.0) AS score, round(score + adjustment, 9) AS final_score,
         row_number() OVER (PARTITION BY qid ORDER BY final_score DESC, chunk_id) AS final_place
  FROM boosted)
"""


def select(ctes, body: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body
