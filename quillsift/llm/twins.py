"""DuckDB twins of the operators on words, conversations and equal texts."""

from __future__ import annotations

#: CRC-32 of the UTF-8 bytes of {x}: the table of the reflected polynomial and one step per byte.
CRC = """
crc_table AS (SELECT list(v ORDER BY k) AS t FROM (
  SELECT k, list_reduce(range(0, 8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k) AS v
  FROM range(0, 256) r(k)))
"""


def crc32(x: str) -> str:
    raw = f"hex(encode({x}))"
    byte = f"16 * (instr('0123456789ABCDEF', {raw}[2 * i + 1]) - 1) + instr('0123456789ABCDEF', {raw}[2 * i + 2]) - 1"
    return (f"xor(list_reduce(list_transform(range(0, len({raw}) // 2), lambda i: {byte}), "
            f"lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295), 4294967295)")


SPELLING = f"""
WITH RECURSIVE {CRC.strip()},
runs AS (SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE len(run) >= 5 GROUP BY ALL),
hashed AS (SELECT run, k, {crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM runs, crc_table),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % len(run) AS BIGINT)) || substr(run, CAST(h % len(run) AS BIGINT) + 2) ELSE run END AS word, k FROM hashed),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM cut WHERE len(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
spots AS (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM words),
holes AS (SELECT word, n, i, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS hole, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM spots),
less AS (SELECT DISTINCT word, n, less FROM holes),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.hole = b.hole AND a.word <> b.word
         UNION ALL SELECT l.word, l.n, w.word, w.n FROM less l JOIN words w ON l.less = w.word
         UNION ALL SELECT w.word, w.n, l.word, l.n FROM less l JOIN words w ON l.less = w.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, struct_pack(a := -other_n, b := other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n
           FROM words w LEFT JOIN best USING (word)),
steps AS (SELECT word, word AS root FROM formed UNION ALL SELECT s.word, f.form FROM steps s JOIN formed f ON s.root = f.word WHERE f.form IS NOT NULL),
lasts AS (SELECT s.word, s.root FROM steps s JOIN formed f ON s.root = f.word WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN lasts USING (word)"""

BLANK = r"\x20\x09-\x0D"


def _least(*options: str) -> str:
    """The smallest (cost, audit) of cells that may be null."""
    return f"list_sort(list_filter([{', '.join(options)}], lambda o: o IS NOT NULL))[1]"


def _plus(cell: str, cost: str, letter: str, when: str = "true") -> str:
    return f"CASE WHEN {cell} IS NOT NULL AND {when} THEN {{'c': {cell}.c + {cost}, 'a': {cell}.a || '{letter}'}} END"


def _inserted(cell: str) -> str:
    """States after inserting messages: user from nothing, system or assistant, assistant from user."""
    c = lambda k: f"{cell}.{k}"
    once = {"q0": c("q0"), "q1": c("q1"),
            "q2": _least(c("q2"), *(_plus(c(k), "5", "I") for k in ("q0", "q1", "q3"))), "q3": _least(c("q3"), _plus(c("q2"), "5", "I"))}
    twice = once | {"q2": _least(once["q2"], _plus(c("q2"), "10", "II")), "q3": _least(once["q3"], *(_plus(c(k), "10", "II") for k in ("q0", "q1", "q3")))}
    return "{" + ", ".join(f"'{k}': {v}" for k, v in twice.items()) + "}"


def _row(cell: str, x: str) -> str:
    """States after a row: kept, given another role or deleted."""
    c = lambda k: f"{cell}.{k}"
    live, cost = f"{x}.m <> '-'", f"CASE WHEN {x}.late THEN 5 ELSE 0 END"
    keep = lambda k, initial: _plus(c(k), f"({cost})", "K", f"{live} AND {x}.m = '{initial}'")
    rerole = lambda k: _plus(c(k), f"(1 + {cost})", "R", live)
    drop = lambda k: _plus(c(k), "2", "D")
    states = {"q0": _least(drop("q0")), "q1": _least(drop("q1"), keep("q0", "s")),
              "q2": _least(drop("q2"), *(f(k) for k in ("q0", "q1", "q3") for f in (lambda k: keep(k, "u"), rerole))),
              "q3": _least(drop("q3"), keep("q2", "a"), rerole("q2"))}
    return "{" + ", ".join(f"'{k}': {v}" for k, v in states.items()) + "}"


CELL = "STRUCT(c BIGINT, a VARCHAR)"
STATES = f"STRUCT(q0 {CELL}, q1 {CELL}, q2 {CELL}, q3 {CELL})"

REPAIR = f"""
WITH RECURSIVE {CRC.strip()},
told AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
kinds AS (SELECT *, {crc32("key")} % 20 AS kind FROM told, crc_table),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
              CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
              unnest(range(0, CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS k FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again,
           regexp_extract(text, '([^{BLANK}])[{BLANK}]*$', 1) AS last FROM numbered),
faulty AS (SELECT *, CASE WHEN last = '' THEN 'b' WHEN again THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
             role[1] AS initial, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM seen),
convs AS (SELECT DISTINCT conv_id FROM conversations),
counted AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps,
              count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
              count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
              list(struct_pack(k := k, role := role, text := text, m := CASE WHEN fault IN ('b', 'd') THEN '-' ELSE initial END, late := fault = 't') ORDER BY k) AS rows
            FROM faulty GROUP BY conv_id),
walk AS (
  SELECT conv_id, 0 AS i, rows, CAST(row(row(0, ''), NULL, NULL, NULL) AS {STATES}) AS s FROM counted
  UNION ALL
  SELECT conv_id, i + 1, rows, CAST({_row("n", "x")} AS {STATES})
  FROM (SELECT conv_id, i, rows, rows[i + 1] AS x, CAST({_inserted("s")} AS {STATES}) AS n FROM walk WHERE i < len(rows))),
ended AS (SELECT conv_id, rows, CAST({_inserted("s")} AS {STATES}) AS s FROM walk WHERE i = len(rows)),
solved AS (SELECT conv_id, rows, {_least("s.q0", "s.q3")} AS best FROM ended),
steps AS (SELECT conv_id, rows, best.c AS cost, best.a AS audit, unnest(range(1, len(best.a) + 1)) AS p FROM solved),
edits AS (SELECT conv_id, p, substr(audit, p, 1) AS edit, rows[len(replace(substr(audit, 1, p), 'I', ''))] AS x,
            len(replace(substr(audit, 1, p), 'D', '')) AS place, coalesce(rows[nullif(instr(replace(audit, 'I', ''), 'K'), 0)].role, '') AS first_kept, audit FROM steps),
shifted AS (SELECT *, CASE WHEN replace(audit, 'D', '')[1] = 'K' AND first_kept[1] = 's' THEN 1 ELSE 0 END AS greeting FROM edits),
lines AS (SELECT conv_id, p, CASE WHEN edit = 'K' THEN x.role WHEN (place - greeting) % 2 = 1 THEN 'user' ELSE 'assistant' END
            || ':' || CASE WHEN edit = 'I' THEN '' ELSE x.text END AS line FROM shifted WHERE edit <> 'D'),
whole AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY p) AS text FROM lines GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(text, '')) AS repaired_sha256
FROM convs c LEFT JOIN counted n ON c.conv_id IS NOT DISTINCT FROM n.conv_id
LEFT JOIN solved s ON c.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN whole w ON c.conv_id IS NOT DISTINCT FROM w.conv_id"""

DEDUP = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(text) AS text_sha256 FROM t JOIN g USING (text)"""

TWINS = {"op11_spelling": SPELLING, "op12_conversation_repair": REPAIR, "op13_exact_dedup": DEDUP}
