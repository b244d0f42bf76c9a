"""Spelling variants, conversation repair and exact dedup against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillsift.llm import conversation_repair as cr, exact_dedup as ed, spelling as sp

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- exact dedup -------------------------------------------------------------------------------------------------------


def plain_classes(rows):
    texts = {}
    for i, t in rows:
        texts.setdefault(t or "", []).append(i)
    out = Counter()
    for i, t in rows:
        ids = texts[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out[i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("bits,range_rows", [(64, 1 << 21), (5, 4), (40, 8)])
def test_classes(odd, none, documents, bits, range_rows):
    """Five bits let unlike texts share fingerprints; small ranges cut every filter into pieces."""
    for docs in (odd, documents):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        got = ed.classes(docs, bits, range_rows)
        assert Counter(tuple(r) for r in got.collect()) == plain_classes(rows)
    assert ed.classes(none, bits, range_rows).count() == 0


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_a_third_of_all_rows_are_one_text(spark, monkeypatch, limit):
    import functools
    monkeypatch.setattr(ed, "lookup_join", functools.partial(ed.lookup_join, limit=limit))
    docs = spark.range(900).selectExpr("id AS doc_id", "if(id % 3 = 0, 'the same', concat('text ', id DIV 2)) AS text").repartition(6)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter(tuple(r) for r in ed.classes(docs).collect()) == plain_classes(rows)


def test_deduplicated(odd, none):
    out = ed.deduplicated(odd)
    assert out.columns == odd.columns and sorted((r.doc_id or 0) for r in out.collect()) == [0, 2, 3, 5, 7, 8, 9, 10]
    assert ed.deduplicated(none).count() == 0


def test_filters_merge_losslessly():
    draw = np.random.default_rng(2)
    for bits, n in ((64, 0), (64, 1), (64, 5000), (12, 3000), (1, 1), (20, 40)):
        parts, whole = [], Counter()
        for _ in range(5):
            keys = draw.integers(0, 1 << min(bits, 62), n).astype(np.uint64) << np.uint64(max(0, bits - 62))
            keys = np.concatenate([keys, keys[: n // 3], keys[:1]])
            whole.update(keys.tolist())
            unique, counts = np.unique(keys, return_counts=True)
            own = ed.Filter.build(unique, counts, bits)
            again = ed.Filter.of_row(dict(zip((c.split()[0] for c in ed.PIECE.split(", ")), own.row(0))), bits)
            assert again.fingerprints().tolist() == unique.tolist() and again.counts.tolist() == counts.tolist()
            parts.append(again)
        while len(parts) > 1:
            parts.append(parts.pop(0).merge(parts.pop(0)))
        assert dict(zip(parts[0].fingerprints().tolist(), parts[0].counts.tolist())) == dict(whole)
        assert (parts[0].runend.sum() == parts[0].occupied.sum()) and parts[0].filled.sum() == len(whole)


# --- conversation repair -----------------------------------------------------------------------------------------------

BLANK, ENDS = re.compile(r"[^\x20\x09-\x0D]"), re.compile(r"(?:s?(?:ua)+)?\Z")


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        marks = BLANK.findall(text)
        out.append("b" if not marks else "d" if (role, text) in seen else "t" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """Cheapest edits by dynamic programming over the rows, states as the letters so far folded to their last one."""
    marks = faults(rows)
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {"": (0, "", ())}

    def better(table, state, value):
        if state not in table or value[:2] < table[state][:2]:
            table[state] = value

    def inserted(table):
        for _ in range(3):
            for state, (c, a, lines) in list(table.items()):
                for initial in "ua":
                    if initial in step[state]:
                        better(table, step[state][initial], (c + 5, a + "I", (*lines, ({"u": "user", "a": "assistant"}[initial], ""))))
        return table

    best = inserted(best)
    for (_, role, text), fault in zip(rows, marks):
        after = {}
        for state, (c, a, lines) in best.items():
            better(after, state, (c + 2, a + "D", lines))
            if fault in ("b", "d"):
                continue
            late = 5 if fault == "t" else 0
            if role[:1] in step[state] and role:
                better(after, step[state][role[:1]], (c + late, a + "K", (*lines, (role, text))))
            for initial, name in (("u", "user"), ("a", "assistant")):
                if initial in step[state]:
                    better(after, step[state][initial], (c + 1 + late, a + "R", (*lines, (name, text))))
        best = inserted(after)
    cost, audit, lines = min(best[s] for s in ("", "a") if s in best)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
    return (gaps, *(marks.count(k) for k in "bdt"), illegal, cost, audit, digest), lines


def arranged(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest())
    return sorted(rows, key=key)


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = out.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {conv: arranged(own) for conv, own in out.items()}


ROWS = "conv_id bigint, turn bigint, role string, text string"


def talks(seed=3, n=150, most=14):
    draw, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(draw.randint(1, most)):
            rows.append((conv, draw.choice([turn, turn, turn, turn + 1, None]), draw.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]),
                         draw.choice(["Yes.", "No!", "cut", " \t", "", None, f"t{turn}.", f"t{turn}", "é?  \n", "Ok. 漢"])))
    rows += [(None, 1, "user", "a."), (None, 2, "assistant", "b."), (7000, None, None, None)]
    return rows + rows[:5]


def test_digests_of_damaged_conversations(spark):
    rows = talks()
    table = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 AS kind", "'x' AS sha", "2 AS copies", "0 AS cost", "'D' AS audit").repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in cr.repair_digests(cr.damaged(table)).collect()}
    want = {conv: plain_repair(own)[0] for conv, own in plain_damage(rows).items()}
    assert got == want and len({w[-2] for w in want.values()}) > 50
    assert cr.repair_digests(cr.damaged(table.where("false"))).count() == 0


def test_a_conversation_over_many_tasks(spark):
    """One conversation holds most rows: its parts meet again, however the ranges fall."""
    draw = random.Random(8)
    rows = [(5, t, draw.choice(["user", "assistant"]), draw.choice(["Well.", f"say {t}.", f"cut {t}", f"no {t}!"])) for t in range(3000)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}.") for c in range(3, 9) if c != 5 for t in range(4)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.conv_id: tuple(r)[1:] for r in cr.repair_digests(cr.undamaged(spark.createDataFrame(rows, ROWS).repartition(4))).collect()}
        lines = [(r.turn, r.role, r.text) for r in cr.repaired(cr.undamaged(spark.createDataFrame(rows, ROWS))).where("conv_id = 5").orderBy("turn").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    wanted, told = {}, {}
    for conv in {r[0] for r in rows}:
        wanted[conv], told[conv] = plain_repair(arranged([r[1:] for r in rows if r[0] == conv]))
    assert got == wanted and lines == [(k, *line) for k, line in enumerate(told[5])]


def test_charts_of_all_short_patterns():
    """Every pattern of up to four rows: the chart, growing spans and the row-by-row search agree."""
    text = {"s": ("system", "x."), "u": ("user", "x."), "a": ("assistant", "x."), "o": ("tool", "x."), "S": ("system", "x"), "U": ("user", "x"), "A": ("assistant", "x"), "-": ("user", "")}
    charts = cr.Charts()
    for size in range(5):
        for marks in itertools.product(text, repeat=size):
            rows = [(k, text[m][0], text[m][1] and f"{k}{text[m][1]}") for k, m in enumerate(marks)]
            (*_, cost, audit, _), _ = plain_repair(rows)
            assert cr.verdict(charts.block("".join(marks)) if marks else cr.CLOSURE) == (cost, audit)
    draw = random.Random(1)
    marks = "".join(draw.choice("suaoSUA-ua") for _ in range(100))
    span = cr.Span(charts)
    for m in marks:
        span.add(m)
    (*_, cost, audit, _), _ = plain_repair([(k, text[m][0], text[m][1] and f"{k}{text[m][1]}") for k, m in enumerate(marks)])
    assert cr.verdict(span.cell()) == (cost, audit)


# --- spelling ----------------------------------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(rows):
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                count[run] += 1
    words = {w: n for w, n in count.items() if n >= 3}
    form, near = {}, {}
    for w, n in words.items():
        near[w] = [v for v in words if one_edit(w, v)]
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("cell_words", [sp.CELL_WORDS, 25])
def test_variants(spark, cell_words):
    """Small cells route every word to several; words of one letter set and chains of forms are among them."""
    draw, rows = random.Random(5), []
    stems = ["".join(draw.choice("abcdeéÿ") for _ in range(draw.randint(5, 19))) for _ in range(40)] + ["Straße", "àÀaBc", "aaaaaaaaaaaaaaaaa", "abcdefgh", "abcdefghi"]
    for i in range(500):
        words = []
        for _ in range(12):
            w = list(draw.choice(stems[:draw.randint(1, len(stems))]))
            for _ in range(draw.choice([0, 0, 1, 1, 2])):
                k = draw.randrange(len(w))
                w[k:k + draw.randint(0, 1)] = draw.choice(["", "x", "é", "xy"])
            words.append("".join(w))
        rows.append((draw.choice([i, i, None]), draw.choice([" ", ", ", "1"]).join(words)))
    rows += [(1, None), (2, ""), (3, "ab cd " * 50), (4, "permute mutepre " * 5), (5, "x" * 3000 + " " + "x" * 2999)] + [(5, "x" * 3000 + " " + "x" * 2999)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'w' AS word", "3 AS n", "1 AS cell", "'r' AS root").repartition(4)
    got = sp.variants(docs, cell_words)
    want = plain_variants(rows)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert any(w[1] and w[2] != w[1] for w in want) and any(w[4] > 5 for w in want)


def test_variants_odd_input(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert {tuple(r) for r in sp.variants(odd).collect()} == plain_variants(rows)
    assert sp.variants(none).count() == 0


def test_trees_reach_every_leaf_in_the_ball():
    draw = np.random.default_rng(4)
    points = draw.integers(0, 4, (sp.DIMENSIONS, 600)) * (draw.random((sp.DIMENSIONS, 1)) < 0.1)
    tree = sp.Tree.build(points, 9)
    leaf_of = np.empty(600, int)
    for k in np.flatnonzero(tree.dim < 0):
        leaf_of[tree.order[tree.start[k]:tree.stop[k]]] = k
    for radius in (0, 1, 2):
        p, leaf = tree.reach(points, radius)
        reached = set(zip(p.tolist(), leaf.tolist()))
        assert len(reached) == len(p)
        distance = np.abs(points[:, :, None] - points[:, None, :]).sum(axis=0)
        assert all((a, leaf_of[b]) in reached for a, b in zip(*np.nonzero(distance <= radius)))
        assert len(p) < 600 * (tree.dim < 0).sum()
