import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillsift.config import Retrieval
from quillsift.functions import lexicon as lx
from quillsift.operators import boosts, context, dense, fusion, lexical, sizing
from quillsift.plans import retrieval as plans
from quillsift.sources import sinks

rng = random.Random(11)
VOCAB = ["mức", "phạt", "tiền", "hồ", "sơ", "xe", "máy", "đất", "là", "của", "nhà", "ở", "quỹ", "lương", "thuế", "phí"]
CHUNKS = [(i * 3, f"p{i % 7}", " ".join(rng.choices(VOCAB, k=rng.randint(0, 2))), " ".join(rng.choices(VOCAB, k=rng.randint(1, 14))))
          for i in range(90)] + [(1000, "p1", "mức phạt", "tiền xe"), (1001, "p2", "", "mức phạt tiền xe máy nhà đất thuế phí lương hồ sơ ở")]
QUESTIONS = [(i, " ".join(rng.choices(VOCAB, k=rng.randint(1, 9)))) for i in range(25)] + [
    (90, ""), (91, "vắng mặt"), (92, "mức phạt tiền xe máy nhà đất thuế phí lương hồ sơ"), (93, "Mức PHẠT tiền xe")]


def toks(t):
    return re.findall(r"[^\W_]+", t.casefold())


def has_phrase(seq, phrase):
    return sum(seq[i:i + len(phrase)] == phrase for i in range(len(seq) - len(phrase) + 1))


def bm25(units):
    """Scores of all chunks for a list of units (token tuples), each counted inside one column."""
    docs = {c[0]: (toks(c[2]), toks(c[3])) for c in CHUNKS}
    size = {k: len(h) + len(t) for k, (h, t) in docs.items()}
    average = sum(size.values()) / len(docs)
    scores, member = Counter(), {}
    for unit in units:
        tf = {k: 2.5 * has_phrase(h, unit) + has_phrase(t, unit) for k, (h, t) in docs.items()}
        tf = {k: f for k, f in tf.items() if f}
        idf = math.log((len(docs) - len(tf) + 0.5) / (len(tf) + 0.5))
        idf = idf if idf > 0 else 1e-6
        for k, f in tf.items():
            scores[k] += idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size[k] / average))
            member.setdefault(k, set()).add(tuple(unit))
    return scores, member


def expected(question, branch):
    t = toks(question)
    solid = lambda g: sum(w not in lx.STOP_WORDS for w in g) >= 2
    order = lambda s: sorted(s, key=lambda k: (-round(s[k], 9), k))
    if branch == "bm25":
        return order(bm25([[w] for w in list(dict.fromkeys(t))])[0])[:100]
    if branch == "bm25_phrases":
        grams = [t[i:i + n] for n in (4, 3) for i in range(len(t) - n + 1)]
        grams = list(dict.fromkeys(tuple(g) for g in grams if solid(g)))
        return order(bm25([list(g) for g in grams])[0])[:40]
    terms = [w for w in dict.fromkeys(t) if len(w) > 1 and w not in lx.STOP_WORDS]
    if len(terms) < 3:
        return []
    ranked, out = sorted(terms, key=lambda w: (-len(w), terms.index(w))), []
    for n in dict.fromkeys(min(k, len(terms)) for k in (12, 8, 5)):
        scores, member = bm25([[w] for w in ranked[:n]])
        out += order({k: s for k, s in scores.items() if len(member[k]) == n})[:40]
    return list(dict.fromkeys(out))[:40]


@pytest.fixture(scope="module")
def inputs(spark):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id long, parent_id string, header string, text string")
    return chunks, lexical.Questions.of(spark.createDataFrame(QUESTIONS, "qid long, question string"))


def collect(ranked):
    out = {}
    for r in sorted(ranked.collect(), key=lambda r: r["rank"]):
        out.setdefault((r.branch, r.qid), []).append(r.chunk_id)
    return out


def check(got, branches=lexical.BRANCHES):
    for branch in branches:
        for qid, text in QUESTIONS:
            assert got.get((branch, qid), []) == expected(text, branch), (branch, text)


def test_rankings_equal_brute_force(inputs):
    check(collect(lexical.rankings(*inputs)))


def test_rankings_by_joins_alone(inputs):
    """Beyond the bound the question side is not shared with tasks."""
    check(collect(lexical.rankings(*inputs, asked_bound=0)))


def test_rankings_in_small_slices(inputs, monkeypatch):
    """Every chunk is a slice of its own, and what is kept is pruned after each."""
    from quillsift.operators import scoring
    for name in ("CELLS", "HITS", "KEPT"):
        monkeypatch.setattr(scoring, name, 1)
    asked = scoring.Asked(np.array([5, 7]), np.array([3, 3]), {
        "bm25": scoring.Sparse.of(np.array([0, 1, 1]), np.array([0, 0, 1]), np.zeros(3, np.int64), 2),
        "bm25_precise": scoring.Sparse.of(np.array([0, 1, 1]), np.array([0, 0, 1]), np.array([1, 2, 1]), 2)})
    rows = [(c, u, 1.0 + c % 5 + u / 8) for c in range(40) for u in (0, 1) if (c + u) % 3]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["chunk_id", "uid", "s"])
    got = [tuple(r.values()) for b in scoring.scorer(asked, Retrieval(broad_k=4, and_levels=(2, 1)))(iter([batch])) for r in b.to_pylist()]
    sums = {(q, c): sum(s for x, u, s in rows if x == c and (q == 5 or u == 1)) for q in (5, 7) for c in range(40)}
    for q in (5, 7):
        want = sorted(((-s, c) for (k, c), s in sums.items() if k == q and s), key=lambda x: (round(x[0], 9), x[1]))[:4]
        assert sorted((b, i, c, l, s) for b, i, c, l, s in got if b == "bm25" and i == q) == sorted(("bm25", q, c, 0, -s) for s, c in want)


def test_rankings_without_broadcast(inputs, monkeypatch):
    monkeypatch.setattr(sizing.hinted, "__defaults__", (1,))
    monkeypatch.setattr(sizing.lookup_join, "__defaults__", ("inner", None, 1))
    check(collect(lexical.rankings(*inputs)))


@pytest.mark.parametrize("block_chunks", [1, 4, 1000])
def test_rankings_from_a_stored_index(spark, inputs, tmp_path, block_chunks):
    chunks, questions = inputs
    sinks.write_index(chunks, chunks.select("parent_id").distinct(), str(tmp_path), block_chunks=block_chunks, folders=5)
    index = sinks.read_index(spark, str(tmp_path))
    assert index.chunks.count() == len(CHUNKS) and index.vectors is None
    with pytest.raises(ValueError):
        sinks.read_index(spark, str(tmp_path), identity="other")
    with pytest.raises(ValueError):
        sinks.read_index(spark, str(tmp_path / "nothing"))
    check(collect(index.rankings(questions)))
    check(collect(index.rankings(questions, branches=("bm25_precise",))), ("bm25_precise",))


def test_blocks_below_the_best_score_stay_unread(spark, tmp_path):
    """Few chunks hold the rare word; with two places to fill, blocks that hold only the common one are ruled out."""
    rows = [(i, f"p{i}", "", "common words here" + (" rare rare" if i % 40 == 0 else f" filler{i % 7}")) for i in range(400)]
    chunks = spark.createDataFrame(rows, "chunk_id long, parent_id string, header string, text string")
    asked = lexical.Questions.of(spark.createDataFrame([(1, "rare common")], "qid long, question string"))
    cfg, report = Retrieval(broad_k=2, precise_k=2), []
    sinks.write_index(chunks, chunks.select("parent_id").distinct(), str(tmp_path), block_chunks=4)
    index = sinks.read_index(spark, str(tmp_path))
    got = index.rankings(asked, cfg, report=report).collect()
    want = lexical.rankings(chunks, asked, cfg).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got
    counts = {r.read: r["count"] for r in report[0].where("branch = 'bm25'").groupBy("read").count().collect()}
    assert counts[True] == 10 and counts[False] == 90


def test_an_index_refuses_repeated_ids_and_orphans(spark, inputs, tmp_path):
    chunks, _ = inputs
    parents = chunks.select("parent_id").distinct()
    vectors = chunks.selectExpr("chunk_id", "array(1.0d) AS vector")
    for broken in ((chunks.unionByName(chunks.limit(1)), parents, None), (chunks, parents.union(parents.limit(1)), None),
                   (chunks, parents.limit(1), None), (chunks, parents, vectors.union(vectors.limit(1)))):
        with pytest.raises(ValueError, match="duplicate|without parent"):
            sinks.write_index(*broken[:2], str(tmp_path), broken[2])
        with pytest.raises(ValueError, match="not completed"):
            sinks.read_index(spark, str(tmp_path))
    sinks.write_index(chunks, parents, str(tmp_path), vectors)
    assert sinks.read_index(spark, str(tmp_path)).vectors.count() == len(CHUNKS)


def test_fuse(spark):
    rows = spark.createDataFrame([("a", 1, 1, 1), ("a", 1, 2, 2), ("b", 1, 2, 1), ("b", 1, 3, 2)], "branch string, qid int, chunk_id int, rank int")
    got = fusion.fuse(rows, ["a", "b"]).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [2, 1, 3] and got[0].rrf == 1 / 62 + 1 / 61


def test_diversify_and_splice_equal_greedy_loops(spark):
    r = random.Random(5)
    lists = {q: [(c, f"p{r.randint(0, 4)}") for c in r.sample(range(50), 20)] for q in range(6)}
    rows = spark.createDataFrame([(q, c, p, i + 1) for q, xs in lists.items() for i, (c, p) in enumerate(xs)],
                                 "qid int, chunk_id int, parent_id string, rank int")
    for limit, cap in ((7, 2), (3, 1), (0, 1)):
        got = fusion.diversify(rows, limit, cap).orderBy("rank").collect()
        for q, xs in lists.items():
            want, seen = [], Counter()
            for c, p in xs:
                if seen[p] < cap:
                    want.append(c)
                    seen[p] += 1
                    if len(want) == limit:
                        break
            assert [x.chunk_id for x in got if x.qid == q] == want
    extra = {0: [99, lists[0][0][0]], 1: [98]}
    reserve = spark.createDataFrame([(q, c, i + 1) for q, cs in extra.items() for i, c in enumerate(cs)], "qid int, chunk_id int, rank int")
    got = fusion.splice(rows, reserve, 8).orderBy("rank").collect()
    for q, xs in lists.items():
        base, new = [c for c, _ in xs][:20], extra.get(q, [])
        keep = max(0, 8 - len(new))
        assert [x.chunk_id for x in got if x.qid == q] == list(dict.fromkeys(base[:keep] + new + base[keep:]))[:8]


def test_boosts(spark):
    cfg = Retrieval()
    q = spark.createDataFrame([(1, "Thông tư 06/2023/TT-BVHTTDL năm 2023 quy định mới nhất về thi đua")], "qid int, question string")
    c = spark.createDataFrame([(1, 1, "06/2023/TT-BVHTTDL Điều 1", "thi đua khen thưởng"), (1, 2, "01/2011/TT-BVHTTDL", "thi đua khen thưởng")],
                              "qid int, chunk_id int, header string, text string")
    got = {r.chunk_id: r for r in boosts.adjustments(c, boosts.question_features(q), cfg).collect()}
    assert got[1].adjustment - got[2].adjustment > 4
    scoped = spark.createDataFrame([(1, 1, "", "Quỹ hỗ trợ")], "qid int, chunk_id int, header string, text string")
    low = boosts.adjustments(scoped, boosts.question_features(q), plans.variant(cfg, scope_penalty=0.75)).first().adjustment
    assert low == boosts.adjustments(scoped, boosts.question_features(q), cfg).first().adjustment - 0.75


def test_expansion(spark):
    q = spark.createDataFrame([(1, "Một hành vi có bị xử phạt nhiều lần không?"), (2, "Hồ sơ cấp phép gồm gì?")], "qid int, question string")
    assert Counter(r.qid for r in boosts.expanded_questions(q).collect()) == {1: 2, 2: 1}


@pytest.mark.parametrize("bound,block,pack", [(20_000, 2048, 1 << 24), (20_000, 2, 200), (0, 3, 200)])
def test_nearest_equals_brute_force(spark, monkeypatch, bound, block, pack):
    monkeypatch.setattr(dense, "PACK_BYTES", pack)
    r = np.random.default_rng(3)
    v = r.normal(size=(60, 8)).astype("float32")
    v[10] = v[20]
    vectors = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, vector array<float>").repartition(3)
    asked = vectors.where("id < 7").selectExpr("id as qid", "vector")
    got = dense.nearest(asked, vectors, 9, bound, block).orderBy("qid", "rank").collect()
    assert dense.nearest(asked.where("false"), vectors, 9, bound, block).count() == dense.nearest(asked, vectors.where("false"), 9, bound, block).count() == 0
    scores = np.round(v[:7].astype(float) @ v.astype(float).T, 9)
    for q in range(7):
        assert [x.id for x in got if x.qid == q] == sorted(range(60), key=lambda i: (-scores[q, i], i))[:9]


def test_full_path_with_adjacent_parents(spark):
    texts = [(0, "xe máy vượt đèn đỏ bị phạt tiền"), (1, "giấy phép lái xe hạng a1"), (2, "thủ tục đăng ký kết hôn")]
    chunks = spark.createDataFrame([(i, f"d:{i}", "d", 0, len(t), "", t) for i, t in texts],
                                   "chunk_id long, parent_id string, doc_id string, start int, end int, header string, text string")
    parents = spark.createDataFrame([(f"d:{i}", "d", i) for i, _ in texts], "parent_id string, doc_id string, position int")
    qs = lexical.Questions.of(spark.createDataFrame([(1, "vượt đèn đỏ phạt thế nào")], "qid long, question string"))
    empty = spark.createDataFrame([], "qid long, chunk_id long, rank int")
    fetch = lambda ids, rows: chunks.join(ids.distinct(), "chunk_id")
    plain = plans.full_retrieval(chunks, fetch, qs, empty).collect()
    assert [r.chunk_id for r in plain] == [0]
    cfg = Retrieval(adjacent_distance=1, adjacent_reserve=8, intent_expansion=True)
    wide = plans.full_retrieval(chunks, fetch, qs, empty, cfg=cfg, parents=parents).orderBy("place").collect()
    assert {r.chunk_id for r in wide} == {0, 1} and wide[0].chunk_id == 0


def test_materialize_shifts_long_parents(spark):
    ordered = spark.createDataFrame([(1, 5, "a", 20000, 20010, 1.0, 1), (1, 6, "a", 0, 5, 0.5, 2), (1, 7, "b", 3, 8, 0.4, 3)],
                                    "qid int, chunk_id long, parent_id string, start int, end int, score double, place int")
    parents = spark.createDataFrame([("a", "x" * 50000), ("b", "y" * 10)], "parent_id string, text string")
    whole = context.materialize(ordered, parents, 1).orderBy("context").first()
    assert (whole.window_start, whole.seed_start, len(whole.text)) == (0, 20000, 50000)
    rows = context.materialize(ordered, parents, 1, Retrieval(parent_chars=24000)).orderBy("context").collect()
    a, b = rows
    assert (a.chunk_id, a.window_start, a.window_end, a.seed_start, a.seed_end, len(a.text)) == (5, 10000, 34000, 10000, 10010, 24000)
    assert (b.chunk_id, b.window_start, b.seed_start, b.text) == (7, 0, 3, "y" * 10)
    assert context.materialize(ordered, parents, 1, Retrieval(parents_k=0)).count() == 2


def test_token_coverage(spark):
    gold = spark.createDataFrame([(1, "a a b c"), (2, "z")], "qid int, answer string")
    picked = spark.createDataFrame([("s", 1, 1, "a", "b"), ("s", 1, 2, "", "a q")], "stage string, qid int, rank int, header string, text string")
    got = {r.k: r.coverage for r in context.token_coverage(gold, picked, 2, 2).collect()}
    assert got == {1: 0.25, 5: 0.375, 20: 0.375}


def test_postings_are_packed_where_the_chunk_is_read(spark, inputs):
    """One row per chunk with all its asked units, header weighed, phrases inside one field only; nothing is shuffled or sorted."""
    from quillsift.operators import scoring
    units = ["b", "b c d", "a b c d", "z", "d e f"]
    numbered = spark.createDataFrame([("", 0), *((u, i + 1) for i, u in enumerate(units))], "unit string, uid int")
    chunks = spark.createDataFrame([(1, "a b c", "d a b c d b c d"), (2, "", "d e, f"), (3, "q", ""), (4, None, "b")],
                                   "chunk_id long, header string, text string")
    vocabulary = scoring.Vocabulary.of(numbered)
    posts = scoring.packed_postings(lexical.cut_chunks(chunks), vocabulary)
    plan = posts._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    got = {r.chunk_id: (r.length, dict(zip(np.frombuffer(r.uids, vocabulary.kind).tolist(), np.frombuffer(r.weights, np.float32).tolist()))) for r in posts.collect()}
    assert got == {1: (11, {1: 4.5, 2: 2.0, 3: 1.0}), 2: (3, {5: 1.0}), 3: (1, {})}
    counts = {r.uid: (r.df, r.total) for r in scoring.unit_counts(posts, vocabulary).collect()}
    assert counts == {0: (3, 15), 1: (1, 0), 2: (1, 0), 3: (1, 0), 5: (1, 0)}


def test_an_index_stays_in_proportion_to_its_corpus(spark, tmp_path):
    """Units are tokens alone, and no exchange makes them; chunks are read from the stored parents."""
    from quillsift.operators import blockmax
    rows = [(i, " ".join(f"w{(i * 31 + j * j) % 97}" for j in range(60))) for i in range(50)]
    parents = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("concat(doc_id, ':0') AS parent_id", "doc_id", "text")
    cut = lambda kept: kept.selectExpr("doc_id AS chunk_id", "parent_id", "'' AS header", "text")
    sinks.write_index(cut, parents, str(tmp_path), block_chunks=8)
    index = sinks.read_index(spark, str(tmp_path))
    assert index.postings.where("unit LIKE '% %'").count() == 0
    assert index.postings.selectExpr("sum(n)").first()[0] == sum(len(set(t.split())) for _, t in rows)
    assert index.postings.columns == ["folder", "unit", "block", "n", "most"]
    plan = blockmax.blocks(index.chunks, index.statistics)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    asked = lexical.Questions.of(spark.createDataFrame([(1, rows[3][1]), (2, "w1 w2 w3")], "qid long, question string"))
    want = lexical.rankings(cut(parents), asked).collect()
    assert sorted(map(tuple, index.rankings(asked).collect())) == sorted(map(tuple, want)) and want


def test_packs_of_vectors_reach_a_task_few_at_a_time(spark):
    """A batch holds packs up to a bound of bytes, however many a task has."""
    from quillsift.operators import dense
    vectors = spark.range(0, 60000, 1, 1).selectExpr("id", "transform(sequence(1, 64), i -> cast(pmod(id * i, 101) as double)) AS vector")
    asked = vectors.where("id < 3").withColumnRenamed("id", "qid")
    seen = spark.sparkContext.accumulator(0)
    run = dense._met

    def counted(k):
        inner = run(k)

        def met(batches):
            for batch in batches:
                if batch.nbytes > 2 * dense.BATCH_BYTES:
                    seen.add(1)
                yield from inner(iter([batch]))
        return met

    dense._met = counted
    try:
        rows = dense.nearest(asked, vectors, 2).collect()
    finally:
        dense._met = run
    assert len(rows) == 6 and seen.value == 0
