"""Language and toxicity models: held-out accuracy, gradients, odd input."""

import zlib

import numpy as np
import pyarrow as pa

from quillsift.llm import langid, toxicity
from quillsift.llm.queries import op1_language_id, op8_toxicity

SF = "/root/testdata/sf0.01"


def test_languages_of_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op1_language_id(spark, SF).collect()
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert sum(r.rejected for r in rows) <= 0.01 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_far_texts_are_rejected():
    english = ["the cat sat on the mat and the dog ran over the hill " * 3, "there is nothing that the other one would rather do " * 3] * 60
    german = ["der hund und die katze sind nicht auf dem berg gewesen " * 3, "wir haben das schon immer so gemacht und bleiben dabei " * 3] * 60
    model = langid.fit(english + german, ["en"] * 120 + ["de"] * 120)
    names, scores, rejected = model.predict(pa.array(["the dog sat there", "die katze und der hund", "zzzqqq xxkkww " * 20, "123 !!", None, ""]))
    assert names[:2] == ["en", "de"] and names[3:] == ["und"] * 3 and scores[3:] == [0.0] * 3
    assert rejected[2:] == [True] * 4


def test_short_foreign_texts_are_rejected(spark):
    draw = np.random.default_rng(3)
    stock = {"en": "the of and to in that was his with for it had as not but which she they from this".split(),
             "de": "der die und nicht das ist ein zu von sich mit auf dem auch wie hat noch nach wird".split()}
    # All labelled rows are long, the rows to judge are short.
    rows = [(i, " ".join(draw.choice(stock[lang], 400)), lang) for i, lang in enumerate(["en", "de"] * 100)]
    short = [(1000, "zzxq kkjw vvbp qqyh", None), (1001, "xqzz jjkw bbvp hhqy gzzk wwxj pqqv kjjz", None),
             (1002, "\u043f\u0440\u0438\u0432\u0435\u0442 \u044d\u0442\u043e \u043a\u043e\u0440\u043e\u0442\u043a\u0438\u0439", None),
             (1003, "she was not with them but they had it", None), (1004, "das ist auch nicht von dem", None), (1005, "with this", None)]
    docs = spark.createDataFrame(rows + short, "doc_id bigint, text string, lang string")
    rejected = {r.doc_id for r in langid.predict(docs, langid.train(docs)).collect() if r.rejected}
    assert rejected == {1000, 1001, 1002}


def test_limits_come_from_all_rows(spark, monkeypatch):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 80)
    model = langid.train(documents)
    rows = [r for r in documents.collect() if r.lang and r.text and zlib.crc32(str(r.doc_id).encode()) % 5]
    assert (model.limits > 0).all()
    assert np.allclose(model.limits, langid.limits(model, langid.distances(model, [r.text for r in rows])))
    n = langid.frequencies([r.text for r in rows])
    assert np.allclose(model.idf, np.log((1 + n[-1]) / (1 + n[:-1])) + 1, atol=1e-5)


def test_language_odd_input(odd, none):
    model = langid.train(odd)
    rows = langid.predict(odd, model).collect()
    assert len(rows) == odd.count()
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {1, 2, 3, 7}
    assert langid.predict(none, langid.train(none)).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, langid.train(none)).collect()} == {"und"}
    assert langid.identified(odd, model).columns == odd.columns


def test_gradients_match_differences():
    net = toxicity.Network([1, 2, 3])
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    draw = np.random.default_rng(0)
    x = draw.standard_normal((7, toxicity.WORD_DIM + toxicity.CHAR_DIM)) * 0.5
    index = draw.integers(0, 7, (3, 5))
    mask = np.array([[1, 1, 1, 1, 1], [1, 1, 0, 0, 0], [1, 1, 1, 1, 0]], bool)
    target = np.array([1.0, 0.0, 1.0])

    def loss(x):
        logit = net.run(net.project(x), index, mask)
        return np.mean(np.log1p(np.exp(-logit * (2 * target - 1))))

    g, dx = net.gradients(x, index, mask, target)
    for name in ("wx", "u", "wa", "va", "wo", "bo", "bx"):
        flat, own = net.p[name].reshape(-1), g[name].reshape(-1)
        for i in draw.integers(0, len(flat), 4):
            old = flat[i]
            flat[i] = old + 1e-3
            up = loss(x)
            flat[i] = old - 1e-3
            down = loss(x)
            flat[i] = old
            assert abs((up - down) / 2e-3 - own[i]) < 2e-3, name


def test_windows_cover_every_word():
    for n in (0, 1, 47, 48, 49, 88, 89, 1000):
        covered = {w for s in toxicity.window_starts(n) for w in range(s, min(s + toxicity.WINDOW, n))}
        assert covered == set(range(n))


def test_toxic_words_in_held_out_documents():
    draw = np.random.default_rng(1)
    syllables = ["ta", "re", "mi", "no", "lu", "ke", "po", "shi"]
    word = lambda: "".join(draw.choice(syllables, draw.integers(1, 4)))
    texts, labels = [], []
    for i in range(400):
        words = [word() for _ in range(draw.integers(20, 300))]
        labels.append(i % 4 == 0)
        if labels[-1]:
            for _ in range(max(2, len(words) // 30)):
                words[draw.integers(len(words))] = draw.choice(["grubling", "vexhead,", "Snarkwit"])
        texts.append(" ".join(words))
    labels = np.array(labels, np.int64)
    scores = toxicity.fit(texts[:300], labels[:300]).scores(pa.array(texts[300:] + ["", None, "!!! 1"]))
    assert ((scores[:100] >= 0.5) == labels[300:]).mean() >= 0.95
    assert ((scores >= 0) & (scores <= 1)).all()


def test_toxic_passages_after_many_words_are_learnt(spark):
    draw = np.random.default_rng(2)
    syllables = ["ta", "re", "mi", "no", "lu", "ke", "po", "shi"]
    text = lambda n: ["".join(draw.choice(syllables, draw.integers(1, 4))) for _ in range(n)]
    rows = []
    for i in range(150):
        words = text(2300)
        if i % 2:
            words[2100:2140] = draw.choice(["grubling", "vexhead", "snarkwit"], 40)
        rows.append((i, " ".join(words), i % 2))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    scorer = toxicity.train(docs, docs)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    scores = scorer.scores(pa.array([r[1] for r in held]))
    assert np.mean((scores >= 0.5) == [r[2] == 1 for r in held]) >= 0.95
    local = toxicity.Sample([r[1] for r in rows], np.array([r[2] for r in rows]))
    stored = toxicity.SparkSample(docs)
    assert stored.vocabulary() == local.vocabulary()
    assert sorted(stored.examples(scorer.network)) == sorted(local.examples(scorer.network))


def test_toxicity_query_and_odd_input(spark, odd, none):
    rows = op8_toxicity(spark, SF).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == 1000 and sum(p == t for p, t in held) >= 0.8 * len(held)
    no_labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    scored = toxicity.score(odd, toxicity.train(odd, no_labels)).collect()
    assert len(scored) == odd.count() and {r.score for r in scored} == {0.0}
    assert toxicity.score(none, toxicity.train(none, no_labels)).count() == 0
    assert toxicity.without_toxic(odd, toxicity.train(odd, no_labels)).count() == odd.count()
