import hashlib
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quillsift.config import Generation
from quillsift.operators import prompt
from quillsift.sources import integrity, sinks
from quillsift.streaming import journal

DDL = "id string, value string"


def test_journal(spark, tmp_path):
    path = str(tmp_path / "j")
    rows = lambda *ids: spark.createDataFrame([(i, i * 2) for i in ids], DDL)
    journal.append(spark, rows("a", "b"), path, {"seed": 1}, DDL)
    journal.append(spark, rows("b", "c"), path, {"seed": 1}, DDL)
    with pytest.raises(ValueError):
        journal.append(spark, rows("d", "d"), path, {"seed": 1}, DDL)
    kept = journal.open_journal(spark, path, {"seed": 1}, DDL)
    assert sorted(r.id for r in kept.collect()) == ["a", "b", "c"] and journal.repeated(kept).count() == 0
    assert {r.id for r in integrity.pending(rows("a", "z"), kept).collect()} == {"z"}
    with pytest.raises(ValueError):
        journal.open_journal(spark, path, {"seed": 2}, DDL)


def test_stream_resumes(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    put = lambda n, ids: (source / f"{n}.json").write_text("".join(json.dumps({"id": i, "value": n}) + "\n" for i in ids))
    stream = lambda: spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).json(str(source))
    put("1", ["a", "b"]), put("2", ["b", "c"])
    journal.follow(stream(), path, {"v": 1}, DDL)
    put("3", ["c", "d"])
    journal.follow(stream(), path, {"v": 1}, DDL)
    got = journal.open_journal(spark, path, {"v": 1}, DDL).collect()
    assert sorted(r.id for r in got) == ["a", "b", "c", "d"]


def test_attempts(spark):
    assert journal.token_ladder(8192) == [2048, 3072, 4096] and journal.token_ladder(7000) == [2048, 2904]
    with pytest.raises(ValueError):
        journal.token_ladder(6000)
    cases = {  # id: attempts as (budget, focused, accepted, faulty, hit), expected next step
        "done": ([(2048, False, True, False, False)], None), "faulty": ([(2048, False, False, True, True)], (2048, True)),
        "twice": ([(2048, False, False, True, False), (2048, True, False, True, False)], None),
        "longer": ([(2048, False, False, False, True)], (3072, False)),
        "focus_longer": ([(2048, False, False, True, False), (2048, True, False, False, True)], (3072, True)),
        "top": ([(4096, False, False, False, True)], None), "stop": ([(2048, False, False, False, False)], None),
        "many": ([(2048, False, False, False, True)] * 4, None)}
    rows = [(k, i, *a) for k, (steps, _) in cases.items() for i, a in enumerate(steps)]
    df = spark.createDataFrame(rows, "id string, attempt int, budget int, focused boolean, accepted boolean, faulty boolean, hit_token_limit boolean")
    got = {r.id: (r.budget, r.focused) for r in journal.next_attempts(df, [2048, 3072, 4096]).collect()}
    assert got == {k: want for k, (_, want) in cases.items() if want}


def test_attempts_as_a_stream(spark, tmp_path):
    ddl = "id string, attempt int, budget int, focused boolean, accepted boolean, faulty boolean, hit_token_limit boolean"
    spark.createDataFrame([("a", 1, 2048, False, False, False, True), ("b", 1, 2048, False, True, False, False)], ddl).coalesce(1).write.json(str(tmp_path / "in"))
    steps = journal.next_attempts(spark.readStream.schema(ddl).json(str(tmp_path / "in")), [2048, 3072])
    query = steps.writeStream.outputMode("update").format("memory").queryName("steps").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r) for r in spark.table("steps").collect()] == [("a", 3072, False)]


def test_ids_and_manifests(spark, tmp_path):
    a, b = (spark.createDataFrame([(i,) for i in x], "id string") for x in ("abc", "bcd"))
    assert {tuple(r) for r in integrity.id_difference(a, b).collect()} == {("a", "extra"), ("d", "missing")}
    assert integrity.leaks(a, b).count() == 2
    q = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", "z")], "id string, question string")
    assert {r.id for r in integrity.question_mismatches(q, q.where("id = '1'").union(spark.createDataFrame([("2", "other")], q.schema))).collect()} == {"2", "3"}
    root = tmp_path / "snap"
    root.mkdir()
    for name in ("one", "two", "new"):
        (root / name).write_text(name)
    files = integrity.file_hashes(spark, str(root))
    assert {(r.path, r.sha256) for r in files.collect()} >= {("one", hashlib.sha256(b"one").hexdigest())}
    manifest = files.where("path <> 'new'").union(spark.createDataFrame([("gone", 1, "x")], files.schema)).withColumn(
        "sha256", F.when(F.col("path") == "two", "bad").otherwise(F.col("sha256")))
    assert {tuple(r) for r in integrity.manifest_mismatches(files, manifest).collect()} == {("two", "hash"), ("gone", "missing"), ("new", "unlisted")}
    for sub, stage in (("x", "one"), ("y", "two"), ("z", "two")):
        (root / sub).mkdir()
        (root / sub / "manifest.json").write_text(json.dumps({"stage": stage}))
    assert integrity.find_snapshot(spark, str(root), "one").endswith("/snap/x")
    for stage in ("two", "three"):
        with pytest.raises(ValueError):
            integrity.find_snapshot(spark, str(root), stage)
    assert integrity.with_provenance(a, {"v": 1}).first().provenance == '{"v": 1}'
    d = lambda df: integrity.table_digest(df, "id").first().identity
    assert d(a) == d(a.orderBy(F.desc("id"))) != d(b)


def test_package(spark, tmp_path):
    df = spark.createDataFrame([("2", "hai"), ("1", "một")], "id string, answer string")
    target = str(tmp_path / "s.zip")
    assert sinks.package_answers(df, target) == 2
    with zipfile.ZipFile(target) as z:
        assert json.loads(z.read("submission.json")) == {"1": {"answer": "một"}, "2": {"answer": "hai"}}
    for bad in (df.union(df), df.withColumn("answer", F.lit(" "))):
        with pytest.raises(ValueError):
            sinks.package_answers(bad, target)
    with pytest.raises(ValueError):
        sinks.package_answers(df, target, "../x.json")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 2


@pytest.mark.parametrize("room,floor,limits,want", [
    (1000, 100, [50, 2000, 400], [50, 600, 350]), (10, 100, [40, 40], [40, 40]), (500, 32, [], []), (300, 64, [90, 90, 90], [90, 90, 90]),
    (203, 32, [500, 500, 500, 500], [80, 57, 33, 33])])
def test_shares(spark, room, floor, limits, want):
    rows = spark.createDataFrame([(room, floor, limits)], "r int, f int, m array<int>")
    got = rows.select(prompt.shares(F.col("r"), F.col("f"), F.col("m")).alias("s")).first().s
    assert sum(got) == max(min(room, sum(limits)), sum(min(floor, x) for x in limits))
    if len(limits) != 4:
        assert got == want


CTX = "qid int, question string, context int, doc_id string, parent_id string, number string, heading string, text string, seed_start int, seed_end int"


def test_prompts_fit(spark):
    words = lambda n, p: " ".join(f"{p}{i}" for i in range(n))
    text = words(900, "a")
    at = text.index("a500")
    rows = [(1, "Hỏi gì?", 0, "d", "d:0", "9/QĐ", "Điều 1", text, at, at + 9), (1, "Hỏi gì?", 1, "d", "d:1", "", "", words(30, "b"), 0, 2),
            (1, "Hỏi gì?", 2, "e", "e:0", "", "", words(500, "c"), 0, 2)]
    for limit in (800, 560):
        out = prompt.pack_prompts(spark.createDataFrame(rows, CTX), Generation(max_input_tokens=limit, min_context_tokens=64)).first()
        full = prompt.system_text(Generation()).split()
        assert out.input_tokens <= limit
        assert len(full) + 7 + 3 * len(out.packed) + sum(len(c.text.split()) for c in out.packed) + 2 <= limit + 20
        assert "a500" in out.packed[0].text and out.packed[0].text.startswith("9/QĐ Điều 1\n")
    tight = prompt.pack_prompts(spark.createDataFrame(rows, CTX), Generation(max_input_tokens=300)).collect()
    assert [(r.qid, r.packed) for r in tight] == [(1, [])]
    only = prompt.pack_prompts(spark.createDataFrame(rows, CTX), Generation(same_document=True)).first()
    assert [c.parent_id for c in only.packed] == ["d:0", "d:1"]


def test_window_and_units(spark):
    text = "Điều 1. Mở đầu\nvăn bản này\n\nĐiều 2. Nội dung\n1. Một khoản dài.\n2. Khoản cuối;\nkhông thuộc"
    a = text.index("Một")
    rows = spark.createDataFrame([(text, text.index("này"), len(text) - 3, a, a + 3), ("abc def", 1, 6, 2, 3), (text, 0, len(text), a, a + 3),
                                  ("x. y\n \n\nz; w:\n\n\nend", 2, 18, 9, 10)], "t string, s int, e int, a int, b int")
    ends = [(r.w.left, r.w.right) for r in rows.select(prompt.unit_borders(*map(F.col, "tseab")).alias("w")).collect()]
    assert text[slice(*ends[0])] == "Điều 2. Nội dung\n1. Một khoản dài.\n2. Khoản cuối;"
    assert ends[1:] == [(1, 6), (0, len(text)), (8, 15)]
    df = spark.createDataFrame([(text, a, a + 3, 8)], "text string, seed_start int, seed_end int, cap int")
    got = prompt.seed_window(df, "cap").first().text
    assert len(got.split()) == 8 and "Một" in got
    assert "Một" in prompt.seed_window(df, "cap", complete_units=True).first().text


def test_training_examples(spark):
    rows = spark.createDataFrame([("a", [1, 2], [5, 6]), ("b", [1], [7] * 9), ("c", [], [5])], "id string, prompt_ids array<int>, answer_ids array<int>")
    got = {r.id: r for r in prompt.training_examples(rows, eos=9, limit=10, prompt_limit=4, minimum=2).collect()}
    assert got["a"].input_ids == [1, 2, 5, 6, 9] and got["a"].labels == [-100, -100, 5, 6, 9] and got["a"].attention_mask == [1] * 5
    assert got["b"].skipped.startswith("full reference") and got["c"].skipped == "no retrieved context"


@pytest.mark.parametrize("size", [1, 4, 100])
def test_padded_batches_lose_no_sequence(spark, size):
    draw = random.Random(3)
    rows = [(f"i{k}", [1] * draw.randint(0, 9), [2] * draw.randint(1, 30)) for k in range(90)]
    examples = prompt.training_examples(spark.createDataFrame(rows, "id string, prompt_ids array<int>, answer_ids array<int>").repartition(5), 9, 30, 8, 1)
    usable = {r.id: r for r in examples.where("skipped IS NULL").collect()}
    got = prompt.padded_batches(examples, size, 7).collect()
    assert len(got) == len({(r.batch, r.slot) for r in got}) == len(usable) and {r.id for r in got} == set(usable)
    order = sorted(usable, key=lambda i: (len(usable[i].input_ids), i))
    for r in got:
        own, batch = usable[r.id], order[r.batch * size:(r.batch + 1) * size]
        width = max(len(usable[i].input_ids) for i in batch)
        n = width - len(own.input_ids)
        assert (r.id, r.width, r.padding) == (batch[r.slot], width, n) and r.input_ids == own.input_ids + [7] * n
        assert r.attention_mask == own.attention_mask + [0] * n and r.labels == own.labels + [-100] * n
    assert prompt.padded_batches(examples.where("false"), size, 7).count() == 0


def test_messages(spark):
    df = spark.createDataFrame([(1, "Gì?", ["một", "hai"])], "qid int, question string, texts array<string>")
    system, user = prompt.messages(df, Generation(system_suffix="Thêm.")).first().messages
    assert system.role == "system" and system.content.endswith(" Thêm.") and user.content == (
        "Ngữ cảnh pháp luật:\nTrích đoạn 1:\nmột\n\nTrích đoạn 2:\nhai\n\nCâu hỏi: Gì?\n\nCâu trả lời:")
