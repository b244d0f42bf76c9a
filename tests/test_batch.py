"""Large JSON objects, resumable retrieval and cache checks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillsift.config import Retrieval
from quillsift.operators import lexical
from quillsift.plans import batch
from quillsift.sources import json_stream, sinks
from quillsift.sources.json_objects import read_members


@pytest.fixture
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "97b", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def value(draw, deep=3):
    kind = draw.randint(0, 7 if deep else 4)
    if kind < 3:
        return "".join(draw.choice('ab"\\{}[],: é漢\n') for _ in range(draw.choice([0, 3, 20, 400 if deep == 3 else 9])))
    if kind < 5:
        return draw.choice([None, True, -1.5e3, 12])
    if kind == 5:
        return [value(draw, deep - 1) for _ in range(draw.randint(0, 4))]
    return {f"k{i}": value(draw, deep - 1) for i in range(draw.randint(0, 4))}


@pytest.mark.parametrize("indent", [None, 2])
def test_members_of_large_objects(spark, tmp_path, small_ranges, indent):
    draw, want = random.Random(4), {}
    for n in (0, 1, 2, 40):
        whole = {f'key "{i}" \\': value(draw) for i in range(n)}
        want[f"f{n}.json"] = {k: v for k, v in whole.items()}
        (tmp_path / f"f{n}.json").write_text(("﻿" if n == 2 else "") + json.dumps(whole, ensure_ascii=n % 2 == 1, indent=indent) + "\n" * (n % 3), encoding="utf-8")
    rows = json_stream.read_large(spark, str(tmp_path)).collect()
    got = {name: {} for name in want}
    for r in rows:
        got[r.file.rsplit("/", 1)[1]][r.id] = json.loads(r.value)
        assert r.parent is None
    assert got == want and len(rows) == sum(map(len, want.values()))
    plain = {(r.id, r.value) for r in read_members(spark, str(tmp_path / "f40.json")).collect()}
    assert {(r.id, r.value) for r in rows if r.file.endswith("f40.json")} == plain


def test_records_of_one_file_are_read_by_many_tasks(spark, tmp_path, small_ranges):
    draw = random.Random(9)
    known = {"code": "c", "models": {"a": [1, "}"]}}
    records = {str(i): {"question": f'q{i} "x"', "contexts": [value(draw, 2)]} for i in range(60)} | {"empty": {}}
    path = tmp_path / "cache.json"
    path.write_text(json.dumps({"identity": known, "records": records}, indent=2))
    assert spark.read.option("lineSep", '"').text(str(path)).rdd.getNumPartitions() > 20
    header, rows = json_stream.read_records(spark, str(path))
    assert {r.id: json.loads(r.value) for r in header.collect()} == known
    assert {r.id: json.loads(r.value) for r in rows.collect()} == records and rows.count() == len(records)
    path.write_text(json.dumps({"format": 2, "a": {"x": 1}, "b": {}, "c": [], "last": "z"}).replace("[]", "null"))
    got = {(r.parent, r.id, r.value) for r in json_stream.read_large(spark, str(path), 2).collect()}
    assert got == {(None, "format", "2"), ("a", "x", "1"), (None, "c", "null"), (None, "last", '"z"')}


@pytest.mark.parametrize("text,level", [
    ('{"a": 1, "b": 2, "a": 3}', 1), ('{"a": {"x": 1, "x": 2}}', 1), ('{"a": NaN}', 1), ("[1, 2]", 1), ('{"a": 1', 1), ('{"a": 1}}', 1),
    ('{"a": 1,}', 1), ('{"a": 1} x', 1), ('{"a"}', 1), ("", 1), ('"a"', 1), ('{"a": "x}', 1), ('{, "a": 1}', 1),
    ('{"a": {"k": 1}, "a": {"l": 1}}', 2), ('{"a": {"k": 1, "k": 2}}', 2), ('{"a": {"k": 1} "b": {}}', 2), ('{"a": [1]}', 2), ('{"a": {},}', 2)])
def test_broken_objects_are_refused(spark, tmp_path, small_ranges, text, level):
    (tmp_path / "x.json").write_text(text.replace(", ", "," + " " * 120))
    with pytest.raises(Exception, match="(?s)JSON|object|member|nothing|Expecting|comma|NaN|empty|text around|value|delimiter"):
        json_stream.read_large(spark, str(tmp_path / "x.json"), level).count()


# --- batches ---------------------------------------------------------------------------------------------------------------

DOCS = [(i, f"p{i % 9}", f"s{i % 3}", " ".join(random.Random(i).choices("mức phạt tiền hồ sơ xe máy đất thuế phí lương quỹ".split(), k=25))) for i in range(60)]


@pytest.fixture(scope="module")
def job(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("job")
    chunks = spark.createDataFrame([(*d, 0, len(d[3])) for d in DOCS], "chunk_id long, parent_id string, header string, text string, start int, end int")
    parents = chunks.groupBy("parent_id").agg(F.first("text").alias("text"))
    sinks.write_index(chunks, parents, f"{root}/index", block_chunks=4)
    questions = spark.createDataFrame([(i, " ".join(DOCS[i][3].split()[:5])) for i in range(0, 60, 7)] + [(99, "nothing here")], batch.QUESTION)
    questions.repartition(3).write.parquet(f"{root}/queue")
    return root, sinks.read_index(spark, f"{root}/index"), questions


def plain(rows):
    return sorted((r.qid, r.question, tuple((k, tuple(v)) for k, v in sorted(r.stages.items())), str(r.contexts)) for r in rows.collect())


def test_interrupted_batches_give_the_same_records(spark, job):
    root, index, questions = job
    cfg = Retrieval(broad_k=10, precise_k=5, lexical_pool_k=6)
    known = batch.identity(questions, index, cfg)
    want = plain(batch.records(questions, index, cfg))
    written = []

    def lost(number):
        written.append(number)
        if written == [0, 1]:
            raise RuntimeError("executor lost")

    for limit, error in ((1, batch.Interrupted), (None, RuntimeError)):
        with pytest.raises(error):
            batch.run(spark, f"{root}/queue", f"{root}/out", index, cfg, known, limit, lost)
    rows = batch.run(spark, f"{root}/queue", f"{root}/out", index, cfg, known, None, lost)
    assert written == [0, 1, 1, 2] and plain(rows) == want
    assert plain(batch.run(spark, f"{root}/queue", f"{root}/out", index, cfg, known, None, lost)) == want and written == [0, 1, 1, 2]
    by_id = {r.qid: r for r in rows.collect()}
    assert by_id[99].contexts is None and by_id[99].stages["rrf"] == [] and by_id[7].stages["reranked"] and len(by_id[7].contexts) <= cfg.parents_k
    ranked = lexical.rankings(index.chunks, lexical.Questions.of(questions), cfg).where("qid = 7 AND branch = 'bm25'").orderBy("rank")
    assert by_id[7].stages["bm25"] == [r.chunk_id for r in ranked.collect()]
    with pytest.raises(ValueError, match="changed"):
        batch.run(spark, f"{root}/queue", f"{root}/out", index, Retrieval(), batch.identity(questions, index, Retrieval()))
    # The records may be used again under the same identity only.
    cache = batch.with_identity(rows)
    assert batch.reusable(questions, cache, known).count() == questions.count()
    with pytest.raises(ValueError, match="index"):
        batch.reusable(questions, cache, known | {"index": "another"})


def test_every_cache_check_can_fail(spark):
    good = {"models": "m", "retrieval": "r", "code": "c", "mode": "lexical", "mode_config": "24", "index": "i"}
    changes = [{}, {"models": "x"}, {"retrieval": "x"}, {"code": None}, {"mode": "full", "mode_config": None}, {"mode_config": "9"}, {"index": "x"}, {"mode": "full", "mode_config": "9"}]
    rows = [(i, "q", good | c) for i, c in enumerate(changes)] + [(20, "other", good), (30, "left out", good)]
    cache = spark.createDataFrame(rows, "qid long, question string, identity map<string,string>")
    questions = spark.createDataFrame([(i, "q") for i in (*range(len(changes)), 20, 21)], batch.QUESTION)
    judged = {r.qid: r.violations for r in batch.checked(questions, cache, good).collect()}
    assert judged == {0: [], 1: ["models"], 2: ["retrieval"], 3: ["code"], 4: ["mode"], 5: ["mode_config"], 6: ["index"], 7: ["mode"], 20: ["question"], 21: ["missing"]}
    free = {r.qid: r.violations for r in batch.checked(questions, cache, good | {"mode": None, "index": None}).collect()}
    assert free[4] == free[6] == [] and free[5] == ["mode_config"]
    with pytest.raises(ValueError, match="'missing': 1, 'question': 1, 'models': 1, 'retrieval': 1, 'code': 1, 'mode': 2"):
        batch.reusable(questions, cache, good)
    assert {r.check: (r.n, r.first_qid) for r in batch.violations(batch.checked(questions, cache, good)).collect()}["mode"] == (2, 4)


# --- snapshots --------------------------------------------------------------------------------------------------------------


def test_every_snapshot_problem_is_found(spark):
    import hashlib
    import io
    import zipfile

    from quillsift.sources import snapshots

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name in ("a.txt", "d/b.txt", "/abs", "../up", "c:/x", "d\\w", "x/../y", "twice", "twice", "long", "odd", "extra", "d/"):
            archive.writestr(zipfile.ZipInfo(name), "" if name.endswith("/") else f"text of {name}")
    raw = bytearray(out.getvalue())
    at = raw.index(b"text of d/b.txt")
    raw[at] ^= 1
    archives = spark.createDataFrame([("one", bytes(raw)), ("two", b"no archive")], "archive string, content binary")
    stated = lambda path, text=None: ("one", path, len(text or f"text of {path}"), hashlib.sha256((text or f"text of {path}").encode()).hexdigest())
    manifest = spark.createDataFrame([stated(n) for n in ("a.txt", "d/b.txt", "twice", "gone", "model.bin")] + [stated("long", "x"), stated("odd", "TEXT OF odd")],
                                     "archive string, path string, size long, sha256 string")
    members = snapshots.listing(archives)
    assert members.where("NOT safe AND sha256 IS NOT NULL").isEmpty()
    got = {(r.archive, r.path): r.problem for r in snapshots.violations(members, manifest, F.col("path").endswith(".bin")).collect()}
    assert got == {("one", "d/b.txt"): "corrupt", ("one", "/abs"): "unsafe", ("one", "../up"): "unsafe", ("one", "c:/x"): "unsafe", ("one", "d\\w"): "unsafe",
                   ("one", "x/../y"): "unsafe", ("one", "twice"): "duplicate", ("one", "gone"): "missing", ("one", "long"): "size", ("one", "odd"): "hash",
                   ("one", "extra"): "unlisted", ("two", None): "corrupt"}
    assert set(got.values()) == set(snapshots.PROBLEMS)
