import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillsift.config import Chunking
from quillsift.operators import corpus
from quillsift.plans.retrieval import Corpus
from quillsift.sources import json_objects as jo


def _doc(spark, text, doc_id="7"):
    return spark.createDataFrame([(doc_id, text)], "doc_id string, text string")


def test_parents_at_article_lines(spark):
    rows = corpus.parents(_doc(spark, "Số: 5868/QĐ-BYT\nĐiều 1. Nhiệm vụ\nA\nĐiều 2. Hiệu lực\nB")).orderBy("ordinal").collect()
    assert [(r.parent_id, r.heading, r.number) for r in rows] == [
        ("7:0", "", "5868/QĐ-BYT"), ("7:1", "Điều 1. Nhiệm vụ", "5868/QĐ-BYT"), ("7:2", "Điều 2. Hiệu lực", "5868/QĐ-BYT")]
    whole = corpus.parents(_doc(spark, "điều 5. Mở đầu\nX")).collect()
    assert len(whole) == 1 and whole[0].ordinal == 0 and whole[0].heading == "điều 5. Mở đầu"
    assert corpus.parents(_doc(spark, "https://x.vn/van-ban-123/2020")).first().number == ""


@pytest.mark.parametrize("n", [0, 1, 5, 19, 20, 21, 35, 36, 50, 51, 70])
def test_windows_equal_a_plain_loop(spark, n):
    text = "".join(f"w{i}" + (" " if i % 3 else "\n ") for i in range(n)).strip()
    spans, at = [], 0
    for i in range(n):
        a = text.index(f"w{i}", at)
        at = a + len(f"w{i}")
        spans.append((a, at))
    want, start = [], 0
    while start < n:
        end = min(start + 20, n)
        want.append((spans[start][0], spans[end - 1][1], text[spans[start][0]:spans[end - 1][1]]))
        if end == n:
            break
        start += 15
    got = corpus.windows(_doc(spark, text), Chunking(20, 5, 4)).orderBy("window").collect()
    assert [(r.start, r.end, r.chunk) for r in got] == want


def test_first_passages_and_report(spark):
    docs = spark.createDataFrame([(3, "x"), (1, "x"), (2, ""), (4, "y")], "doc_id long, text string")
    assert {r.doc_id for r in corpus.first_passages(docs).collect()} == {1, 4}
    r = corpus.corpus_report(docs).first()
    assert (r.documents, r.duplicate_passages, r.empty_documents) == (2, 1, 1)
    twice = docs.union(docs.where("doc_id = 4"))
    assert [x.doc_id for x in corpus.duplicate_ids(twice).collect()] == [4]


def test_neighbours_stay_inside_the_document(spark):
    rows = spark.createDataFrame([(f"{d}:{p}", d, p) for d in "ab" for p in range(3)], "parent_id string, doc_id string, position int")
    seeds = spark.createDataFrame([("a", 1)], "doc_id string, position int")
    assert {r.parent_id for r in corpus.neighbours(rows, seeds).collect()} == {"a:0", "a:2"}


def test_header_is_cut(one):
    assert one(lambda c: corpus.header(F.lit("1/QĐ"), c, 3), "Điều 1. Mở đầu", "") == ["1/QĐ Điều 1.", "1/QĐ"]


def test_corpus_files(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    docs = {"context_1.json": {"id": 1, "name": None, "passage": "A\r\nB"}, "deep/context_2.json": {"id": "2", "passage": None}}
    for name, value in docs.items():
        (tmp_path / "in" / name).write_text("﻿" + json.dumps(value), encoding="utf-8")
    (tmp_path / "in" / "other.json").write_text("[]")
    rows = corpus.parse_documents(jo.read_corpus(spark, str(tmp_path / "in"))).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text, r.source_file) for r in rows] == [("1", "A\n\nB", "context_1.json"), ("2", "", "deep/context_2.json")]
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("context_9.json", json.dumps({"id": 9, "passage": "Z"}))
        z.writestr("__MACOSX/context_9.json", "junk")
    assert [r.id for r in jo.read_corpus(spark, str(tmp_path / "c.zip")).collect()] == ["9"]


def test_strict_json(spark, tmp_path):
    for bad in ('{"1":1,"1":2}', '{"a":NaN}', '[1]'):
        with pytest.raises(ValueError):
            jo.strict_object(bad)
    p = tmp_path / "q.json"
    p.write_text(json.dumps({"1": {"question": "Gì?", "answer": " Đáp "}, "2": {"question": "Sao?", "answer": "x"}}), encoding="utf-8")
    assert {(r.id, r.answer) for r in jo.read_questions(spark, str(p), answers=True).collect()} == {("1", " Đáp "), ("2", "x")}
    p2 = tmp_path / "r.json"
    p2.write_text(json.dumps({"1": "a", "2": {"answer": "b"}}))
    assert {(r.id, r.answer) for r in jo.read_references(spark, str(p2)).collect()} == {("1", "a"), ("2", "b")}
    p3 = tmp_path / "bad.json"
    p3.write_text(json.dumps({"1": {"question": "  "}}))
    with pytest.raises(ValueError):
        jo.read_questions(spark, str(p3))


def test_fetched_chunks_equal_the_full_pass(spark):
    docs = spark.createDataFrame([(i, f"tài liệu {i} " + "từ " * (100 * i), "s") for i in range(6)], "doc_id long, text string, source string")
    c = Corpus(docs)
    everything = {r.chunk_id: r.text for r in c.chunks().collect()}
    some = spark.createDataFrame([(k,) for k in everything if k >> 24 in (2, 5)], "chunk_id long")
    for rows in (10, 10**9):
        got = {r.chunk_id: r.text for r in c.chunks_of(some, rows).collect()}
        assert got == {k: v for k, v in everything.items() if k >> 24 in (2, 5)}
