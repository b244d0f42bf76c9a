"""The corpus pipeline on a small folder with odd rows, and on empty tables."""

import hashlib
import itertools
import re

import pytest

import corpus_pipeline
from quillsift.llm import bpe

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with an extra column, nulls, an empty text, copies and a repeated row."""
    root = str(tmp_path_factory.mktemp("small"))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("*", "'x' AS score")
    plain = docs.where("length(text) > 300").orderBy("doc_id").limit(1)
    odd = docs.limit(3).selectExpr("100000 + doc_id AS doc_id", "if(doc_id % 2 = 0, null, '') AS text", "cast(null AS string) AS lang",
                                   "cast(null AS string) AS source", "n_chars", "score")
    copy = plain.selectExpr("200000L AS doc_id", "text", "lang", "source", "n_chars", "score")
    docs.unionByName(odd).unionByName(copy).unionByName(plain).write.parquet(f"{root}/documents.parquet")
    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(f"{root}/labels.parquet")
    return root


def test_every_stage_keeps_columns_and_decides(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, seen[-1], folder).write.parquet(f"{tmp_path}/{name}")
        seen.append(spark.read.parquet(f"{tmp_path}/{name}"))
    before, toxic, spoken, apart, mixed, encoded = seen
    assert all(x.columns == docs.columns for x in (toxic, spoken, apart, mixed))
    assert spoken.where("text IS NULL OR trim(text) = ''").isEmpty() and spoken.count() >= 0.8 * before.count()
    texts = apart.select("text").collect()
    assert len(texts) == len({r.text for r in texts}) and apart.where("doc_id = 200000").isEmpty()
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts and max(counts.values()) <= 3 and set(counts) <= {r.doc_id for r in apart.select("doc_id").collect()}
    by_id = {r.doc_id: r.text for r in mixed.select("doc_id", "text").collect()}
    coder = bpe.encoding(bpe.public_tokenizers.path(bpe.VOCABULARY))
    rows = encoded.collect()
    assert len(rows) == mixed.count() and encoded.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    for r in rows:
        ids = coder.encode(by_id[r.doc_id], disallowed_special=())
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(by_id[r.doc_id].encode()).hexdigest()
    # The whole run does the same, twice.
    key = lambda r: tuple(map(str, r))
    assert sorted(corpus_pipeline.run(spark, folder).collect(), key=key) == sorted(rows, key=key)


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "ids_sha256" in out.columns


def test_a_task_needs_one_python_worker(spark, folder):
    """Two Python steps without a shuffle between them hold two workers in every running task."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plan = corpus_pipeline.encode_tokens(spark, docs, folder)._jdf.queryExecution().sparkPlan().toString().splitlines()
    at = [(m.start(1), m[1]) for m in (re.match(r"[ :+-]*(\w+)", line) for line in plan) if m]
    assert any(name == "MapInArrow" for _, name in at)
    for k, (depth, name) in enumerate(at):
        inner = [n for _, n in itertools.takewhile(lambda x: x[0] > depth, at[k + 1:])]
        if name == "MapInArrow" and name in inner:
            assert {"Exchange", "ObjectHashAggregate"} & set(inner[:inner.index(name)])
