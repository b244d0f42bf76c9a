import pytest

import __spark_entry__ as entry
from oracle.compare import compare, duck

SMALL = "/root/testdata/sf0.001"
CHECKED = ("chunk_windows", "bm25_topk", "dense_knn", "clean_answer", "local_evidence_support", "hash_order_split", "journal_pending")


def test_every_twin_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 50


def test_entry(spark):
    assert entry.entry(spark).columns == ["qid", "chunk_id", "rank", "score"]


@pytest.mark.parametrize("name", CHECKED)
def test_twins_agree(spark, name):
    line = compare(spark, duck(SMALL), name, entry.queries()[name], entry.oracle_sql()[name], SMALL)
    assert line.endswith("OK"), line
