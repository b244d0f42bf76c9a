import pytest

ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "one two"), (5, "one two"), (None, "three four five six"),
       (7, "1234 5678 !!!"), (8, "long " * 40_000), (9, "x" * 150_000), (10, "Ünï çødé ﬁ 漢字 \U0001F600 end")]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names operators use themselves."""
    rows = [(i, t, None if k % 3 == 0 else "s", k) for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, n int").selectExpr(
        "doc_id", "text", "source", "'en' AS lang", "n AS size", "n AS key", "n AS score", "n AS ids", "n AS kept", "n AS target")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
