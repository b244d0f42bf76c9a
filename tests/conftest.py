import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quillsift import build_session  # noqa: E402
from quillsift.session import ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", spark__driver__memory="4g", spark__ui__enabled="false",
                            spark__sql__shuffle__partitions="4", spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate a column expression on single texts: ``one(fn, "a", "b") -> [fn(a), fn(b)]``."""
    from pyspark.sql import functions as F

    def run(fn, *texts):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        return [r.v for r in rows.select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()]

    return run
