from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tracelight.session import build_session

    session = build_session("tests", master="local[8]", shuffle_partitions=4, spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                            spark__driver__memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def lines(spark):
    """Line table from texts of one file."""
    from pyspark.sql import functions as F

    from tracelight.sources.lines import lines_from

    def make(texts, name="sample.log"):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts, 1)], "n int, t string")
        return lines_from(rows, F.col("t"), name, F.col("n"))

    return make
