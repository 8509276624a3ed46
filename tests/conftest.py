import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from trapline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", "trapline-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture
def rows(spark):
    """Make a DataFrame from tuples and a DDL schema, spread over several partitions."""

    def make(data, schema, partitions=4):
        return spark.createDataFrame(data, schema).repartition(partitions)

    return make


@pytest.fixture
def evaluate(spark):
    """Apply a column expression to literal values of one type, keeping their order."""

    def run(values, kind, build):
        from pyspark.sql import functions as F

        data = list(enumerate(values))
        df = spark.createDataFrame(data, f"i int, v {kind}")
        return [r[0] for r in df.orderBy("i").select(build(F.col("v"))).collect()]

    return run
