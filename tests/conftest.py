import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from recordaudit.session import local_session

    s = local_session(cores=8, shuffle_partitions=8, app="recordaudit-tests")
    yield s


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a single Column expression over a one-column string frame."""
    def run(values, fn, dtype="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
        return [r["o"] for r in df.select("i", fn(df["v"]).alias("o")).orderBy("i").collect()]
    return run
