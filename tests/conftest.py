import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]
# Python workers import the test modules that define plug-ins.
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH", "")])

from labelwright.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark("labelwright-tests", 8, spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def value_of(spark):
    """Evaluate a column over single-column inputs: value_of(fn, [inputs], type) -> [results]."""
    from pyspark.sql import functions as F

    def run(fn, inputs, kind="string"):
        rows = list(enumerate(inputs))
        df = spark.createDataFrame(rows, f"i int, x {kind}").select("i", fn(F.col("x")).alias("y"))
        return [r["y"] for r in sorted(df.collect(), key=lambda r: r["i"])]

    return run
