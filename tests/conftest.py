import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from dotloom.session import local_session

    return local_session("tests", 8, 8)


@pytest.fixture
def apply(spark):
    """Apply a column function to literal strings, in order."""
    from pyspark.sql import functions as F

    def run(fn, values):
        df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
        return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]

    return run
