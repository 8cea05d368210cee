import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from acclaim.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "acclaim-tests", master="local[8]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Apply a Column function to Python strings and return the results in order."""

    def run(fn, *texts):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        return [r.o for r in df.select("i", fn(F.col("t")).alias("o")).orderBy("i").collect()]

    return run
