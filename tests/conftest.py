import os
import sys

import pytest
from pyspark.sql import SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
# Python workers import the test modules that define the functions they run
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (HERE, os.environ.get("PYTHONPATH")) if p)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("trialkit-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def skewed(spark):
    """Three groups and a NULL one; the first holds more than a third of the rows; many equal values."""
    import random

    rng = random.Random(7)
    rows = []
    for i in range(3000):
        key = rng.choice(["hot", "hot", "hot", "a", "b", None])
        value = rng.choice([1.0, 2.0, round(rng.lognormvariate(0, 1), 3)])
        rows.append((i, key, value))
    return spark.createDataFrame(rows, "id long, k string, v double")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
