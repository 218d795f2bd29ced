import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def make_spark() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .appName("foliospark-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Columns can only be built inside a session, and test modules build some on import.
_SESSION = make_spark() if "pytest" in sys.argv[0] or "PYTEST_VERSION" in os.environ else None


@pytest.fixture(scope="session")
def spark():
    yield _SESSION
    _SESSION.stop()
