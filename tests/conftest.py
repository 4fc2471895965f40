import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402

from stagewise.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture
def rows(spark):
    """Build a DataFrame from a DDL schema and tuples; text casts to times."""

    def build(schema: str, data):
        fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
        loose = ", ".join(f"{n} {'string' if t in ('timestamp', 'date') else t}" for n, t in fields)
        return spark.createDataFrame(list(data), loose).selectExpr(*[f"CAST({n} AS {t}) AS {n}" for n, t in fields])

    return build


def values(df):
    """Rows as a sorted list of tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
