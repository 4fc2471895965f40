"""Tasks stay small where groups are, and no step is worked out twice for a sort."""

import pytest
from pyspark.sql import functions as F

from stagewise.operators import skew
from stagewise.operators.periods import FlagColumns, period_flags
from stagewise.operators.renumber import unequal
from stagewise.operators.skew import HotGroups, find_hot, stage_watched
from stagewise.session import Workspace
from stagewise.sources.tables import write_fact
from tests.conftest import values

COLS = FlagColumns(ties=("row",))


@pytest.fixture
def table(spark):
    return spark.range(600).selectExpr(
        "'p' || id % 90 AS phone",
        "'s' || id % 3 AS subject_name",
        "TIMESTAMP '2024-01-01' + make_interval(0, 0, 0, 0, CAST(id % 700 AS INT)) AS lead_created",
        "IF(id % 2 = 0, DATE '2024-01-05', NULL) AS trial_created_at",
        "IF(id % 2 = 0, 1, 2) AS union_rn",
        "id AS lesson_id",
        "id AS row",
    )


def test_flags_are_numbered_in_tasks_of_bounded_size(spark, table, monkeypatch):
    monkeypatch.setattr(skew, "TASK_ROWS", 50)
    with Workspace(spark) as work:
        staged, hot = stage_watched(table, "rows", ["phone"], work)
        assert hot["phone"].rows == find_hot(table, ["phone"]).rows == 600
        flagged = period_flags(staged, COLS, hot=hot["phone"])
        sizes = [r["n"] for r in flagged.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert flagged.rdd.getNumPartitions() == 13 and max(sizes) < 150
        assert values(flagged) == values(period_flags(table, COLS, hot=HotGroups(None)))


def test_a_fact_is_worked_out_once_for_its_sort(spark, table, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def passed(row):
        seen.add(1)
        return row

    fact = table.repartition(4).withColumn("lesson_id", F.udf(passed, "long")("lesson_id"))
    write_fact(fact, f"{tmp_path}/fact")
    assert seen.value == 600
    stored = spark.read.parquet(f"{tmp_path}/fact")
    assert values(stored.select("row", "phone", "lesson_id")) == values(table.select("row", "phone", "lesson_id"))
    write_fact(fact, f"{tmp_path}/loose", ordered=False)
    assert values(spark.read.parquet(f"{tmp_path}/loose")) == values(stored)


def test_unequal_rows(rows):
    a = rows("k int, v string", [(1, "a"), (1, "a"), (2, None), (3, "c")])
    b = rows("v string, k int", [("a", 1), (None, 2), ("d", 4)])
    assert values(unequal(a, b)) == [(1, "a"), (3, "c"), (4, "d")]
    assert unequal(a, a).isEmpty()


def test_large_groups_without_a_key(rows):
    assert skew.named_keys(None) is None and skew.named_keys(rows("phone string", [(None,)])) is None
    assert values(skew.named_keys(rows("phone string", [(None,), ("a",)]))) == [("a",)]
