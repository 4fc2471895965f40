"""Joins of points with spans by blocks of time give the rows of the plain join."""

import random
from datetime import datetime, timedelta
from statistics import median

import pytest
from pyspark.sql import functions as F

from stagewise.operators.match import attribute_within, followed_by
from stagewise.operators.skew import HotGroups
from stagewise.operators.spans import in_blocks
from tests.conftest import values

START = datetime(2024, 1, 1)


def table(spark, seed, n, names="id long, key string, at timestamp"):
    """A third of the rows has one key; some have no key or no time; many share an instant."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", "d", None])
        minutes = 600 if i % 9 == 0 else rng.randrange(60 * 24 * 60)
        rows.append((i, key, START + timedelta(minutes=minutes) if i % 31 else None))
    return spark.createDataFrame(rows, names)


def following(spark, hot_rows=10**6, hot=None):
    left = table(spark, 1, 240).withColumns({
        "next_at": F.when(F.col("id") % 4 > 0, F.col("at") + F.make_dt_interval(F.col("id") % 20)),
        "is_first": F.when(F.col("id") % 5 > 0, F.col("id") % 10 == 1),
    })
    # a repeated row stays repeated
    left = left.unionByName(left.where("id < 12"))
    right = table(spark, 2, 150, "other long, key string, start timestamp")
    end = F.col("at") + F.expr("interval 9 days")
    return followed_by(left, right, "key", "at", "start", end, "next_at", "2999-12-31", "is_first", hot, hot_rows)


@pytest.mark.parametrize("hot_rows", [0, 90])
def test_followed_by_in_blocks(spark, hot_rows):
    plain = values(following(spark, hot=HotGroups(None)))
    assert values(following(spark, hot_rows)) == plain and len(plain) > 300


def touched(spark, hot_rows=10**6, hot=None):
    left = table(spark, 3, 240).unionByName(table(spark, 3, 10))
    touches = table(spark, 4, 60, "touch long, key string, since timestamp")
    return attribute_within(left, touches.unionByName(touches), "key", "at", "since", "interval 12 days", hot, hot_rows)


@pytest.mark.parametrize("hot_rows", [0, 70])
def test_attribute_within_in_blocks(spark, hot_rows):
    plain = values(touched(spark, hot=HotGroups(None)))
    assert values(touched(spark, hot_rows)) == plain and len(plain) > 1000


def test_without_rows(spark):
    some, none = table(spark, 5, 30), table(spark, 5, 30, "touch long, key string, since timestamp").limit(0)
    kept = attribute_within(some, none, "key", "at", "since", "interval 1 day", hot_rows=0)
    assert values(kept.drop("touch", "since")) == values(some)
    assert attribute_within(some.limit(0), none, "key", "at", "since", "interval 1 day", hot_rows=0).isEmpty()


def test_blocks_of_one_person_are_about_equal(spark):
    points = spark.range(20_000).selectExpr("'hot' AS key", "timestamp_seconds(1704067200 + pow(id, 1.5)) AS at")
    spans = spark.range(500).selectExpr(
        "'hot' AS key", "timestamp_seconds(1704067200 + pow(id * 40, 1.5)) AS lo", "timestamp_seconds(1704067200 + pow(id * 40 + 90, 1.5)) AS hi"
    )
    numbered, copied = in_blocks(points, spans, "key", F.col("at"), F.col("lo"), F.col("hi"), 64)
    sizes = [r["count"] for r in numbered.groupBy("_block").count().collect()]
    assert len(sizes) == 64 and max(sizes) < 1.5 * median(sizes)
    # short spans touch few blocks
    assert copied.count() < 3 * 500 and numbered.count() == 20_000
