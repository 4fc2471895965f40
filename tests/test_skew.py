"""Groups cut into slices give the same rows as one window per group."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stagewise.operators import skew
from stagewise.operators.keyed import next_event
from stagewise.operators.match import Other, asof, nearest_match
from stagewise.operators.periods import LEAD_SLICE, REQUEST_SLICE, FlagColumns, in_slices, period_flags
from stagewise.operators.skew import HotGroups, find_hot
from stagewise.session import Workspace
from tests.conftest import values

START = datetime(2024, 1, 1)


def moments(rng, n):
    """Times with ties: many share a minute, and minutes spread over days."""
    return [START + timedelta(minutes=rng.choice([rng.randrange(90), rng.randrange(60 * 24 * 40)])) for _ in range(n)]


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(7)
    times = moments(rng, 600)
    # a third of the rows belong to one key, some have no key
    keys = [rng.choice(["hot", "hot", "a", "b", "c", None]) for _ in times]
    return spark.createDataFrame(
        [(i, k, t if i % 50 else None, rng.randrange(3)) for i, (k, t) in enumerate(zip(keys, times))],
        "id long, key string, at timestamp, subject int",
    )


def test_find_hot_lists_large_groups_only(events):
    assert find_hot(events, ["key"], 10_000).keys is None
    assert [r.key for r in find_hot(events, ["key"], 150).keys.collect()] == ["hot"]


@pytest.mark.parametrize("hot_rows", [0, 100])
def test_next_event(events, hot_rows):
    plain = next_event(events, ["key"], "at", ["id"], hot=HotGroups(None))
    assert values(next_event(events, ["key"], "at", ["id"], hot_rows=hot_rows)) == values(plain)


def test_large_groups_come_with_the_staging_write(spark, events):
    with Workspace(spark) as work:
        staged, hot = skew.stage_watched(events, "events", ["key", "id"], work, 150)
        assert values(staged) == values(events)
        assert [r.key for r in hot["key"].keys.collect()] == ["hot"] and hot["id"].keys is None
        # NULL is a group too; nothing is large in a table of no rows
        nulls = events.withColumn("key", F.when(F.col("key") != "hot", F.col("key")))
        assert [r.key for r in skew.stage_watched(nulls, "nulls", ["key"], work, 150)[1]["key"].keys.collect()] == [None]
        assert skew.stage_watched(events.limit(0), "none", ["key"], work, 0)[1]["key"].keys is None
        known = skew.stage_watched(events, "again", ["key"], work, 10)[1]["key"]
        plain = next_event(events, ["key"], "at", ["id"], hot=HotGroups(None))
        assert values(next_event(events, ["key"], "at", ["id"], hot=known, work=work)) == values(plain)


def test_groups_beyond_the_summary_are_counted(spark, events, monkeypatch):
    monkeypatch.setattr(skew, "SURE", 1)
    with Workspace(spark) as work:
        hot = skew.stage_watched(events, "events", ["key"], work, 150)[1]["key"]
        assert [r.key for r in hot.keys.collect()] == ["hot"]


def test_merged_lists(spark):
    one, two = spark.createDataFrame([("a",), ("b",)], "x string"), spark.createDataFrame([("b",), (None,)], "y string")
    assert values(skew.merged_hot("key", one, None, two).keys) == [("a",), ("b",), (None,)]
    assert skew.merged_hot("key", None, None).keys is None


def test_long_lists_of_hot_keys_are_not_broadcast(events, monkeypatch):
    monkeypatch.setattr(skew, "MAX_BROADCAST_KEYS", 0)
    plain = next_event(events, ["key"], "at", ["id"], hot=HotGroups(None))
    assert values(next_event(events, ["key"], "at", ["id"], hot_rows=0)) == values(plain)


@pytest.mark.parametrize("direction", ["next", "prev"])
def test_asof_against_brute_force(events, direction):
    left = events.where("id % 2 = 0").select("key", "id", "at")
    right = events.where("id % 2 = 1").selectExpr("key", "id AS rid", "at AS rat", "subject")
    one = Other(right, "rat", "rid", "m")
    found = asof(left, one, ["key"], "at", direction, hot_rows=100)
    plain = asof(left, one, ["key"], "at", direction, HotGroups(None))
    assert values(found) == values(plain)
    two = asof(left, [Other(right.where("subject = 0"), "rat", "rid", "z"), one], ["key"], "at", direction, hot_rows=100)
    assert values(two.drop("z")) == values(plain)

    rights = [tuple(r) for r in right.collect() if r.key is not None and r.rat is not None]
    for row in found.collect():
        if row.key is None or row.at is None:
            assert row.m is None
            continue
        mine = [r for r in rights if r[0] == row.key]
        if direction == "next":
            best = min(((r[2], r[1]) for r in mine if r[2] > row.at), default=None)
        else:
            best = max(((r[2], r[1]) for r in mine if r[2] < row.at), default=None)
        assert (None if row.m is None else (row.m.rat, row.m.rid)) == best


@pytest.mark.parametrize("side", ["lead", "request"])
def test_nearest_match(events, side):
    leads = events.where("id % 2 = 0").selectExpr("key", "id AS lead_id", "at AS lead_at")
    requests = events.where("id % 2 = 1").selectExpr("key", "id AS rid", "at AS rat", "subject")
    args = (leads, requests, "key", "lead_at", "lead_id", "rat", "rid", "subject", 86_400, side)
    assert values(nearest_match(*args, hot_rows=50)) == values(nearest_match(*args, hot=HotGroups(None)))


@pytest.mark.parametrize("exact", [False, True])
def test_period_flags(spark, exact):
    rng = random.Random(11)
    data = []
    for i, at in enumerate(moments(rng, 500)):
        requested = rng.random() < 0.5
        person = rng.choice(["hot", "hot", "x", "y", None])
        if rng.random() < 0.05:
            at = datetime(2017, 12, 30)
        day = (at + timedelta(days=rng.randrange(9))).date() if requested else None
        request = rng.randrange(10**7) if requested else None
        data.append((i, person, rng.choice(["math", "english", None]), day, at, 1 if requested else 2, request))
    df = spark.createDataFrame(
        data,
        "row long, phone string, subject_name string, trial_created_at date, lead_created timestamp, "
        "union_rn int, lesson_id long",
    )
    cols = FlagColumns(ties=("row",))
    plain = period_flags(df, cols, exact_daily_lead=exact, hot=HotGroups(None))
    for hot_rows in (0, 120):
        assert values(period_flags(df, cols, exact_daily_lead=exact, hot_rows=hot_rows)) == values(plain)


def test_slices_of_a_hot_group_stay_small(spark):
    """Rows without a request, sparse request ids, and a bulk import inside one hour."""
    day = "date_add(DATE '2024-01-01', CAST(id % 3 AS INT))"
    df = spark.range(30_000).selectExpr(
        "'hot' AS phone",
        "'math' AS subject_name",
        f"IF(id % 2 = 0, {day}, NULL) AS trial_created_at",
        "TIMESTAMP '2024-01-05 10:00:00' + make_dt_interval(0, 0, 0, id / 10) AS lead_created",
        "IF(id % 2 = 0, 1, 2) AS union_rn",
        "IF(id % 2 = 0, id * 7000000, NULL) AS lesson_id",
        "id AS row",
    )
    cols = FlagColumns(ties=("row",))
    cut = in_slices(df, cols)
    for slices in ([*LEAD_SLICE], ["trial_created_at", *REQUEST_SLICE]):
        sizes = cut.groupBy("phone", "subject_name", "union_rn", *slices).count()
        assert sizes.agg({"count": "max"}).first()[0] <= 30_000 / 64
    plain = period_flags(df, cols, hot=HotGroups(None))
    assert values(period_flags(df, cols, hot_rows=1000)) == values(plain)


@pytest.fixture(scope="module")
def instant(spark):
    """One key, one instant: a bulk import of 20,000 rows, told apart by their ids only."""
    return spark.range(20_000).selectExpr(
        "IF(id % 10 = 0, 'other', 'hot') AS key", "id * 7919 % 20011 AS id", "TIMESTAMP '2024-01-05 10:00:00' AS at"
    )


def largest_block(df, by):
    return df.groupBy(*by).count().agg({"count": "max"}).first()[0]


def test_rows_of_one_instant_are_cut(instant):
    cut = skew.with_blocks(instant, ["key"], {"_slice": [F.col("at"), F.col("id")]})
    sizes = sorted(r["count"] for r in cut.where("key = 'hot'").groupBy("_slice").count().collect())
    assert len(sizes) > 200 and sizes[-1] <= 4 * sizes[len(sizes) // 2]
    ends = cut.where("key = 'hot'").groupBy("_slice").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).orderBy("_slice")
    ends = ends.collect()
    assert all(a.hi < b.lo for a, b in zip(ends, ends[1:]))


def test_next_event_of_one_instant(instant):
    rows = instant.withColumn("at", F.when(F.col("id") % 5 > 0, F.col("at")))
    plain = next_event(rows, ["key"], "at", ["id"], hot=HotGroups(None))
    assert values(next_event(rows, ["key"], "at", ["id"], hot_rows=5000)) == values(plain)


@pytest.mark.parametrize("direction", ["next", "prev"])
def test_asof_of_one_instant(instant, direction):
    """Both sides meet in two instants a second apart, most rows in the first."""
    shifted = instant.withColumn("at", F.when(F.col("id") % 50 == 0, F.expr("at + interval 1 second")).otherwise(F.col("at")))
    left = shifted.where("id % 2 = 0").select("key", "id", "at")
    other = Other(shifted.where("id % 2 = 1").selectExpr("key", "id AS rid", "at AS rat"), "rat", "rid", "m")
    plain = asof(left, other, ["key"], "at", direction, HotGroups(None))
    assert values(asof(left, other, ["key"], "at", direction, hot_rows=5000)) == values(plain)


@pytest.mark.parametrize("exact", [False, True])
def test_period_flags_of_one_instant(spark, exact):
    df = spark.range(12_000).selectExpr(
        "'hot' AS phone",
        "IF(id % 3 = 0, 'math', 'english') AS subject_name",
        "IF(id % 2 = 0, DATE '2024-01-06', NULL) AS trial_created_at",
        "TIMESTAMP '2024-01-05 10:00:00' AS lead_created",
        "IF(id % 2 = 0, 1, 2) AS union_rn",
        "IF(id % 2 = 0, id % 7, NULL) AS lesson_id",
        "id AS row",
    )
    cols = FlagColumns(ties=("row",))
    cut = in_slices(df, cols)
    for slices in ([*LEAD_SLICE], ["trial_created_at", *REQUEST_SLICE]):
        assert largest_block(cut, ["union_rn", *slices]) <= 12_000 / 64
    plain = period_flags(df, cols, exact_daily_lead=exact, hot=HotGroups(None))
    assert values(period_flags(df, cols, exact_daily_lead=exact, hot_rows=1000)) == values(plain)
