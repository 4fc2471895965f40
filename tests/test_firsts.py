"""A state that slices were merged into holds the first events of all rows."""

import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from queries import views as V
from queries.funnel import CFG
from stagewise.operators.keyed import first_per_key
from stagewise.plans import firsts
from stagewise.plans import requests as R
from stagewise.plans.firsts import FirstOf, FirstState, FunnelFirsts
from tests.conftest import values

SMALL = os.environ.get("STAGEWISE_TEST_DIR", "/root/testdata/sf0.001")
SCHEMA = "id long, key string, sub int, ts timestamp, at timestamp, note string"

JANUARY, ALL = ("2024-01-01", "2024-02-01"), ("1970-01-01", "2999-01-01")


def spec():
    return FirstOf(["key", "sub"], [F.col("at").asc_nulls_last(), "ts", "id"], ["id"], "ts", ["at", "note"])


@pytest.fixture(scope="module")
def events(spark):
    """A third of the rows has one key; some keys, times and marks are NULL; ties in both times."""
    day = "CAST(date_add(DATE '2024-01-01', CAST(pmod(xxhash64(id, {0}), 60) AS INT)) AS TIMESTAMP)"
    rows = spark.range(500).selectExpr(
        "id",
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 13 = 0 THEN NULL ELSE concat('k', id % 40) END AS key",
        "CAST(CASE WHEN id % 4 > 0 THEN id % 2 END AS INT) AS sub",
        day.format(1) + " AS ts",
        f"CASE WHEN id % 3 = 1 THEN {day.format(2)} END AS at",
        "CASE WHEN id % 5 > 0 THEN concat('n', id % 7) END AS note",
    )
    return spark.createDataFrame(rows.collect(), SCHEMA)


def want(rows):
    return values(first_per_key(spec().select(rows), spec().keys, spec().order))


def merge(state, rows, lo, hi, history=None):
    state.update(rows.where((F.col("ts") >= lo) & (F.col("ts") < hi)), lo, hi, rows if history is None else history)


def files(state):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(state.path) for f in names if f.startswith("part-")}


def test_slices_in_any_order_and_again(spark, tmp_path, events):
    state = FirstState(spark, str(tmp_path), spec(), 8)
    assert state.read(events.schema).isEmpty()
    slices = [("2024-02-01", "2024-02-20"), ("2024-01-10", "2024-02-03"), ("2024-02-20", "2999-01-01"), ("1970-01-01", "2024-01-10")]
    for lo, hi in [*slices, slices[0]]:
        merge(state, events, lo, hi)
    assert values(state.read()) == want(events) and len(want(events)) > 40
    before = files(state)
    merge(state, events, *slices[1])
    merge(state, events.limit(0), "2030-01-01", "2031-01-01")
    assert files(state) == before and not os.path.exists(state.pending)


def test_corrections(spark, tmp_path, events):
    state = FirstState(spark, str(tmp_path), spec(), 8)
    merge(state, events, *ALL)
    # rows go, move to another key, lose their mark, get another note, come late
    kept = events.where("id % 6 <> 1")
    other = kept.withColumns({
        "key": F.when(F.col("id") % 10 == 2, F.lit("new")).otherwise(F.col("key")),
        "at": F.when(F.col("id") % 7 == 3, F.lit(None)).otherwise(F.col("at")),
        "note": F.when(F.col("id") % 4 == 0, F.lit("other")).otherwise(F.col("note")),
    })
    late = events.where("id % 50 = 0").withColumns({"id": F.col("id") + 1000, "ts": F.col("ts") - F.expr("INTERVAL 90 DAY")})
    now = other.unionByName(late)
    for lo, hi in (("1970-01-01", "2024-01-20"), ("2024-01-20", "2999-01-01")):
        merge(state, now, lo, hi)
    assert values(state.read()) == want(now) != want(events)


def test_a_row_that_moves_into_the_slice(spark, tmp_path, rows):
    early = rows(SCHEMA, [(1, "a", 1, "2024-01-05", None, "x"), (2, "a", 1, "2024-01-20", None, "y")])
    moved = rows(SCHEMA, [(1, "a", 1, "2024-02-05", None, "x"), (2, "a", 1, "2024-01-20", None, "y")])
    state = FirstState(spark, str(tmp_path), spec(), 2)
    merge(state, early, *ALL)
    # it is known by its id, though its old time lies outside of the slice
    merge(state, moved, "2024-02-01", "2024-03-01")
    assert values(state.read()) == want(moved) and state.read().head()["id"] == 2


def test_keys_without_events_come_back(spark, tmp_path, events):
    state = FirstState(spark, str(tmp_path), spec(), 4)
    merge(state, events, *ALL)
    merge(state, events.limit(0), *ALL)
    assert state.read().isEmpty()
    merge(state, events, *JANUARY)
    merge(state, events, "2024-02-01", "2999-01-01")
    assert values(state.read()) == want(events)


def test_only_changed_parts_are_written(spark, tmp_path, events):
    state = FirstState(spark, str(tmp_path), spec(), 16)
    merge(state, events, *ALL)
    before = files(state)
    one = events.where("key = 'k7'").limit(1).withColumns({"id": F.lit(-1).cast("long"), "at": F.lit("2000-01-01").cast("timestamp")})
    state.update(one.withColumn("ts", F.lit("2031-01-01").cast("timestamp")), "2030-01-01", "2032-01-01")
    after = files(state)
    assert len(before) > 10 and len(set(before) & set(after)) == len(before) - 1
    assert -1 in {r["id"] for r in state.read().collect()}


def test_a_correction_needs_the_history(spark, tmp_path, events):
    state = FirstState(spark, str(tmp_path), spec(), 4)
    merge(state, events, *ALL)
    with pytest.raises(ValueError, match="history"):
        state.update(events.where("id % 2 = 0"), *ALL)
    with pytest.raises(ValueError, match="parts_4"):
        FirstState(spark, str(tmp_path), spec(), 8)
    assert values(state.read()) == want(events)


class Lost(Exception):
    pass


@pytest.mark.parametrize("written", [False, True])
def test_a_lost_run_is_finished_or_dropped(spark, tmp_path, monkeypatch, events, written):
    state = FirstState(spark, str(tmp_path), spec(), 4)
    merge(state, events, *JANUARY, history=events)
    plain, old = FirstState._write, values(state.read())

    def write(self, rows, path, overwrite):
        if path == self.path or not written:
            raise Lost
        plain(self, rows, path, overwrite)

    with monkeypatch.context() as m:
        m.setattr(firsts.FirstState, "_write", write)
        with pytest.raises(Lost):
            merge(state, events, "2024-02-01", "2999-01-01")
    assert os.path.exists(f"{state.pending}/_SUCCESS") == written and values(state.read()) == old
    state.finish()
    assert (values(state.read()) == want(events)) == written
    merge(state, events, "2024-02-01", "2999-01-01")
    assert values(state.read()) == want(events)


def test_first_trials_of_the_funnel(spark, tmp_path):
    src, state = V.sources(spark, SMALL), FunnelFirsts.at(spark, str(tmp_path), 4)
    for lo, hi in (("2024-01-15", "2999-01-01"), ("1970-01-01", "2024-01-15")):
        state.update(src, replace(CFG, lo=lo, hi=hi))
    trials = R.trial_lessons(src)
    for kept, by_subject in ((state.trials, True), (state.trials_any, False)):
        first = R.first_trials(trials, CFG, by_subject)
        assert values(kept.read().select(*first.columns)) == values(first) and not first.isEmpty()
