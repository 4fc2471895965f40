"""A stored fact brought up to date slice by slice is the fact of one run over all slices."""

import os
import shutil
from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from queries import views as V
from queries.funnel import CFG
from stagewise.operators import periods as P
from stagewise.operators import renumber as N
from stagewise.operators.skew import HotGroups
from stagewise.plans import refresh
from stagewise.plans.refresh import FactStore, joined_bounds, refresh_slice
from stagewise.plans.sales_funnel import sales_funnel
from stagewise.session import Workspace
from tests.conftest import values

SMALL = os.environ.get("STAGEWISE_TEST_DIR", "/root/testdata/sf0.001")


def same(a, b):
    a, b = a.select(sorted(a.columns)), b.select(sorted(b.columns))
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def part(lo, hi):
    return replace(CFG, lo=lo, hi=hi)


def leads_only(spark, months=3):
    """Each phone has its leads in one of some months, and there is no request."""
    src = V.sources(spark, SMALL)
    shift = f"created_at + make_interval(0, CAST(pmod(crc32(coalesce(phone, '')), {months}) AS INT))"
    moved = {n: getattr(src, n).withColumn("created_at", F.expr(shift)) for n in ("landing_leads", "traffic_source_lead")}
    return replace(src, lessons=src.lessons.limit(0), **moved)


def files(store):
    root = store.path("fact")
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if f.startswith("part-")}


def of_months(found, *months):
    return {f: t for f, t in found.items() if any(f"lead_month=2024-{m:02}" in f for m in months)}


def test_slices_in_any_order_and_again(spark, tmp_path):
    src = V.sources(spark, SMALL)
    a, b = part("2024-01-10 00:00:00", "2024-01-20 06:00:00"), part("2024-01-20 00:00:00", "2024-01-31 00:00:00")
    early = part("2024-01-03 00:00:00", "2024-01-10 00:00:00")
    store = FactStore(spark, str(tmp_path / "store"))
    for cfg in (a, b, early):
        refresh_slice(store, src, cfg)
    assert store.covered() == (early.lo, b.hi)
    whole = sales_funnel(src, replace(CFG, lo=early.lo, hi=b.hi))
    assert whole.count() > 500 and same(store.read().drop("lead_month"), whole)
    # a run that changes nothing writes no month, and leaves nothing behind
    before = files(store)
    refresh_slice(store, src, b)
    assert files(store) == before and not os.path.exists(store.path("pending"))


def test_corrections_of_a_slice(spark, tmp_path):
    src = V.sources(spark, SMALL)
    a, b = part("2024-01-01 00:00:00", "2024-01-15 00:00:00"), part("2024-01-15 00:00:00", "2024-01-31 00:00:00")
    store = FactStore(spark, str(tmp_path / "store"))
    refresh_slice(store, src, a)
    refresh_slice(store, src, b)
    # leads and lessons of the first slice go, others move inside it, one comes late
    early = F.col("created_at") < a.hi
    leads = src.landing_leads.where(~early | (F.crc32(F.col("created_at").cast("string")) % 3 > 0))
    late = leads.where(early).limit(1).withColumn("phone", F.lit("p999"))
    lessons = src.lessons.where(~early | (F.col("id") % 4 > 0))
    moved = replace(src, landing_leads=leads.unionByName(late), lessons=lessons)
    refresh_slice(store, moved, a)
    assert same(store.read().drop("lead_month"), sales_funnel(moved, replace(CFG, lo=a.lo, hi=b.hi)))


def test_only_changed_months_are_written(spark, tmp_path):
    src = leads_only(spark)
    store = FactStore(spark, str(tmp_path / "store"))
    refresh_slice(store, src, part("2024-01-01 00:00:00", "2024-03-10 00:00:00"))
    first = files(store)
    assert of_months(first, 1) and of_months(first, 2) and of_months(first, 3)
    refresh_slice(store, src, part("2024-03-10 00:00:00", "2024-03-31 00:00:00"))
    second = files(store)
    assert of_months(second, 1, 2) == of_months(first, 1, 2)
    assert not set(of_months(second, 3)) & set(of_months(first, 3))
    # the leads of a month are gone: its folder goes too
    gone = replace(src, landing_leads=src.landing_leads.where("created_at < '2024-02-01' OR created_at >= '2024-03-01'"))
    refresh_slice(store, gone, part("2024-01-31 00:00:00", "2024-03-01 00:00:00"))
    third = files(store)
    assert of_months(third, 1, 3) == of_months(second, 1, 3) and not of_months(third, 2)
    assert not os.path.exists(store.path("fact/lead_month=2024-02-01"))


@pytest.fixture(scope="module")
def three_months(spark, tmp_path_factory):
    """A stored fact, sources that have lost a month since, and what it must become."""
    src, root = leads_only(spark), tmp_path_factory.mktemp("months")
    refresh_slice(FactStore(spark, str(root / "store")), src, part("2024-01-01 00:00:00", "2024-03-31 00:00:00"))
    gone = replace(src, landing_leads=src.landing_leads.where("created_at < '2024-02-01' OR created_at >= '2024-03-01'"))
    want = sales_funnel(gone, part("2024-01-01 00:00:00", "2024-03-31 00:00:00"))
    want.write.parquet(str(root / "want"))
    return root / "store", gone, spark.read.schema(want.schema).parquet(str(root / "want"))


class Lost(Exception):
    pass


@pytest.mark.parametrize("lost_at", ["before the plan", "before the months", "before the empty ones"])
def test_a_lost_run_is_finished_or_dropped(spark, tmp_path, monkeypatch, three_months, lost_at):
    stored, gone, want = three_months
    store = FactStore(spark, str(shutil.copytree(stored, tmp_path / "store")))
    again = part("2024-01-20 00:00:00", "2024-03-05 00:00:00")
    plain, calls = refresh.remove, []

    def fail(*_, **__):
        raise Lost

    with monkeypatch.context() as m:
        if lost_at == "before the plan":
            m.setattr(refresh, "write_fact", fail)
        elif lost_at == "before the months":
            m.setattr(FactStore, "finish", lambda self: fail() if calls else calls.append(1))
        else:
            m.setattr(refresh, "remove", lambda s, p: fail() if "lead_month" in p else plain(s, p))
        with pytest.raises(Lost):
            refresh_slice(store, gone, again)
    assert os.path.exists(store.path("pending/plan/_SUCCESS")) == (lost_at != "before the plan")
    store.finish()
    if lost_at == "before the plan":
        refresh_slice(store, gone, again)
    assert same(store.read().drop("lead_month"), want)
    assert not os.path.exists(store.path("pending")) and not os.path.exists(store.path("fact/lead_month=2024-02-01"))


def test_new_rows_wait_before_they_fan_out(spark, tmp_path, monkeypatch):
    """Rows are staged, compared and shuffled once each, not once for each choice of their labels."""
    src, staged, done = V.sources(spark, SMALL), [], FactStore.finish
    store = FactStore(spark, str(tmp_path / "store"))
    plain, calls = Workspace.stage, []
    with monkeypatch.context() as m:
        m.setattr(FactStore, "finish", lambda self: calls.append(1))
        m.setattr(Workspace, "stage", lambda self, df, name: staged.append(name) or plain(self, df, name))
        refresh_slice(store, src, part("2024-01-01 00:00:00", "2024-01-31 00:00:00"))
    waiting = spark.read.parquet(store.path("pending/fact"))
    counted = waiting.count()
    done(store)
    assert len(calls) == 2 and "lead_type_month" not in waiting.columns
    assert counted < store.read().count() == sales_funnel(src, CFG).count()
    # what is stored is compared where it lies
    staged.clear()
    with monkeypatch.context() as m:
        m.setattr(Workspace, "stage", lambda self, df, name: staged.append(name) or plain(self, df, name))
        refresh_slice(store, src, part("2024-01-10 00:00:00", "2024-01-31 00:00:00"))
    assert not {"mine", "kept"} & set(staged)


def test_months_are_told_apart_by_sums(rows):
    labels = ", ".join(f"{c} string" for c in refresh.LABELS)
    schema = f"a string, b string, x double, lead_month date, {labels}"

    def month(*data):
        df = rows(schema, [(*r, "2024-01-01", *[None] * 5, last) for *r, last in data])
        printed = df.select("lead_month", *refresh.prints(["a", "b", "x"]), *refresh.LABELS)
        return refresh.sums_by_month(printed.select("lead_month", *refresh.with_labels()))

    base = [("u", None, 1.0, "l"), ("v", "w", None, None)]
    assert month(*base) == month(*base[::-1])
    assert month(*base, base[0]) != month(*base) != month(*base, base[1])
    # a value in the next column, a label gone, one row twice in place of two
    assert month(("u", None, 1.0, "l")) != month((None, "u", 1.0, "l"))
    assert month(("u", None, 1.0, "l")) != month(("u", None, 1.0, None))
    assert month(base[0], base[0]) != month(*base) != month(base[1], base[1])


def test_a_run_lost_by_older_code_is_finished(spark, tmp_path, three_months):
    """Its pending rows lie by month, with their labels, and its plan names no months."""
    stored, _, want = three_months
    store = FactStore(spark, str(shutil.copytree(stored, tmp_path / "store")))
    refresh.write_fact(want, store.path("pending/fact"), ordered=False)
    plan = [("2024-01-01 00:00:00", "2024-03-31 00:00:00", [date(2024, 2, 1)])]
    spark.createDataFrame(plan, "lo string, hi string, emptied array<date>").write.parquet(store.path("pending/plan"))
    store.finish()
    assert same(store.read().drop("lead_month"), want) and not os.path.exists(store.path("pending"))


def test_people_of_other_slices_are_carried_over(spark, tmp_path):
    """A month in which only some people change keeps the rows of the others."""
    src = leads_only(spark, months=1)
    store = FactStore(spark, str(tmp_path / "store"))
    a, b = part("2024-01-01 00:00:00", "2024-01-30 12:00:00"), part("2024-01-30 12:00:00", "2024-01-31 00:00:00")
    refresh_slice(store, src, a)
    refresh_slice(store, src, b)
    assert same(store.read().drop("lead_month"), sales_funnel(src, replace(CFG, lo=a.lo, hi=b.hi)))


def test_events_by_type(spark, tmp_path, rows):
    """The staged events are those of the table, also without type, code or time."""
    table = rows(
        "event_id long, ts timestamp, user_id long, event_type string, value double, props string",
        [
            (1, "2024-01-01 00:00:01", 2, "view", 1.5, '{"k": 7}'),
            (1, "2024-01-01 00:00:01", 2, "view", 1.5, '{"k": 7}'),
            (3, None, None, None, None, None),
            (4, "2024-01-02 00:00:01.25", 4, "a/b", 0.0, "{"),
        ],
    )
    table.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    got = V.events_by_type(spark, str(tmp_path)).select("event_id", "ts", "user_id", "event_type", "value", "k")
    assert values(got) == values(V.events(spark, str(tmp_path)))


def test_bounds():
    assert joined_bounds(None, part("a", "b")) == ("a", "b")
    assert joined_bounds(("2024-01-05", "2024-01-10"), part("2024-01-01", "2024-01-05")) == ("2024-01-01", "2024-01-10")
    with pytest.raises(ValueError):
        joined_bounds(("2024-01-05", "2024-01-10"), part("2024-01-11", "2024-01-12"))


def test_workspaces_that_overlap_keep_their_tables(spark):
    a, b = Workspace(spark), Workspace(spark)
    kept = b.stage(spark.range(3), "x")
    a.stage(spark.range(2), "x")
    twice = b.stage(spark.range(4), "x")
    a.close()
    assert kept.count() == 3 and twice.count() == 4 and not os.path.exists(a.root)
    b.close()
    assert not os.path.exists(b.root)


COLS = P.FlagColumns(ties=("row",))
IDS = ["row"]
SCHEMA = "row long, phone string, subject_name string, trial_created_at date, lead_created timestamp, union_rn int, lesson_id long"


@pytest.fixture(scope="module")
def table(spark):
    """Rows of a few people over some weeks; a third belongs to one, some have no phone, request or time."""
    day = "date_add(DATE '2024-01-20', CAST(pmod(xxhash64({0}), 25) AS INT))"
    return spark.range(600).selectExpr(
        "id AS row",
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 17 = 0 THEN NULL ELSE concat('p', id % 23) END AS phone",
        "CASE WHEN id % 11 = 0 THEN 'undefined' ELSE concat('s', id % 2) END AS subject_name",
        f"CASE WHEN id % 2 = 0 THEN {day.format('id, 1')} END AS trial_created_at",
        f"CASE WHEN id % 41 > 0 THEN CAST({day.format('id, 2')} AS TIMESTAMP) + make_interval(0,0,0,0,CAST(id % 5 AS INT)) END AS lead_created",
        "CASE WHEN id % 2 = 0 THEN 1 ELSE 2 END AS union_rn",
        "CASE WHEN id % 2 = 0 THEN id END AS lesson_id",
    )


@pytest.mark.parametrize("exact", [False, True])
@pytest.mark.parametrize("hot_rows", [0, 10**6])
def test_flags_by_difference(spark, table, exact, hot_rows):
    late, gone = F.col("row") % 37 == 5, F.col("row") % 29 == 4
    with Workspace(spark) as work:
        before = work.stage(P.period_flags(table.where(~late), COLS, exact_daily_lead=exact, hot=HotGroups(None)), "before")
        got = N.update_flags(before, table.where(late), table.where(gone & ~late).select("row"), IDS, work, COLS, exact_daily_lead=exact, hot_rows=hot_rows)
        want = P.period_flags(table.where(late | ~gone), COLS, exact_daily_lead=exact, hot=HotGroups(None))
        assert same(got, want)


def test_flags_without_a_change_or_a_table(spark, table):
    none = table.limit(0)
    with Workspace(spark) as work:
        before = work.stage(P.period_flags(table, COLS, hot=HotGroups(None)), "before")
        unknown = spark.createDataFrame([(10**6,), (None,)], "row long")
        assert same(N.update_flags(before, none, unknown, IDS, work, COLS, hot=HotGroups(None)), before)
        empty = P.period_flags(none, COLS, hot=HotGroups(None))
        assert same(N.update_flags(empty, table, unknown, IDS, work, COLS, hot=HotGroups(None)), before)
        assert N.update_flags(before, none, table, IDS, work, COLS, hot=HotGroups(None)).isEmpty()


def test_people_without_a_change_pass_no_window(spark, table):
    late = F.col("phone") == "p4"
    with Workspace(spark) as work:
        before = work.stage(P.period_flags(table.where(~late), COLS, hot=HotGroups(None)), "before")
        N.update_flags(before, table.where(late).limit(1), table.limit(0), IDS, work, COLS, hot=HotGroups(None))
        numbered = spark.read.parquet(f"{work.root}/pool")
        assert {r.phone for r in numbered.select("phone").distinct().collect()} == {"p4"}
        # of this person only the periods of the change are there
        months = {date(d.year, d.month, 1) for r in numbered.collect() for d in (r.trial_created_at, r.lead_created) if d}
        assert months


def test_labels_by_difference(spark, table):
    persons = {"month": ("phone", "row"), "day": ("phone",)}
    typed = table.withColumns({"lead_type": F.concat(F.lit("t"), F.col("row") % 5), "lead_type_2": F.when(F.col("row") % 7 > 0, F.concat(F.lit("u"), F.col("row") % 3))})
    late, gone = F.col("row") % 37 == 5, F.col("row") % 29 == 4

    def fact(rows):
        return P.period_flags(rows, COLS, hot=HotGroups(None)).where("union_rn = 1 OR rn_daily = 1")

    def labelled(rows):
        out = rows
        for g, keys in persons.items():
            out = P.period_labels(out, g, keys, cols=COLS, fact=rows)
        return out.distinct()

    with Workspace(spark) as work:
        before, after = work.stage(fact(typed.where(~late)), "a"), work.stage(fact(typed.where(late | ~gone)), "b")
        changed = before.exceptAll(after).unionByName(after.exceptAll(before))
        got = N.update_labels(work.stage(labelled(before), "c"), after, changed, persons, work, cols=COLS)
        assert same(got.distinct(), labelled(after))
        none = N.update_labels(work.stage(labelled(before), "d"), before, changed.limit(0), persons, work, cols=COLS)
        assert values(none.select("row", "lead_type_month")) == values(labelled(before).select("row", "lead_type_month"))
