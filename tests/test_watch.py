"""Figures of a run, and runs that stop."""

import pytest
from pyspark.sql import functions as F

from queries import views as V
from queries.funnel import SLICE
from stagewise.plans import sales_funnel as S
from stagewise.plans.watch import FUNNEL_BOUNDS, Bound, BrokenInvariant, Watch
from stagewise.session import Workspace

SMALL = "/root/testdata/sf0.001"


def run(spark, watch):
    with Workspace(spark) as work:
        return S.sales_funnel(V.sources(spark, SMALL), SLICE, work, watch=watch).count()


def test_a_sound_run_keeps_its_bounds(spark):
    watch = Watch()
    assert run(spark, watch) > 0
    assert watch.broken() == [] and watch.figures["requests", "expected"] > 0
    table = {(r.stage, r.metric): r.value for r in watch.table(spark).collect()}
    assert table == watch.figures


def test_lost_requests_stop_the_run(spark, monkeypatch):
    attach = S.attach_stages
    # an inner join in place of a left one
    monkeypatch.setattr(S, "attach_stages", lambda *a: attach(*a).where("trial_finished_at IS NOT NULL"))
    with pytest.raises(BrokenInvariant, match="requests.lost"):
        run(spark, Watch())


def test_covered_rows_that_go_stop_the_run(spark, monkeypatch):
    flags = S.flagged_rows
    monkeypatch.setattr(S, "flagged_rows", lambda *a: flags(*a).where("union_rn = 2 OR rn_daily = 1"))
    with pytest.raises(BrokenInvariant, match="flagged.request_rows"):
        run(spark, Watch())


def test_own_bounds_and_missing_figures(spark):
    with pytest.raises(BrokenInvariant, match="largest_fan_out is [0-9]+, must be at most 0"):
        run(spark, Watch([*FUNNEL_BOUNDS, Bound("requests", "largest_fan_out", at_most=0)]))
    watch = Watch([Bound("a", "b", at_least=1), Bound("requests", "lost", at_most=("x", "y"))])
    watch.expect(spark.range(0), "id")
    watch.compare(spark.range(0), "id")
    assert watch.broken() == ["a.b is None, must be at least 1", "requests.lost is 0, must be at most None"]


def test_figures_of_a_write(spark, tmp_path):
    watch = Watch([])
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (None, 4)], "id int, x int")
    watch.expect(df.where("x < 4 OR id IS NULL").select("id").distinct().union(df.limit(0).select("id")), "id")
    watch.compare(df.where("id = 1").union(spark.createDataFrame([(9, 9)], df.schema)), "id")
    assert watch.figures == {("requests", n): v for n, v in (("expected", 3), ("lost", 2), ("made_up", 1), ("largest_fan_out", 2))}
    with pytest.raises(ValueError):
        Watch().compare(df, "id")
    metrics = {"rows": F.count(F.lit(1)), "nulls": F.count_if(F.col("id").isNull())}
    out = watch.during("s", metrics, df, lambda d: d.write.parquet(f"{tmp_path}/s"))
    assert out is None and watch.figures["s", "rows"] == 4 and watch.figures["s", "nulls"] == 1
    watch.during("none", metrics, df.limit(0), lambda d: d.write.parquet(f"{tmp_path}/none"))
    assert watch.figures["none", "rows"] == 0
