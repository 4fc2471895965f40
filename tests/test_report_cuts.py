"""All reports from one scan are the reports made one by one."""

import os

import pytest
from pyspark.sql import functions as F

from queries import views as V
from queries.funnel import CFG, report_cuts
from stagewise.operators.periods import GRAINS
from stagewise.plans import report as R
from stagewise.plans.sales_funnel import sales_funnel
from stagewise.session import Workspace
from tests.conftest import values

SMALL = os.environ.get("STAGEWISE_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def fact(spark):
    with Workspace(spark) as work:
        yield work.stage(sales_funnel(V.sources(spark, SMALL), CFG, work), "fact")


def test_each_report(fact):
    # a cut may have the name of a column of the fact, or NULL among its values
    cuts = {**report_cuts(), "grade_kind": {"grade_kind": F.upper("grade_kind")}, "page": {"page": F.when(F.col("lesson_id") % 2 == 0, "x")}}
    got = R.all_cuts(fact, cuts, labels=True).cache()
    for basis in ("lead", "request"):
        for grain in GRAINS:
            here = got.where((F.col("basis") == basis) & (F.col("grain") == grain))
            for name, by in {**cuts, "lead_type": dict(zip(R.LABELS, R.lead_type_of(grain)))}.items():
                one = R.funnel_counts(fact, grain, basis, [c.alias(n) for n, c in by.items()])
                mine = here.where(F.col("cut") == name).select("period", *by, *R.COUNTS)
                assert values(mine) == values(one) and not one.isEmpty(), (basis, grain, name)


def test_one_scan(fact):
    plan = R.all_cuts(fact, report_cuts(), labels=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1


def test_without_rows_or_with_equal_cuts(fact):
    none = R.all_cuts(fact.limit(0), report_cuts())
    assert none.isEmpty() and none.columns[:4] == ["basis", "grain", "period", "cut"]
    with pytest.raises(ValueError, match="same columns"):
        R.all_cuts(fact, {"a": {}, "b": {}})
