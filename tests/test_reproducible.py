"""The fact table does not depend on the order of rows, the size switch or where tables are read from."""

import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from queries.funnel import CFG, tied
from stagewise.plans.sales_funnel import sales_funnel
from stagewise.session import Workspace
from stagewise.sources.tables import FunnelSources, write_fact

SMALL = os.environ.get("STAGEWISE_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sources(spark):
    return tied(spark, SMALL)


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_order_of_rows_and_size_switch(spark, sources, tmp_path):
    with Workspace(spark) as space:
        fact = space.stage(sales_funnel(sources, CFG, space), "fact")
        assert fact.groupBy("phone", "lal_created_at").count().where("count > 1").count() > 0
        turned = {n: getattr(sources, n) for n in FunnelSources.names()}
        turned = FunnelSources(**{n: t.repartition(5, F.xxhash64(*[c for c, k in t.dtypes if "array" not in k])) for n, t in turned.items()})
        assert same(fact, sales_funnel(turned, CFG))
        assert same(fact, sales_funnel(sources, replace(CFG, hot_rows=0)))
        # and from parquet files
        for n in FunnelSources.names():
            getattr(turned, n).write.parquet(f"{tmp_path}/{n}")
        assert same(fact, sales_funnel(FunnelSources.from_parquet(spark, str(tmp_path)), CFG))
        # the sink, and nothing left behind
        write_fact(fact, f"{tmp_path}/fact")
        assert spark.read.parquet(f"{tmp_path}/fact").count() == fact.count()
        root = space.root
        assert os.path.isdir(root)
    assert not os.path.exists(root)


def test_sources_from_tables(spark, sources):
    named = {n: f"given_{n}" for n in FunnelSources.names()}
    for n, view in named.items():
        getattr(sources, n).createOrReplaceTempView(view)
    found = FunnelSources.from_tables(spark, named)
    for n in named:
        assert getattr(found, n).schema == getattr(sources, n).schema
        assert getattr(found, n).count() == getattr(sources, n).count()


@pytest.mark.parametrize("change", [{"flags_after_suppression": True}, {"hi_inclusive": False}, {"strict_pages": False}, {"exact_daily_lead": True}])
def test_options_run_end_to_end(sources, change):
    cfg = replace(CFG, **change)
    fact = sales_funnel(sources, cfg).select("union_rn", "rn_daily", "rn_daily_lead", "page_name", "lead_created").collect()
    assert fact
    if "flags_after_suppression" in change:
        assert all(r.rn_daily >= 1 for r in fact)
    if "hi_inclusive" in change:
        assert all(str(r.lead_created) < cfg.hi for r in fact if r.union_rn == 2)
    if "strict_pages" in change:
        assert any((r.page_name or "").endswith("/") for r in fact)
