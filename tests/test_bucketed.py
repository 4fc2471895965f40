"""Sources in buckets: the same rows, and no exchange above the scan of a history table."""

import pytest

from queries import views as V
from queries.funnel import SLICE
from stagewise.plans.sales_funnel import sales_funnel
from stagewise.session import Workspace
from stagewise.sources.tables import BUCKET_KEYS, FunnelSources, write_bucketed
from tests.conftest import values

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def bucketed(spark, tmp_path_factory):
    plain = V.sources(spark, SMALL)
    names = write_bucketed(plain, str(tmp_path_factory.mktemp("buckets")), "bucketed_", 8)
    yield plain, FunnelSources.from_tables(spark, names)
    for name in names.values():
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def exchanges(df):
    """Hash exchanges of the plan, each with what lies below it."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" :+-*()0123456789")) for line in lines]
    found = []
    for n, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            below = n + 1
            while below < len(lines) and depth[below] > depth[n]:
                below += 1
            found.append(" ".join(lines[n:below]))
    return found


def test_narrowing_joins_do_not_shuffle_the_history(spark, bucketed):
    _, src = bucketed
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, key in BUCKET_KEYS.items():
            wanted = spark.range(50).withColumnRenamed("id", "wanted").repartition(3)
            table = getattr(src, name)
            joined = table.join(wanted, table[key] == wanted["wanted"], "left_semi")
            assert f"bucketed_{name}" in joined._jdf.queryExecution().executedPlan().toString()
            shuffled = exchanges(joined)
            assert len(shuffled) == 1 and f"bucketed_{name}" not in shuffled[0], name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_the_funnel_is_the_same(spark, bucketed):
    plain, src = bucketed
    with Workspace(spark) as work:
        want = values(sales_funnel(plain, SLICE, work))
        assert values(sales_funnel(src, SLICE, work)) == want and want
