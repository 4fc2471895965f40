"""Rules as rows: the same labels as the fixed rules, and what a further row changes."""

import random

from pyspark.sql import functions as F

from stagewise.operators import labelling as L
from stagewise.operators.lead_type import (
    REQUEST_DECISIONS,
    REQUEST_FACTS,
    UNCONVERTED_DECISIONS,
    UNCONVERTED_FACTS,
    request_facts,
    request_lead_type,
    unconverted_facts,
    unconverted_lead_type,
)
from stagewise.operators.rules import PAGE_RULES, decide, decision_table, launch_table, with_rule_label
from tests.conftest import values

SITE = "example.com"


def visits(spark):
    rng = random.Random(3)
    pages = ["", "a", "tutors/", "math-school/", "middle-school/x", "primary-school/", "english/", "russian/", "it-base/", "english2/", "programming2"]
    data = [(i, f"https://{SITE}/{rng.choice(pages)}", f"2022-0{rng.randrange(5, 10)}-{rng.randrange(1, 29):02} 10:00:00") for i in range(400)]
    data += [(400, None, "2023-01-01 00:00:00"), (401, f"https://{SITE}/", None), (402, "", "2023-01-01 00:00:00")]
    data += [(n, f"https://{SITE}/english2/", t) for n, t in ((403, "2022-06-01 00:00:00"), (404, "2022-05-31 23:59:59"))]
    data += [(n, f"https://{SITE}/", t) for n, t in ((405, "2022-06-13 17:00:00"), (406, "2022-06-13 17:00:01"))]
    return spark.createDataFrame(data, "id long, page string, at string").withColumn("at", F.to_timestamp("at"))


def test_launch_rules_as_rows(spark):
    seen = visits(spark)
    fixed = L.with_rule_flag(seen, "page", "at", None, L.launch_rules(SITE))
    rows = with_rule_label(seen, "page", "at", launch_table(spark, SITE), "0")
    assert values(rows.withColumn("rule_flag", F.col("label").cast("int")).drop("label")) == values(fixed)


def test_a_further_row_changes_the_label(spark):
    seen = visits(spark)
    table = launch_table(spark, SITE)
    before = {r.id: r.label for r in with_rule_label(seen, "page", "at", table, "0").collect()}
    more = spark.createDataFrame([(-1, "equals", f"https://{SITE}/", None, None, None, "home")], PAGE_RULES)
    after = {r.id: r.label for r in with_rule_label(seen, "page", "at", table.union(more), "0").collect()}
    home = {r.id for r in seen.where(F.col("page") == f"https://{SITE}/").collect()}
    assert {i for i in after if after[i] != before[i]} == home and {after[i] for i in home} == {"home"}


def test_priority_bounds_ties_and_odd_rows(spark):
    seen = spark.createDataFrame([(1, "abc"), (2, "b"), (3, ""), (4, None), (5, "xé"), (1, "abc")], "id int, page string")
    seen = seen.withColumn("at", F.lit("2024-02-01 00:00:00").cast("timestamp"))
    rows = [
        (2, "contains", "b", None, None, None, "z"),
        (2, "contains", "b", None, None, None, "y"),
        (2, "contains", "b", None, None, None, "y"),
        (1, "contains", "b", None, "2024-02-01 00:00:00", None, "over"),
        (0, "contains", "b", "2024-02-01 00:00:00", None, False, "not yet"),
        (0, "endswith", "c", "2024-02-01 09:00:00", None, True, "day"),
        (0, "unknown", "abc", None, None, None, "no such test"),
        (0, "contains", None, None, None, None, "no text"),
        (5, "endswith", "é", None, None, None, "last"),
        (9, "contains", "", None, None, None, "all"),
    ]
    table = spark.createDataFrame(rows, PAGE_RULES.replace("timestamp", "string"))
    table = table.withColumns({c: F.col(c).cast("timestamp") for c in ("starts", "ends")})
    got = values(with_rule_label(seen, "page", "at", table, "none").select("id", "label"))
    assert got == [(1, "day"), (1, "day"), (2, "y"), (3, "all"), (4, "none"), (5, "last")]
    assert values(with_rule_label(seen, "page", "at", table.limit(0)).select("label").distinct()) == [(None,)]


def test_decisions_equal_the_ordered_rules(spark):
    values_of = {
        "log": "1, null", "lead": "1, 2, null", "subject": "1, null", "ft": "1, 2, null",
        "fta": "1, 2, null", "req": "2", "op": "0, 1, null",
    }
    cases = spark.range(1)
    for name, listed in values_of.items():
        cases = cases.withColumn(name, F.explode(F.expr(f"array({listed})")))
    columns = [F.col(c) for c in values_of]
    want = cases.withColumn("label", request_lead_type(*columns))
    rules = decision_table(spark, REQUEST_FACTS, REQUEST_DECISIONS)
    assert values(decide(cases, request_facts(*columns), rules)) == values(want)

    args = [F.col("lead"), F.when(F.col("subject") == 1, "math").otherwise("undefined"), F.col("ft"), F.col("fta"), F.col("op")]
    want = cases.withColumn("label", unconverted_lead_type(*args))
    rules = decision_table(spark, UNCONVERTED_FACTS, UNCONVERTED_DECISIONS)
    assert values(decide(cases, unconverted_facts(*args), rules)) == values(want)
    assert values(decide(cases, unconverted_facts(*args), rules.limit(0), "?").select("label").distinct()) == [("?",)]
