"""Joins, stages and period operators at their bounds."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from stagewise.functions import vocab
from stagewise.operators import periods as P
from stagewise.operators import stages as S
from stagewise.operators.lead_type import label_lead_type, unconverted_lead_type
from stagewise.operators.labelling import explode_json, rejected_payloads
from stagewise.operators.match import attribute_within, followed_by, nearest_match
from stagewise.plans import report as R
from tests.conftest import values


def test_nearest_match_gap_is_exclusive_and_lead_must_be_earlier(rows):
    requests = rows("p string, rid long, rat timestamp, subject string", [("a", 1, "2024-03-01 00:00:00", "math")])
    gap = 5_260_000
    leads = rows("p string, lid long, lat timestamp", [("a", 1, "2024-03-01 00:00:00")])
    args = ("p", "lat", "lid", "rat", "rid", "subject", gap)
    assert nearest_match(leads, requests, *args).count() == 0
    for seconds, found in ((gap, 0), (gap - 1, 1), (gap + 1, 0)):
        early = leads.withColumn("lat", F.timestamp_seconds(F.unix_timestamp("lat") - seconds))
        assert nearest_match(early, requests, *args).count() == found


def test_nearest_match_ranks_per_lead_and_subject_or_per_request(rows):
    requests = rows(
        "p string, rid long, rat timestamp, subject string",
        [("a", 1, "2024-01-05", "math"), ("a", 2, "2024-01-06", "math"), ("a", 3, "2024-01-06", None)],
    )
    leads = rows("p string, lid long, lat timestamp", [("a", 1, "2024-01-01"), ("a", 2, "2024-01-05"), (None, 3, "2024-01-01")])
    args = (leads, requests, "p", "lat", "lid", "rat", "rid", "subject", 10**7)
    assert values(nearest_match(*args).select("lid", "rid")) == [(1, 1), (1, 3), (2, 2), (2, 3)]
    assert values(nearest_match(*args, rank_side="request").select("lid", "rid")) == [(1, 1), (2, 2), (2, 3)]


def test_followed_by_ends_count_and_month_end(rows):
    left = rows(
        "c int, at date, nxt timestamp, is_first boolean",
        [(1, "2023-01-31", None, False), (2, "2023-01-31", "2023-02-02 10:00:00", False), (3, "2023-01-31", None, True)],
    )
    right = rows(
        "c int, start timestamp",
        [(1, "2023-03-30 00:00:00"), (1, "2023-03-30 00:00:01"), (2, "2023-02-02 10:00:00"), (2, "2023-02-02 10:00:01")],
    )
    end = (F.col("at") + F.expr("interval 1 month") + F.expr("interval 30 days")).cast("timestamp")
    out = followed_by(left, right, "c", "at", "start", end, "nxt", "2999-12-31", "is_first")
    assert values(out.select("c", F.col("start").cast("string"))) == [
        (1, "2023-03-30 00:00:00"), (2, "2023-02-02 10:00:00"), (3, None)]


def test_attribute_within_54_days_inclusive(rows):
    requests = rows("p int, at timestamp", [(1, "2024-02-24 00:00:00"), (1, "2024-02-24 00:00:01"), (2, "2024-05-01"), (3, "2024-01-01")])
    touches = rows("p int, t timestamp, tag string", [(1, "2024-01-01 00:00:00", "x"), (1, "2024-01-01 00:00:00", "x"), (2, None, "y")])
    out = attribute_within(requests, touches, "p", "at", "t", "interval 54 days").select("p", F.second("at"), "tag")
    assert values(out) == [(1, 0, "x"), (1, 1, None), (2, 0, "y"), (3, 0, None)]


def test_attach_stages_never_loses_a_row_and_ignores_copies(rows):
    base = rows("id int, p int, code int", [(1, 1, 5), (2, 1, 6), (3, 9, 5), (4, None, 5)])
    stage = rows("p int, code int, v string", [(1, 5, "five"), (1, 5, "five"), (1, None, "any")])
    exact = S.attach_stages(base, [S.Stage(stage, {"p": "p", "code": "code"}, {"v": "v"})])
    assert values(exact.select("id", "v")) == [(1, "five"), (2, None), (3, None), (4, None)]
    wild = S.attach_stages(base, [S.Stage(stage, {"p": "p"}, {"v": "v"}, wildcard=("code", "code"))])
    assert values(wild.select("id", "v")) == [(1, "any"), (1, "five"), (2, "any"), (3, None), (4, None)]


def test_null_safe_and_fallback_keys(rows):
    left = rows("a string, s int", [("x", 1), (None, 2), (None, None)])
    right = rows("a string, s int, v int", [("x", 7, 10), (None, 2, 20)])
    assert values(S.left_join_null_safe(left, right, {"a": "a"}).select("v")) == [(10,), (20,), (20,)]
    assert values(S.left_join_fallback(left, right, ["a", "s"], ["a", "s"]).select("v")) == [(10,), (20,), (None,)]


def test_lead_time_rules(rows):
    df = rows(
        "log int, lead timestamp, req timestamp",
        [(None, "2024-01-01 00:00:00", "2024-01-02 00:00:00"), (1, None, "2024-01-02 00:00:00"), (1, "2024-01-01 00:00:00", "2024-01-02 00:00:00")],
    )
    out = S.derive_lead_time(df, "log", "lead", "req").select(F.col("lead_created").cast("string"))
    assert values(out) == [("2024-01-01 00:00:00",), ("2024-01-01 23:59:00",), ("2024-01-02 00:00:00",)]


def test_group_fallback_is_all_or_nothing(rows):
    df = rows("a string, b string, x string, y string", [(None, None, "X", None), (None, "B", "X", "Y")])
    got = S.with_group_fallback(df, ["a", "b"], ["x", "y"]).select("a", "b").collect()
    assert {tuple(r) for r in got} == {("X", None), (None, "B")}


def test_union_stages_types_missing_columns(rows):
    out = S.union_stages(rows("a int, at date", [(1, "2024-01-01")]), rows("a int", [(2,)]))
    assert dict(out.dtypes)["at"] == "date"
    assert {(r.a, r.at, r.union_rn) for r in out.collect()} == {(1, date(2024, 1, 1), 1), (2, None, 2)}


def test_exclude_test_records(rows):
    df = rows(
        "n string, t boolean, amount int, kind int",
        [("Test", False, 5, 1), (None, None, 5, 1), ("ok", True, 5, 1), ("ok", False, 1, 1), ("ok", False, 5, None), ("ok", False, 5, 5)],
    )
    kept = S.exclude_test_records(df, {"n": (vocab.TEST_LEAD_NAMES, True)}, ["t"], {"amount": 1}, {"kind": (2, 5, 6)})
    assert values(kept.select("n")) == [(None,)]
    assert S.exclude_test_records(df, {"n": (vocab.TEST_LEAD_NAMES, False)}).where("n IS NULL").count() == 0


T1, T2 = "2024-01-01 00:00:00", "2024-01-02 00:00:00"


@pytest.mark.parametrize(
    "log, lead, subject, first, first_any, op, want",
    [
        (None, None, None, None, T2, None, "by_user: new"),
        (None, T1, "math", T1, T1, 1, "by_user: current"),
        (None, T1, "math", T1, None, 1, "undefined"),
        (1, T1, "math", T1, None, 1, "by_operator: funnel_page_new_lead"),
        (1, T1, None, None, T2, 1, "by_operator: funnel_page_new_lead"),
        (1, T1, "math", T2, None, 0, "by_operator: not_funnel_page_new_lead"),
        (1, T1, None, T1, T1, 0, "by_operator: not_funnel_page_new_lead"),
        (1, T2, "math", T1, None, 1, "by_operator: rescheduled_lead"),
        (1, T2, None, None, T1, None, "by_operator: rescheduled_lead"),
        (1, None, None, None, None, None, "by_operator: other"),
        (1, T1, "math", None, T1, 1, "undefined"),
        (1, T1, "math", T2, None, None, "undefined"),
    ],
)
def test_request_lead_type(rows, log, lead, subject, first, first_any, op, want):
    df = rows(
        "log int, lead timestamp, subject string, ft timestamp, fta timestamp, req timestamp, op int",
        [(log, lead, subject, first, first_any, T2, op)],
    )
    assert label_lead_type(df, "log", "lead", "subject", "ft", "fta", "req", "op").first().lead_type_2 == want


@pytest.mark.parametrize(
    "product, first, first_any, op, want",
    [
        ("p", T1, None, 1, "by_operator: rescheduled_lead"),
        ("undefined", None, T1, 1, "by_operator: rescheduled_lead"),
        (None, None, T1, 0, "by_operator: rescheduled_lead"),
        ("p", None, T1, 1, "by_operator: funnel_page_new_lead"),
        ("p", T2, T2, 0, "by_operator: not_funnel_page_new_lead"),
        ("p", None, None, None, None),
    ],
)
def test_unconverted_lead_type(rows, product, first, first_any, op, want):
    df = rows("lead timestamp, product string, ft timestamp, fta timestamp, op int", [(T2, product, first, first_any, op)])
    out = df.select(unconverted_lead_type(*[F.col(c) for c in df.columns]).alias("t"))
    assert out.first().t == want


FACT = "row long, phone string, student_id long, subject_name string, trial_created_at date, lead_created timestamp, union_rn int, lesson_id long, lead_type string, lead_type_2 string"
COLS = P.FlagColumns(ties=("row",))


def test_flags_on_and_around_the_sentinel_day(rows):
    df = rows(
        FACT,
        [
            (1, "a", 1, "m", "2018-01-01", "2018-01-01 00:00:00", 1, 1, "t", "u"),
            (2, "a", 1, "m", "2017-12-31", "2017-12-31 10:00:00", 1, 2, "t", "u"),
            (3, "a", 1, "e", None, "2017-12-31 11:00:00", 2, None, "t", "u"),
        ],
    )
    got = {r.row: (r.rn_daily, r.rn_daily_lead) for r in P.period_flags(df, COLS).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (2, 2)}


def test_daily_lead_flag_by_day_or_exact_time(rows):
    df = rows(
        FACT,
        [
            (1, "a", 1, "m", "2024-01-05", "2024-01-01 08:00:00", 1, 1, "t", "u"),
            (2, "a", 1, "m", "2024-01-06", "2024-01-01 09:00:00", 1, 2, "t", "u"),
        ],
    )
    assert values(P.period_flags(df, COLS).select("rn_daily_lead")) == [(1,), (2,)]
    assert values(P.period_flags(df, COLS, exact_daily_lead=True).select("rn_daily_lead")) == [(1,), (1,)]


def test_suppress_covered_equals_the_flag_filter(rows):
    df = rows(
        FACT,
        [
            (1, "a", 1, "m", "2024-01-05", "2024-01-01 08:00:00", 1, 1, "t", "u"),
            (2, "a", 1, "e", None, "2024-01-01 07:00:00", 2, None, "t", "u"),
            (3, "a", 1, "e", None, "2024-01-02 07:00:00", 2, None, "t", "u"),
            (4, "a", 1, "m", None, "2024-01-02 09:00:00", 2, None, "t", "u"),
            (5, None, None, "m", None, "2024-01-02 09:00:00", 2, None, "t", "u"),
            (6, None, None, "e", None, "2024-01-02 10:00:00", 2, None, "t", "u"),
        ],
    )
    kept = P.suppress_covered(df, "phone", "lead_created", "union_rn", ["row"])
    assert values(kept.select("row")) == [(1,), (3,), (5,)]
    flagged = P.period_flags(df, COLS).where("union_rn = 1 OR rn_daily = 1")
    assert values(flagged.select("row")) == values(kept.select("row"))


def test_labels_come_from_the_counted_row(rows):
    df = P.period_flags(
        rows(
            FACT,
            [
                (1, "a", 1, "m", "2024-01-05", "2024-01-01 08:00:00", 1, 1, "by_user", "first"),
                (2, "a", 1, "m", "2024-01-06", "2024-01-02 08:00:00", 1, 2, "by_operator", "second"),
                (3, "a", 1, "undefined", None, "2024-01-03 08:00:00", 2, None, "by_operator", "third"),
                (4, None, None, "m", None, "2024-01-03 08:00:00", 2, None, "by_operator", "fourth"),
            ],
        ),
        COLS,
    )
    month = P.period_labels(df, "month", ("phone", "student_id"), cols=COLS)
    got = {r.row: r.lead_type_2_month for r in month.collect()}
    assert got == {1: "first", 2: "first", 3: "first", 4: "fourth"}


def test_labels_that_end_equal_come_out_once(rows):
    """A missing label becomes the row's own, which another counted row may have as well."""
    df = P.period_flags(
        rows(
            FACT,
            [
                (1, "a", 1, "m", "2024-01-05", "2024-01-01 08:00:00", 1, 1, "by_operator", "x"),
                (2, "a", 1, "n", "2024-01-06", "2024-01-02 08:00:00", 1, 2, "by_operator", None),
                (3, "a", 1, "undefined", None, "2024-01-03 08:00:00", 2, None, "by_operator", "x"),
                (4, "a", 1, "undefined", None, "2024-01-04 08:00:00", 2, None, "by_operator", "y"),
            ],
        ),
        COLS,
    )
    fact = df.where("row <= 2")
    month = P.period_labels(df, "month", ("phone", "student_id"), cols=COLS, fact=fact)
    got = sorted((r.row, r.lead_type_month, r.lead_type_2_month) for r in month.collect())
    same = "by_operator"
    assert got == [(1, same, "x"), (2, same, None), (3, same, "x"), (4, same, "x"), (4, same, "y")]


def test_conversion_rates_and_as_of(rows):
    """8000 requests, 2656 finished, some not due yet: plain rate 33%, as-of rate higher, counts unchanged."""
    due, later = 7000, 1000
    fact = rows("n int", [(1,)]).select(F.explode(F.sequence(F.lit(1), F.lit(due + later))).alias("n")).selectExpr(
        "date'2023-02-10' AS trial_created_at", "timestamp'2023-02-09' AS lead_created", "1 AS rn_monthly",
        f"CASE WHEN n <= {due} THEN timestamp'2023-02-17 10:00:00' ELSE timestamp'2023-02-18' END AS time_start",
        "CASE WHEN n <= 2656 THEN date'2023-02-17' END AS trial_finished_at", "CAST(NULL AS DATE) AS first_purchase")
    rate = R.conversion(R.funnel_counts(fact, "month", "request")).first()
    assert (rate.requests, rate.finished, rate.purchases) == (8000, 2656, 0)
    assert round(rate.request_to_finished, 2) == 0.33 and rate.finished_to_purchase == 0
    as_of = R.conversion_as_of(fact, "2023-02-17").first()
    assert (as_of.requests, as_of.finished) == (8000, 2656)
    assert as_of.request_to_finished == pytest.approx(2656 / due)
    assert R.conversion_as_of(fact, "2023-01-01").first().request_to_finished is None


def test_rejected_payloads_by_reason(spark):
    cases = {
        None: "null", "": "broken", "[{": "broken", "x": "broken", '[{"Description":"a"},{"Desc': "broken", "7": "not_a_list",
        '"text"': "not_a_list", "null": "not_a_list", "[]": "empty", "[1]": "not_an_object", '[{"Description":"a"},2]': "not_an_object",
        '[{"description":"a"}]': "other_case", '[{"Description":"a"},{"DESCRIPTION":"b"}]': "other_case", '[{"Other":"a"}]': "missing_key",
        "{}": "missing_key", '[{"Description":"a"},{}]': "missing_key", '[{"Description":null}]': None, '{"Description":"a"}': None,
        '[{"Description":"a","description":"b"}]': None, '[{"Description":{"deep":1}}]': None,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "id long, data string")
    got = rejected_payloads(df, "data", "struct<Description:string>", ["id"], ["Description"])
    assert got.columns == ["id", "data", "reason"]
    assert {r["data"]: r["reason"] for r in got.collect()} == {k: v for k, v in cases.items() if v}
    # what is not rejected, or only lacks a key, gives a line for each element
    lines = explode_json(df.join(got, "id", "left_anti"), "data", "struct<Description:string>", ["id"])
    assert lines.count() == sum(v is None for v in cases.values())
    assert rejected_payloads(df.limit(0), "data", "struct<a:int>", ["id"]).isEmpty()
