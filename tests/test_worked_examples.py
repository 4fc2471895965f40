"""Small cohorts with known funnels, run through the whole pipeline."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from stagewise import FunnelConfig, FunnelSources, sales_funnel
from stagewise.functions import vocab
from stagewise.plans import report as R
from stagewise.plans.sales_funnel import STAGE_COLUMNS
from stagewise.sources.tables import write_fact

CFG = FunnelConfig(lo="2022-01-01 00:00:00", hi="2023-12-31 00:00:00")
UTM = "utm_medium, utm_source, utm_campaign, utm_content, utm_term"

SCHEMAS = {
    "parents": "id long, phone string, first_name string, last_name string, created_at timestamp, is_location_moscow boolean",
    "students": "id long, parent_id long, first_name string, last_name string, phone string",
    "lessons": "id long, created_at timestamp, time_start timestamp, canceled_at timestamp, subject_id int, grade_kind string, trial boolean, kind int, status int, test boolean",
    "lessons_students": "lesson_id long, student_id long",
    "lessons_students_statuses": "lesson_id long, reason string",
    "lesson_creation_logs": "id long, lesson_id long, student_id long",
    "landing_leads": "phone string, name string, subject string, grade_kind string, page_url string, created_at timestamp, tag string",
    "payments": "id long, client_id long, moment timestamp, amount int, status string, testing boolean, data string",
    "orders": "payment_id long, client_id long, state string, data string",
    "subjects": "id long, name string",
    "traffic_source": "parent_id long, added_to_telemarketing_list_request timestamp, utm_medium string, utm_source string, utm_campaign string, utm_content string, utm_term string, traffic_source string, external_source_type string",
    "traffic_source_lead": "phone string, created_at timestamp, subject string, grade_kind string, utm_medium_lead string, utm_source_lead string, utm_campaign_lead string, utm_content_lead string, utm_term_lead string, traffic_source_lead string, external_source_type_lead string",
}
MATH, ENGLISH, CODING, LITERACY = 2, 1, 3, 12
LEVEL = {MATH: "middle_school", ENGLISH: "middle_school", CODING: "middle_school", LITERACY: "grade_1_4"}
LESSONS = '[{"lessons_count":"8"}]'


class World:
    """Collects source rows person by person."""

    def __init__(self):
        self.t = {name: [] for name in SCHEMAS}
        self.t["subjects"] = [(i, n.title()) for i, n in vocab.SUBJECTS.items()]
        self.next_id = 100

    def person(self, n, registered="2020-01-01 00:00:00", name="Ann"):
        self.t["parents"].append((n, f"+{n}", "Eve", "Doe", registered, True))
        self.t["students"].append((n, n, name, "Doe", None))

    def lead(self, n, at, subject=None, level="middle_school", page="https://example.com/english/", name=None, tag=None):
        label = vocab.SUBJECTS.get(subject)
        self.t["landing_leads"].append((f"+{n}", name, label, level if label else None, page, at, tag))

    def lesson(self, n, at, start, subject, trial=True, status=0, staff=True, kind=1, canceled=None):
        self.next_id += 1
        self.t["lessons"].append(
            (self.next_id, at, start, canceled, subject, LEVEL[subject], trial, kind, status, False)
        )
        self.t["lessons_students"].append((self.next_id, n))
        self.t["lessons_students_statuses"] += [(self.next_id, "a"), (self.next_id, "b")]
        if trial and staff:
            self.t["lesson_creation_logs"].append((self.next_id, self.next_id, n))
        return self.next_id

    def buy(self, n, at, text="Курс"):
        self.next_id += 1
        self.t["payments"].append((self.next_id, n, at, 1000, "ok", None, f'[{{"Description":"{text}"}}]'))
        self.t["orders"] += [(self.next_id, n, "paid", LESSONS), (self.next_id, n, "new", None)]
        return self.next_id


@pytest.fixture(scope="module")
def world():
    w = World()
    # 643: one lead, two subjects, requests in August and September
    w.person(643)
    w.lead(643, "2022-08-31 09:00:00", MATH)
    w.lesson(643, "2022-08-31 12:00:00", "2022-09-01 10:00:00", MATH)
    w.lesson(643, "2022-09-02 12:00:00", "2022-09-05 10:00:00", ENGLISH)
    w.lesson(643, "2022-09-03 12:00:00", "2022-09-06 10:00:00", MATH)
    w.lesson(643, "2022-09-04 12:00:00", "2022-09-07 10:00:00", ENGLISH)
    # 1: not attended, then a second chain that ends in a purchase
    w.person(1)
    w.lead(1, "2022-09-28 10:00:00", MATH)
    w.lesson(1, "2022-10-01 10:00:00", "2022-10-03 10:00:00", MATH)
    w.lead(1, "2022-10-12 10:00:00", LITERACY, "grade_1_4")
    w.lesson(1, "2022-10-14 10:00:00", "2022-10-16 10:00:00", LITERACY, status=2)
    w.buy(1, "2022-10-18 10:00:00")
    w.lesson(1, "2022-10-18 11:00:00", "2022-10-20 10:00:00", LITERACY, trial=False, status=2)
    # 2: three subjects at once
    w.person(2)
    w.lead(2, "2022-10-13 10:00:00", MATH)
    w.lead(2, "2022-10-13 10:05:00", ENGLISH)
    w.lead(2, "2022-10-14 10:00:00", ENGLISH)
    for minute, subject in enumerate((MATH, ENGLISH, CODING)):
        w.lesson(2, f"2022-10-15 10:0{minute}:00", f"2022-10-17 1{minute}:00:00", subject, status=3)
    # 3: ten leads of one subject
    w.person(3)
    for minute in range(10):
        w.lead(3, f"2022-10-02 10:0{minute}:00", ENGLISH)
    w.lesson(3, "2022-10-05 10:00:00", "2022-10-06 10:00:00", ENGLISH, status=2)
    w.buy(3, "2022-10-08 10:00:00")
    w.lesson(3, "2022-10-08 11:00:00", "2022-10-09 10:00:00", ENGLISH, trial=False)
    # 4: registered by mailing in 2020, back as a CPA lead in 2022
    w.person(4)
    mailing = ("email", "site", "c", None, None, "mailing", "internal")
    w.t["traffic_source"].append((4, None, *mailing))
    w.lead(4, "2022-11-01 10:00:00", MATH)
    w.t["traffic_source_lead"].append(
        ("+4", "2022-11-01 10:00:00", "mathematics", None, "cpa", None, None, None, None, "cpa", "external"))
    w.lesson(4, "2022-11-02 10:00:00", "2022-11-03 10:00:00", MATH)
    # 5: lead without tags, known account
    w.person(5)
    w.t["traffic_source"].append((5, None, *mailing))
    w.lead(5, "2022-11-01 10:00:00", MATH)
    w.t["traffic_source_lead"].append(("+5", "2022-11-01 10:00:00", "mathematics", *[None] * 8))
    w.lesson(5, "2022-11-02 10:00:00", "2022-11-03 10:00:00", MATH)
    # 6: never converted; test records
    w.person(6)
    w.lead(6, "2022-12-01 10:00:00", MATH, tag="funnel")
    w.lead(6, "2022-12-02 10:00:00", MATH, name="Test")
    # 7: enrolled without staff, in the old payment era; 8: a test student
    w.person(7)
    w.lesson(7, "2022-12-05 10:00:00", "2022-12-07 10:00:00", MATH, staff=False)
    w.buy(7, "2021-08-26 23:00:00", "Курс математики")
    w.person(8, name="Тест")
    w.lesson(8, "2022-12-05 10:00:00", "2022-12-07 10:00:00", MATH)
    # 9: leads exactly two weeks and one second less before the request
    w.person(9)
    w.lead(9, "2022-06-01 10:00:00", MATH)
    w.lead(9, "2022-06-01 10:00:01", ENGLISH)
    w.lesson(9, "2022-06-15 10:00:00", "2022-06-17 10:00:00", MATH)
    return w


@pytest.fixture(scope="module")
def sources(spark, world):
    def table(name):
        fields = [f.strip().split(" ") for f in SCHEMAS[name].split(",")]
        loose = ", ".join(f"{n} {'string' if t == 'timestamp' else t}" for n, t in fields)
        return spark.createDataFrame(world.t[name], loose).selectExpr(*[f"CAST({n} AS {t}) AS {n}" for n, t in fields])

    return FunnelSources(**{name: table(name) for name in SCHEMAS})


@pytest.fixture(scope="module")
def fact(sources):
    return sales_funnel(sources, CFG).cache()


def counts(fact, person, basis, month):
    rows = R.funnel_counts(fact.where(F.col("phone") == f"+{person}"), "month", basis)
    got = {r.period: (r.leads, r.requests, r.finished, r.purchases) for r in rows.collect()}
    return got.get(date.fromisoformat(month + "-01"))


def test_output_has_52_columns(fact):
    labels = [f"{c}_{g}" for g in ("month", "week", "day") for c in ("lead_type", "lead_type_2")]
    flags = [f"rn_{p}{b}" for p in ("daily", "weekly", "monthly") for b in ("", "_lead")]
    assert fact.columns == [*STAGE_COLUMNS, "union_rn", *flags, *labels]
    assert len(fact.columns) == 52


def test_basis_toggle(fact):
    assert counts(fact, 643, "lead", "2022-08")[:2] == (2, 2)
    assert counts(fact, 643, "request", "2022-08")[1] == 1
    assert counts(fact, 643, "request", "2022-09")[1] == 2


def test_not_attended_then_bought(fact):
    assert counts(fact, 1, "lead", "2022-09") == (1, 1, 0, 0)
    assert counts(fact, 1, "lead", "2022-10") == (1, 1, 1, 1)


def test_three_subjects(fact):
    assert counts(fact, 2, "lead", "2022-10") == (3, 3, 3, 0)


def test_ten_leads_count_once(fact):
    assert counts(fact, 3, "lead", "2022-10") == (1, 1, 1, 1)


def test_attribution(fact):
    got = {
        r.phone: (r.traffic_source_request, r.traffic_source_lead, r.utm_source_lead)
        for r in fact.where("phone IN ('+4', '+5') AND union_rn = 1").collect()
    }
    assert got == {"+4": ("mailing", "cpa", None), "+5": ("mailing", "mailing", "site")}


def test_unconverted_lead_is_undefined_by_request_source(fact):
    rows = fact.where("phone = '+6'")
    assert [(r.union_rn, r.lead_type_2, r.lesson_id) for r in rows.collect()] == [
        (2, "by_operator: funnel_page_new_lead", None)]
    by = R.funnel_counts(rows, "month", "lead", [R.traffic_type("request")]).collect()
    assert [(r.traffic_type, r.leads, r.requests) for r in by] == [("undefined", 1, 0)]


def test_own_enrolment_and_old_era_purchase(fact):
    row = fact.where("phone = '+7'").first()
    assert str(row.lead_created) == "2022-12-05 09:59:00"
    assert (row.lead_type, row.lead_type_2, row.first_purchase) == ("by_user", "by_user: new", date(2021, 8, 26))
    assert (row.payment_id, row.amount, row.reason) == (None, None, "a")


def test_test_students_drop(fact):
    assert fact.where("phone = '+8'").isEmpty()


def test_two_weeks_are_exclusive(fact):
    rows = fact.where("phone = '+9' AND union_rn = 1").collect()
    assert [str(r.lal_created_at) for r in rows] == ["2022-06-01 10:00:01"]


def test_request_side_matching_takes_the_nearest_lead(sources):
    from dataclasses import replace

    from stagewise.session import Workspace

    rows = sales_funnel(sources, replace(CFG, rank_side="request"), Workspace(sources.lessons.sparkSession))
    led = rows.where("phone = '+2' AND union_rn = 1").select("lal_created_at").distinct().collect()
    assert [str(r.lal_created_at) for r in led] == ["2022-10-14 10:00:00"]


def test_every_group_hot_gives_the_same_fact(sources, fact):
    from dataclasses import replace

    hot = sales_funnel(sources, replace(CFG, hot_rows=0))
    assert hot.exceptAll(fact).isEmpty() and fact.exceptAll(hot).isEmpty()


def test_invariants(fact):
    assert fact.where("union_rn = 2 AND rn_daily <> 1").isEmpty()
    by_lead = R.funnel_counts(fact, "month", "lead")
    assert by_lead.where("requests > leads OR finished > requests OR purchases > requests").isEmpty()
    one = fact.where("union_rn = 1 AND rn_monthly = 1").groupBy(
        "phone", F.trunc("trial_created_at", "month"), "subject_name")
    assert one.agg(F.countDistinct("lesson_id").alias("n")).where("n > 1").isEmpty()


def test_write_fact_by_month(spark, fact, tmp_path):
    write_fact(fact, str(tmp_path / "fact"))
    back = spark.read.parquet(str(tmp_path / "fact"))
    assert back.count() == fact.count()
    assert {p.name for p in (tmp_path / "fact").glob("lead_month=*")} >= {"lead_month=2022-08-01", "lead_month=2022-10-01"}
