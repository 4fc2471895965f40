"""Labels, pages, rules and buckets on literal rows."""

from pyspark.sql import functions as F

from stagewise.functions import columns as C
from stagewise.functions import vocab
from stagewise.operators import labelling as L
from stagewise.operators.keyed import first_per_key, first_seen, first_trial, next_event
from tests.conftest import values


def test_explode_json_keeps_only_real_elements(rows):
    df = rows(
        "id int, data string",
        [(1, None), (2, "[]"), (3, "oops"), (4, '{"a":"x"}'), (5, '[{"a":"y"},{"b":"z"}]')],
    )
    out = L.explode_json(df, "data", "struct<a:string>", ["id"]).select("id", "item.a")
    assert values(out) == [(4, "x"), (5, "y"), (5, None)] or values(out) == [(4, "x"), (5, None), (5, "y")]


def test_keyword_first_hit_wins(rows):
    df = rows("t string", [("курс англ и матем",), ("матем",), ("other",), (None,)])
    out = L.with_keyword_class(df, "t", vocab.PAYMENT_KEYWORDS)
    assert values(out.select("code")) == [(1,), (2,), (None,), (None,)]


def test_code_label_both_ways_and_by_table(rows, spark):
    df = rows("c int", [(1,), (14,), (99,), (None,)])
    out = {r.c: r.label for r in L.with_code_label(df, "c", vocab.SUBJECTS, "undefined").collect()}
    assert out == {1: "english", 14: "summer_program", 99: "undefined", None: "undefined"}
    dim = spark.createDataFrame([(1, "english"), (14, "summer_program")], "code int, name string")
    assert {r.c: r.label for r in L.with_code_label(df, "c", dim, "undefined").collect()} == out


def test_pair_label(rows):
    df = rows("s string, g string", [("english", "high_school"), ("english", "x"), (None, "grade_1_4"), ("nature", None)])
    out = L.with_pair_label(df, "s", "g", vocab.PRODUCTS).select("label")
    assert values(out) == [("english_exam",), ("undefined",), ("undefined",), ("undefined",)]
    assert len(vocab.PRODUCTS) == 26 and len(vocab.PRODUCTS_BY_ID) == 24


def test_canonical_page_strict_and_literal(rows):
    urls = ["h/x", "h/x?q=1", "h/x/?q=1", "h/x/", None, "h/tilda?slot-select", "h/a?tilda"]
    df = rows("u string", [(u,) for u in urls])

    def page(**kw):
        return {r.u: r.page for r in L.with_canonical_page(df, "u", vocab.PAGE_LABELS, **kw).collect()}

    assert page()["h/x"] == page()["h/x?q=1"] == page()["h/x/?q=1"] == page()["h/x/"] == "h/x/"
    assert page(strict=False)["h/x/?q=1"] == "h/x//"
    assert page()["h/tilda?slot-select"] == "tilda_tests"
    assert page()["h/a?tilda"] == "h/a/"
    assert page()[None] is None


def test_rule_flag_launch_bounds_and_tags(spark):
    site = "example.com"
    data = [
        ("https://example.com/english2/", "2022-06-01 00:00:00", None, 1),
        ("https://example.com/english2/", "2022-05-31 23:59:59", None, 0),
        ("https://example.com/", "2022-06-13 17:00:00", None, 0),
        ("https://example.com/", "2022-06-13 17:00:01", None, 1),
        ("https://example.com/russian/", "2023-01-01 00:00:00", None, 1),
        ("https://example.com/other/", "2023-01-01 00:00:00", None, 0),
        (None, "2020-01-01 00:00:00", ["a", "my funnel"], 1),
        (None, "2023-01-01 00:00:00", ["fun", "nel"], 0),
    ]
    df = spark.createDataFrame(data, "page string, at string, tags array<string>, want int")
    df = df.withColumn("at", F.to_timestamp("at"))
    out = L.with_rule_flag(df, "page", "at", "tags", L.launch_rules(site))
    assert out.where("rule_flag <> want").count() == 0


def test_periods_and_buckets(rows):
    df = rows("a timestamp, b timestamp", [("2024-03-31 10:59:59", "2024-03-31 10:00:00"), (None, "2024-03-31 10:00:00")])
    out = df.select(
        C.same_bucket(F.col("a"), F.col("b")).alias("f"),
        C.period("week", F.col("b")).cast("string").alias("w"),
        C.period("month", F.col("b")).cast("string").alias("m"),
    )
    assert values(out) == [("current", "2024-03-25", "2024-03-01"), ("new", "2024-03-25", "2024-03-01")]


def test_slice_bounds(rows):
    df = rows("at timestamp", [("2023-09-01 00:00:00",), ("2023-09-10 00:00:00",), ("2023-09-10 00:00:01",), (None,)])
    lo, hi = "2023-09-01", "2023-09-10"
    assert df.where(C.in_slice(F.col("at"), lo, hi, True)).count() == 2
    assert df.where(C.in_slice(F.col("at"), lo, hi, False)).count() == 1


def test_first_next_and_first_seen(rows):
    df = rows(
        "k string, at timestamp, id int",
        [("a", "2024-01-01", 2), ("a", "2024-01-01", 1), ("a", "2024-01-03", 3), (None, "2024-01-02", 4)],
    )
    assert values(first_per_key(df, ["k"], ["at", "id"]).select("id")) == [(1,), (4,)]
    nxt = {r.id: r.next_ts and r.next_ts.day for r in next_event(df, ["k"], "at", ["id"]).collect()}
    assert nxt == {1: 1, 2: 3, 3: None, 4: None}
    assert sorted((r.k or "", r.at.day) for r in first_seen(df, ["k"], "at").collect()) == [("", 2), ("a", 1)]


def test_first_trial_prefers_cancelled(rows):
    df = rows(
        "s int, lesson_id int, created_at timestamp, canceled_at timestamp",
        [(1, 1, "2024-01-01", None), (1, 2, "2024-01-02", "2024-01-05"), (2, 4, "2024-01-02", None), (2, 3, "2024-01-02", None)],
    )
    assert values(first_trial(df, ["s"]).select("lesson_id")) == [(2,), (3,)]
