"""First, next and earliest events per key."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import views as V
from queries.registry import query
from stagewise.functions import columns as C
from stagewise.operators import keyed as K
from stagewise.plans.firsts import FirstOf, FirstState
from stagewise.session import Workspace


@query("first_per_key", """
SELECT o_custkey, o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS o_orderdate, o_totalprice
FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1
""")
def first_per_key(spark, d):
    orders = V.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return K.first_per_key(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("first_slot", f"""
WITH {V.SOURCES_SQL}
SELECT student_id, subject_id, time_start, id AS lesson_id, canceled_at
FROM s_lessons JOIN s_lessons_students ON id = lesson_id WHERE trial AND kind NOT IN (2, 5, 6)
QUALIFY row_number() OVER (PARTITION BY subject_id, student_id, time_start
                           ORDER BY canceled_at NULLS LAST, created_at, id) = 1
""")
def first_slot(spark, d):
    """One lesson per student, subject and start."""
    src = V.sources(spark, d)
    lessons = src.lessons.where("trial AND kind NOT IN (2, 5, 6)").withColumnRenamed("id", "lesson_id")
    rows = lessons.join(src.lessons_students, "lesson_id")
    order = [F.col("canceled_at").asc_nulls_last(), "created_at", "lesson_id"]
    first = K.first_per_key(rows, ["subject_id", "student_id", "time_start"], order)
    return first.select("student_id", "subject_id", "time_start", "lesson_id", "canceled_at")


@query("next_event", """
SELECT o_orderkey, o_custkey, CAST(o_orderdate AS TIMESTAMP) AS o_orderdate,
       CAST(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS TIMESTAMP) AS next_ts
FROM orders
""")
def next_event(spark, d):
    orders = V.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return K.next_event(orders, ["o_custkey"], "o_orderdate", ["o_orderkey"])


@query("first_seen", f"""
WITH {V.VIEWS_SQL}
SELECT client_id, code, min(start_at) AS first_at FROM lesson_v GROUP BY 1, 2
""")
def first_seen(spark, d):
    return K.first_seen(V.lesson(spark, d), ["client_id", "code"], "start_at", "first_at")


_FIRST_TRIAL = """
WITH {views}
SELECT {keys}, request_id, request_at FROM request_v
QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY canceled_at NULLS LAST, request_at, request_id) = 1
"""


def _first_trial(spark, d, keys):
    rows = K.first_trial(V.request(spark, d), keys, "canceled_at", "request_at", "request_id")
    return rows.select(*keys, "request_id", "request_at")


@query("first_trial", _FIRST_TRIAL.format(views=V.VIEWS_SQL, keys="person, code"))
def first_trial(spark, d):
    return _first_trial(spark, d, ["person", "code"])


@query("first_trial_any", _FIRST_TRIAL.format(views=V.VIEWS_SQL, keys="person"))
def first_trial_any(spark, d):
    return _first_trial(spark, d, ["person"])


def _trial_state(spark, d, keys):
    """State after slices of an early version of the requests, then the same slices of the true one.

    The early version lacks some requests, has some that were withdrawn since, and other
    cancel times; slices overlap and come out of order.
    """
    now = V.request(spark, d)
    ended = F.when(F.col("request_k") % 6 == 0, F.col("request_at") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("canceled_at"))
    early = now.where("request_id % 5 > 0").withColumn("canceled_at", ended)
    withdrawn = now.where("request_id % 7 = 0").withColumns(
        {"request_id": -F.col("request_id"), "canceled_at": F.col("request_at") - F.expr("INTERVAL 2 DAY")}
    )
    order = [F.col("canceled_at").asc_nulls_last(), F.col("request_at"), F.col("request_id")]
    spec = FirstOf(keys, order, ["request_id"], "request_at", ["canceled_at"])
    state = FirstState(spark, f"{Workspace(spark).root}/state", spec, parts=16)
    slices = [("2024-01-10", "2024-01-21"), ("2024-01-20", "2999-01-01"), ("1970-01-01", "2024-01-10")]
    for history in (early.unionByName(withdrawn), now):
        for lo, hi in slices:
            state.update(history.where(C.in_slice(F.col("request_at"), lo, hi, False)), lo, hi, history)
    return state.read().select(*keys, "request_id", "request_at")


@query("first_trial_state", _FIRST_TRIAL.format(views=V.VIEWS_SQL, keys="person, code"))
def first_trial_state(spark, d):
    """First trial per person and subject, from a state that slices were merged into."""
    return _trial_state(spark, d, ["person", "code"])


@query("first_trial_any_state", _FIRST_TRIAL.format(views=V.VIEWS_SQL, keys="person"))
def first_trial_any_state(spark, d):
    """First trial per person, from a state that slices were merged into."""
    return _trial_state(spark, d, ["person"])
