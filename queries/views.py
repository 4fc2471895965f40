"""Funnel-shaped views of the test tables, once in Spark and once in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stagewise.config import FunnelConfig
from stagewise.functions import vocab
from stagewise.functions.columns import code_label
from stagewise.operators.skew import HotGroups, find_hot
from stagewise.session import Workspace
from stagewise.sources.tables import FunnelSources

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A scan of a test table; the schema is read from the files once."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if path not in SCHEMAS:
        SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(SCHEMAS[path]).parquet(path)


PLAIN = {"timestamp": "timestamp_ntz", "boolean": "int"}


def plain_types(df: DataFrame) -> DataFrame:
    """Timestamps without zone and flags as 0/1, as the SQL side has them."""
    return df.select(*[F.col(n).cast(PLAIN[t]).alias(n) if t in PLAIN else F.col(n) for n, t in df.dtypes])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their code k (0-99) and zoned time."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        "value",
        F.from_json("props", "k int")["k"].alias("k"),
    )


def _kind(spark, sf_dir, kind: str, *columns) -> DataFrame:
    return events(spark, sf_dir).where(F.col("event_type") == kind).select(*columns)


def code():
    return F.expr("k % 14 + 1")


def lead(spark, sf_dir) -> DataFrame:
    return _kind(
        spark, sf_dir, "view", F.col("event_id").alias("lead_id"), F.col("user_id").alias("person"),
        code().alias("lead_code"), F.col("ts").alias("lead_at"), F.col("k").alias("lead_k"),
    )


def request(spark, sf_dir) -> DataFrame:
    return _kind(
        spark, sf_dir, "signup", F.col("event_id").alias("request_id"), F.col("user_id").alias("person"),
        code().alias("code"), F.col("ts").alias("request_at"),
        F.expr("CASE WHEN k % 5 = 0 THEN ts + INTERVAL 1 HOUR END").alias("canceled_at"), F.col("k").alias("request_k"),
    )


def done(spark, sf_dir) -> DataFrame:
    return _kind(
        spark, sf_dir, "click", F.col("event_id").alias("done_id"), F.col("user_id").alias("person"),
        code().alias("code"), F.col("ts").alias("done_at"),
    )


def purchase(spark, sf_dir) -> DataFrame:
    return _kind(
        spark, sf_dir, "purchase", F.col("event_id").alias("purchase_id"), F.col("user_id").alias("person"),
        code().alias("code"), F.col("ts").alias("purchase_at"), F.col("value").alias("amount"),
    )


def stafflog(spark, sf_dir) -> DataFrame:
    return _kind(
        spark, sf_dir, "error", F.col("event_id").alias("log_id"), F.col("user_id").alias("person"),
        F.col("ts").alias("log_at"),
    )


def hot_persons(spark, sf_dir) -> HotGroups:
    """Persons with very many events; one narrow pass serves all joins of a query."""
    return find_hot(table(spark, sf_dir, "events").select(F.col("user_id").alias("person")), ["person"])


def person(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS person",
        "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat('p', c_custkey) END AS contact",
        "c_mktsegment AS segment",
        "c_nationkey AS nation",
    )


def payment(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS payment_id", "o_custkey AS client_id", "CAST(o_orderdate AS TIMESTAMP) AS moment",
        "o_totalprice AS amount", "o_orderstatus AS state", "o_orderpriority AS text",
    )


def lesson(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return table(spark, sf_dir, "lineitem").join(orders, F.expr("l_orderkey = o_orderkey")).selectExpr(
        "o_custkey AS client_id", "l_partkey % 14 + 1 AS code", "CAST(l_shipdate AS TIMESTAMP) AS start_at"
    )


SUBJECT_SQL = "CASE {0} " + " ".join(f"WHEN {c} THEN '{n}'" for c, n in vocab.SUBJECTS.items()) + " ELSE 'undefined' END"

VIEWS_SQL = """
ev AS (SELECT event_id, ts, user_id, event_type, value,
              CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
lead_v AS (SELECT event_id AS lead_id, user_id AS person, k % 14 + 1 AS lead_code, ts AS lead_at, k AS lead_k
           FROM ev WHERE event_type = 'view'),
request_v AS (SELECT event_id AS request_id, user_id AS person, k % 14 + 1 AS code, ts AS request_at,
                     CASE WHEN k % 5 = 0 THEN ts + INTERVAL 1 HOUR END AS canceled_at, k AS request_k
              FROM ev WHERE event_type = 'signup'),
done_v AS (SELECT event_id AS done_id, user_id AS person, k % 14 + 1 AS code, ts AS done_at
           FROM ev WHERE event_type = 'click'),
purchase_v AS (SELECT event_id AS purchase_id, user_id AS person, k % 14 + 1 AS code, ts AS purchase_at,
                      value AS amount FROM ev WHERE event_type = 'purchase'),
stafflog_v AS (SELECT event_id AS log_id, user_id AS person, ts AS log_at FROM ev WHERE event_type = 'error'),
person_v AS (SELECT c_custkey AS person, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'p' || c_custkey END AS contact,
                    c_mktsegment AS segment, c_nationkey AS nation FROM customer),
payment_v AS (SELECT o_orderkey AS payment_id, o_custkey AS client_id, CAST(o_orderdate AS TIMESTAMP) AS moment,
                     o_totalprice AS amount, o_orderstatus AS state, o_orderpriority AS text FROM orders),
lesson_v AS (SELECT o_custkey AS client_id, l_partkey % 14 + 1 AS code, CAST(l_shipdate AS TIMESTAMP) AS start_at
             FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""


# --- the twelve source tables of the funnel, bound to the test tables ---------

CONFIG = FunnelConfig(
    lo="2024-01-01 00:00:00", hi="2024-01-31 00:00:00", era_cut="2024-01-15", site="site.example.com"
)

# Landing pages of the binding, by k % 8.
PAGES = (
    "https://site.example.com/",
    "https://site.example.com/english/?utm=1",
    "https://site.example.com/middle-school/5",
    "https://site.example.com/tutors/",
    "http://localhost:3000/a",
    "https://site.example.com/slot-select?x=1",
    "https://site.example.com/english2",
)

# Payment lines of the binding, by k % 6.
LINES = {
    0: '[{"Description":"Пробное занятие"}]',
    1: '[{"Description":"Курс английского"},{"Description":"Курс математики"}]',
    2: '[{"Description":"математика"}]',
    4: "[]",
    5: '{"Description":"английский язык"}',
}
PACKAGES = '[{"lessons_count":"4"},{"lessons_count":"8"}]'
TRAFFIC = ("internal", "external", "organic", "floctory", "telemarketing")


def _case(of: str, values) -> str:
    pairs = values.items() if isinstance(values, dict) else enumerate(values)
    return f"CASE {of} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in pairs) + " END"


LEVEL_SQL = _case("CAST(floor(value) AS BIGINT) % 5", ("grade_1_4", "middle_school", "high_school", "other"))
PAGE_SQL = _case("k % 8", PAGES)
LINE_SQL = _case("k % 6", LINES)
TRAFFIC_SQL = _case("c_custkey % 6", TRAFFIC)
LEAD_TRAFFIC_SQL = _case("k % 6", TRAFFIC)
LEAD_SUBJECT_SQL = f"CASE WHEN k % 15 = 14 THEN NULL ELSE {SUBJECT_SQL.format('k % 14 + 1')} END"
LEAD_PHONE_SQL = "CASE WHEN k % 33 = 0 THEN NULL ELSE 'p' || user_id END"

# table -> (base view, select list); both engines read these the same way
SELECTS = {
    "parents": (
        "customer",
        {
            "id": "c_custkey",
            "phone": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'p' || c_custkey END",
            "first_name": "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_name END",
            "last_name": "CASE WHEN c_custkey % 22 = 0 THEN NULL ELSE c_mktsegment END",
            "created_at": "TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * (c_custkey % 720)",
            "is_location_moscow": "c_nationkey % 2 = 0",
        },
    ),
    "students": (
        "customer",
        {
            "id": "c_custkey",
            "parent_id": "CASE WHEN c_custkey % 10 = 3 THEN c_custkey - 1 ELSE c_custkey END",
            "first_name": "CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN 'Test' ELSE c_name END",
            "last_name": "c_mktsegment",
            "phone": "CASE WHEN c_custkey % 14 = 0 THEN NULL ELSE 's' || c_custkey END",
        },
    ),
    "lessons": (
        "lesson_events",
        {
            "id": "event_id",
            "created_at": "ts",
            "time_start": "CASE event_type WHEN 'signup' THEN date_trunc('day', ts) + INTERVAL '1' HOUR * "
            "(24 * (k % 10) + 34) ELSE ts + INTERVAL '1' HOUR * 24 END",
            "canceled_at": "CASE WHEN k % 5 = 0 THEN ts + INTERVAL '1' HOUR END",
            "subject_id": "k % 14 + 1",
            "grade_kind": LEVEL_SQL,
            "trial": "CASE WHEN event_type = 'signup' THEN true WHEN k % 2 = 0 THEN false END",
            "kind": "CASE WHEN k % 10 = 9 THEN 2 WHEN k % 10 = 8 THEN NULL ELSE 1 END",
            "status": "CAST(event_id % 5 AS INT)",
            "test": "CASE WHEN k % 6 = 0 THEN NULL ELSE k % 6 = 5 END",
        },
    ),
    "lessons_students_statuses": (
        "signups",
        {"lesson_id": "event_id", "reason": "CASE WHEN k % 3 = 0 THEN 'r' || (k % 4) END"},
    ),
    "lesson_creation_logs": (
        "signups",
        {"id": "event_id", "lesson_id": "CASE WHEN event_id % 3 > 0 THEN event_id END", "student_id": "user_id"},
    ),
    "landing_leads": (
        "views",
        {
            "phone": LEAD_PHONE_SQL,
            "name": "CASE WHEN k = 1 THEN 'Test' WHEN k % 2 = 0 THEN NULL ELSE 'n' END",
            "subject": LEAD_SUBJECT_SQL,
            "grade_kind": LEVEL_SQL,
            "page_url": PAGE_SQL,
            "created_at": "ts",
            "tag": "CASE WHEN k % 25 = 0 THEN 'x,funnel' WHEN k % 2 = 0 THEN NULL ELSE 'y' END",
        },
    ),
    "payments": (
        "purchases",
        {
            "id": "event_id",
            "client_id": "user_id",
            "moment": "ts",
            "amount": "value",
            "status": "'ok'",
            "testing": "CASE WHEN k % 9 = 0 THEN NULL ELSE k % 9 = 8 END",
            "data": LINE_SQL,
        },
    ),
    "orders": (
        "purchases",
        {
            "payment_id": "event_id",
            "client_id": "user_id",
            "state": "CASE k % 5 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'new' ELSE 'paid' END",
            "data": f"CASE WHEN k % 7 = 0 THEN NULL ELSE '{PACKAGES}' END",
        },
    ),
    "traffic_source": (
        "customer",
        {
            "parent_id": "c_custkey",
            "added_to_telemarketing_list_request": "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE "
            "TIMESTAMP '2024-01-01 00:00:00' - INTERVAL '1' HOUR * (24 * (c_custkey % 80)) END",
            "utm_medium": "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'm' || (c_custkey % 5) END",
            "utm_source": "'s' || (c_custkey % 4)",
            "utm_campaign": "'c' || (c_custkey % 8)",
            "utm_content": "CASE WHEN c_custkey % 2 = 0 THEN 'x' END",
            "utm_term": "CASE WHEN c_custkey % 9 = 0 THEN 't' END",
            "traffic_source": "'channel' || (c_custkey % 6)",
            "external_source_type": TRAFFIC_SQL,
        },
    ),
    "traffic_source_lead": (
        "views",
        {
            "phone": LEAD_PHONE_SQL,
            "created_at": "ts",
            "subject": LEAD_SUBJECT_SQL,
            "grade_kind": LEVEL_SQL,
            "utm_medium_lead": "CASE WHEN k % 3 > 0 THEN 'm' || (k % 5) END",
            "utm_source_lead": "CASE WHEN k % 3 = 2 THEN 's' || (k % 4) END",
            "utm_campaign_lead": "CASE WHEN k % 3 = 2 THEN 'c' || (k % 8) END",
            "utm_content_lead": "CASE WHEN k % 3 = 2 AND k % 2 = 0 THEN 'x' END",
            "utm_term_lead": "CASE WHEN k % 3 = 2 AND k % 9 = 2 THEN 't' END",
            "traffic_source_lead": "CASE WHEN k % 3 = 2 THEN 'channel' || (k % 6) END",
            "external_source_type_lead": f"CASE WHEN k % 3 > 0 THEN {LEAD_TRAFFIC_SQL} END",
        },
    ),
}

EVENT_VIEWS = {
    "lesson_events": "event_type IN ('signup', 'click')",
    "signups": "event_type = 'signup'",
    "views": "event_type = 'view'",
    "purchases": "event_type = 'purchase'",
}


def events_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their code parsed once, a folder per type: for queries that scan their views many times.

    An empty type reads as NULL; no view has either.
    """
    ev, path = events(spark, sf_dir), f"{Workspace(spark).root}/events"
    ev.write.partitionBy("event_type").parquet(path)
    return spark.read.schema(ev.schema).parquet(path)


def sources(spark: SparkSession, sf_dir: str, ev: DataFrame | None = None) -> FunnelSources:
    ev = events(spark, sf_dir) if ev is None else ev
    customer = table(spark, sf_dir, "customer")
    made = {
        name: (customer if base == "customer" else ev.where(EVENT_VIEWS[base])).selectExpr(
            *[f"{expr} AS {column}" for column, expr in columns.items()]
        )
        for name, (base, columns) in SELECTS.items()
    }
    made["landing_leads"] = made["landing_leads"].withColumn("tag", F.split("tag", ","))
    made["lessons_students"] = ev.where(EVENT_VIEWS["lesson_events"]).selectExpr(
        "event_id AS lesson_id",
        "explode(CASE WHEN k % 20 = 0 THEN array(user_id, user_id + 1) ELSE array(user_id) END) AS student_id",
    )
    made["subjects"] = (
        ev.selectExpr("k % 14 + 1 AS id").distinct().where("id <> 14").withColumn("name", _subject_name())
    )
    return FunnelSources(**made)


def _subject_name():
    return F.initcap(code_label(F.col("id"), vocab.SUBJECTS, vocab.UNDEFINED))


SOURCES_SQL = ",\n".join(
    [VIEWS_SQL.strip().split(",\nlead_v")[0]]
    + [f"{name} AS (SELECT * FROM ev WHERE {cond})" for name, cond in EVENT_VIEWS.items()]
    + [
        f"s_{name} AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {base})"
        for name, (base, columns) in SELECTS.items()
    ]
    + [
        "s_lessons_students AS (SELECT event_id AS lesson_id, unnest(CASE WHEN k % 20 = 0 THEN [user_id, user_id + 1] "
        "ELSE [user_id] END) AS student_id FROM lesson_events)",
        "s_subjects AS (SELECT DISTINCT k % 14 + 1 AS id FROM ev WHERE k % 14 + 1 <> 14)",
    ]
)
