"""Joins: nearest events, bounded ranges, stage chains and special keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import views as V
from queries.registry import query
from stagewise.functions import columns as C
from stagewise.operators import match as M
from stagewise.operators import stages as S
from stagewise.operators.keyed import first_seen, first_trial, next_event
from stagewise.operators.labelling import explode_json
from stagewise.operators.lead_type import REQUEST_DECISIONS, REQUEST_FACTS, label_lead_type, request_facts
from stagewise.operators.rules import decide, decision_table

HALF_DAY = 43_200

_FOLLOWED = """
, spans AS (
  SELECT payment_id, client_id, moment,
         lead(moment) OVER (PARTITION BY client_id ORDER BY moment, payment_id) AS next_moment,
         moment = min(moment) OVER (PARTITION BY client_id) AS is_first
  FROM payment_v),
firsts AS (SELECT client_id, code, min(start_at) AS start_at FROM lesson_v GROUP BY 1, 2)
SELECT payment_id, s.client_id, moment, code, start_at
FROM spans s LEFT JOIN firsts f ON f.client_id = s.client_id
  AND start_at BETWEEN moment AND moment + INTERVAL 1 MONTH + INTERVAL 30 DAY
  AND start_at BETWEEN moment AND coalesce(next_moment, TIMESTAMP '2999-12-31 00:00:00')
WHERE is_first OR code IS NOT NULL
"""


def _followed(spark, d, **hot):
    payments = next_event(
        V.payment(spark, d).select("payment_id", "client_id", "moment"), ["client_id"], "moment", ["payment_id"], "next_moment"
    )
    first = first_seen(payments, ["client_id"], "moment", "first_moment")
    spans = payments.join(first, "client_id").withColumn("is_first", F.expr("first_moment = moment"))
    lessons = first_seen(V.lesson(spark, d), ["client_id", "code"], "start_at")
    end = F.col("moment") + F.expr("interval 1 month") + F.expr("interval 30 days")
    found = M.followed_by(
        spans, lessons, "client_id", "moment", "start_at", end, "next_moment", "2999-12-31 00:00:00", "is_first", **hot
    )
    return found.select("payment_id", "client_id", "moment", "code", "start_at")


@query("followed_by", f"WITH {V.VIEWS_SQL}" + _FOLLOWED)
def followed_by(spark, d):
    """Payments with the first lessons that follow before the next payment."""
    return _followed(spark, d)


@query("followed_by_blocks", f"WITH {V.VIEWS_SQL}" + _FOLLOWED)
def followed_by_blocks(spark, d):
    """The same, clients with more than 20 rows by blocks of time."""
    return _followed(spark, d, hot_rows=20)


_MATCH_LEAD = f"""
, m AS (SELECT lead_id, l.person, lead_code, lead_at, request_id, code, request_at
  FROM lead_v l JOIN request_v r ON r.person = l.person AND lead_at < request_at
  QUALIFY row_number() OVER (PARTITION BY lead_id, code ORDER BY request_at, request_id) = 1)
SELECT * FROM m WHERE floor(epoch(request_at)) - floor(epoch(lead_at)) < {HALF_DAY}
"""
_MATCH_REQUEST = f"""
, m AS (SELECT lead_id, l.person, lead_code, lead_at, request_id, code, request_at
  FROM lead_v l JOIN request_v r ON r.person = l.person AND lead_at < request_at
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY lead_at DESC, lead_id DESC) = 1)
SELECT * FROM m WHERE floor(epoch(request_at)) - floor(epoch(lead_at)) < {HALF_DAY}
"""


def matched(spark, d, rank_side):
    leads = V.lead(spark, d).drop("lead_k")
    requests = V.request(spark, d).select("request_id", "person", "code", "request_at")
    return M.nearest_match(
        leads, requests, "person", "lead_at", "lead_id", "request_at", "request_id", "code", HALF_DAY, rank_side
    )


@query("nearest_match", f"WITH {V.VIEWS_SQL}" + _MATCH_LEAD)
def nearest_match(spark, d):
    """For every lead the nearest later request of each subject."""
    return matched(spark, d, "lead")


@query("nearest_match_request", f"WITH {V.VIEWS_SQL}" + _MATCH_REQUEST)
def nearest_match_request(spark, d):
    """For every request the nearest earlier lead."""
    return matched(spark, d, "request")


@query("interval_join", f"""
WITH {V.VIEWS_SQL}, m AS (SELECT lead_id, code, request_id, request_at, lead_at
  FROM lead_v l JOIN request_v r ON r.person = l.person AND lead_at < request_at
  QUALIFY row_number() OVER (PARTITION BY lead_id, code ORDER BY request_at, request_id) = 1)
SELECT request_id, lead_id FROM request_v LEFT JOIN (
  SELECT request_id, lead_id FROM m
  WHERE floor(epoch(request_at)) - floor(epoch(lead_at)) < {HALF_DAY} AND lead_at + INTERVAL 3 HOUR > request_at
) USING (request_id)
""")
def interval_join(spark, d):
    """Requests with their matched leads of the last three hours, ends excluded."""
    pairs = matched(spark, d, "lead").select(
        F.col("request_id").alias("_r"), "lead_id", "lead_at")
    requests = V.request(spark, d).select("request_id", "request_at")
    near = F.expr("request_id = _r AND lead_at < request_at AND lead_at + INTERVAL 3 HOURS > request_at")
    return requests.join(pairs, near, "left").select("request_id", "lead_id")


_TOUCHED = f"""
WITH {V.VIEWS_SQL}, touch AS (
  SELECT person, CASE WHEN person % 9 = 0 THEN NULL ELSE log_at END AS touch_at, log_id FROM stafflog_v)
SELECT request_id, r.person, log_id FROM request_v r LEFT JOIN touch t
  ON t.person = r.person AND (request_at <= touch_at + INTERVAL 10 DAY OR touch_at IS NULL)
"""


def _touched(spark, d, **hot):
    touches = V.stafflog(spark, d).selectExpr(
        "person", "CASE WHEN person % 9 = 0 THEN NULL ELSE log_at END AS touch_at", "log_id")
    requests = V.request(spark, d).select("request_id", "person", "request_at")
    joined = M.attribute_within(requests, touches, "person", "request_at", "touch_at", "interval 10 days", **hot)
    return joined.select("request_id", "person", "log_id")


@query("attribute_within", _TOUCHED)
def attribute_within(spark, d):
    """Requests with all registration touches of the person that are valid."""
    return _touched(spark, d, hot=V.hot_persons(spark, d))


@query("attribute_within_blocks", _TOUCHED)
def attribute_within_blocks(spark, d):
    """The same, persons with more than 10 requests by blocks of time."""
    return _touched(spark, d, hot_rows=10)


@query("stage_chain", f"""
WITH {V.VIEWS_SQL}
SELECT request_id, request_at, contact, segment, done_at, purchase_at
FROM request_v r LEFT JOIN person_v p ON p.person = r.person
LEFT JOIN (SELECT person, code, min(done_at) AS done_at FROM done_v GROUP BY 1, 2) f
  ON f.person = r.person AND f.code = r.code
LEFT JOIN (SELECT person, code, min(purchase_at) AS purchase_at FROM purchase_v GROUP BY 1, 2) b
  ON b.person = r.person AND b.code = r.code
""")
def stage_chain(spark, d):
    """Requests with person, first finished lesson and first purchase of the code."""
    both = {"person": "person", "code": "code"}
    return S.attach_stages(
        V.request(spark, d).select("request_id", "person", "code", "request_at"),
        [
            S.Stage(V.person(spark, d), {"person": "person"}, {"contact": "contact", "segment": "segment"}),
            S.Stage(first_seen(V.done(spark, d), ["person", "code"], "done_at"), both, {"done_at": "done_at"}),
            S.Stage(
                first_seen(V.purchase(spark, d), ["person", "code"], "purchase_at"), both, {"purchase_at": "purchase_at"}
            ),
        ],
    ).drop("person", "code")


_FIRST_BUY = "SELECT person, CASE WHEN code = 1 THEN NULL ELSE code END AS code, min(purchase_at) AS purchase_at FROM purchase_v GROUP BY 1, 2"


def _first_buy(spark, d):
    return first_seen(
        V.purchase(spark, d).withColumn("code", F.expr("CASE WHEN code = 1 THEN NULL ELSE code END")),
        ["person", "code"],
        "purchase_at",
    )


@query("null_wildcard_join", f"""
WITH {V.VIEWS_SQL}, b AS ({_FIRST_BUY})
SELECT request_id, purchase_at FROM request_v r LEFT JOIN b
  ON b.person = r.person AND coalesce(b.code, r.code) = r.code
""")
def null_wildcard_join(spark, d):
    """A purchase without a code belongs to every request of the person."""
    stage = S.Stage(_first_buy(spark, d), {"person": "person"}, {"purchase_at": "purchase_at"}, ("code", "code"))
    return S.attach_stages(V.request(spark, d).select("request_id", "person", "code"), [stage]).drop("person", "code")


@query("null_safe_join", f"""
WITH {V.VIEWS_SQL}, b AS ({_FIRST_BUY}),
r AS (SELECT request_id, person, CASE WHEN code = 2 THEN NULL ELSE code END AS code FROM request_v)
SELECT request_id, r.code, purchase_at FROM r LEFT JOIN b
  ON b.person = r.person AND b.code IS NOT DISTINCT FROM r.code
""")
def null_safe_join(spark, d):
    requests = V.request(spark, d).selectExpr("request_id", "person", "CASE WHEN code = 2 THEN NULL ELSE code END AS code")
    joined = S.left_join_null_safe(requests, _first_buy(spark, d), {"person": "person", "code": "code"})
    return joined.drop("person")


@query("fallback_key_join", f"""
WITH {V.VIEWS_SQL}, b AS (
  SELECT contact, p.person, count(*) AS purchases FROM purchase_v b JOIN person_v p ON p.person = b.person GROUP BY 1, 2)
SELECT lead_id, purchases FROM lead_v l JOIN person_v p ON p.person = l.person
LEFT JOIN b ON coalesce(b.contact, CAST(b.person AS VARCHAR)) = coalesce(p.contact, CAST(p.person AS VARCHAR))
""")
def fallback_key_join(spark, d):
    """Contact where there is one, else the person's id, as text."""
    people = V.person(spark, d).select("person", "contact")
    bought = V.purchase(spark, d).join(people, "person").groupBy("contact", "person").agg(
        F.count(F.lit(1)).alias("purchases"))
    leads = V.lead(spark, d).select("lead_id", "person").join(people, "person")
    return S.left_join_fallback(leads, bought, ["contact", "person"], ["contact", "person"]).select("lead_id", "purchases")


_STAFF = f"""
, m AS (SELECT lead_id, lead_code, lead_at, request_id AS m_request
  FROM lead_v l JOIN request_v r ON r.person = l.person AND lead_at < request_at
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY lead_at DESC, lead_id DESC) = 1
    AND floor(epoch(request_at)) - floor(epoch(lead_at)) < {HALF_DAY}),
staff AS (SELECT request_id AS s_request, log_id
  FROM request_v r JOIN stafflog_v s ON s.person = r.person AND log_at < request_at
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY log_at DESC, log_id DESC) = 1
    AND log_at >= request_at - INTERVAL 1 DAY),
ft AS (SELECT person, code, request_at AS first_at FROM request_v
  QUALIFY row_number() OVER (PARTITION BY person, code ORDER BY canceled_at NULLS LAST, request_at, request_id) = 1),
fta AS (SELECT person, request_at AS first_any FROM request_v
  QUALIFY row_number() OVER (PARTITION BY person ORDER BY canceled_at NULLS LAST, request_at, request_id) = 1),
led AS (
  SELECT r.request_id, r.person, r.code, r.request_at, r.request_k, log_id, lead_id, lead_at,
         CASE WHEN lead_code > 7 THEN lead_code END AS lead_subject, first_at, first_any,
         CASE WHEN lead_id IS NULL THEN NULL ELSE lead_code % 2 END AS rule_flag,
         CASE WHEN log_id IS NULL THEN request_at - INTERVAL 1 MINUTE
              WHEN lead_at IS NULL THEN request_at ELSE lead_at END AS lead_created
  FROM request_v r LEFT JOIN m ON m_request = request_id LEFT JOIN staff ON s_request = request_id
  LEFT JOIN ft ON ft.person = r.person AND ft.code = r.code LEFT JOIN fta ON fta.person = r.person),
typed AS (
  SELECT *, CASE WHEN log_id IS NULL THEN 'by_user' ELSE 'by_operator' END AS lead_type,
    CASE WHEN log_id IS NULL AND first_any = request_at THEN 'by_user: new'
         WHEN log_id IS NULL AND first_any <> request_at THEN 'by_user: current'
         WHEN log_id IS NOT NULL AND lead_at IS NULL THEN 'by_operator: other'
         WHEN CASE WHEN lead_subject IS NULL THEN first_any ELSE first_at END < lead_at
              THEN 'by_operator: rescheduled_lead'
         WHEN CASE WHEN lead_subject IS NULL THEN first_any ELSE first_at END >= lead_at AND rule_flag = 1
              THEN 'by_operator: funnel_page_new_lead'
         WHEN CASE WHEN lead_subject IS NULL THEN first_any ELSE first_at END >= lead_at AND rule_flag = 0
              THEN 'by_operator: not_funnel_page_new_lead'
         ELSE 'undefined' END AS lead_type_2
  FROM led)
"""
LED_SQL = f"WITH {V.VIEWS_SQL}" + _STAFF


def led_requests(spark, d, hot=None):
    """Requests with staff log, nearest lead, first trials and derived lead time."""
    hot = hot or V.hot_persons(spark, d)
    requests = V.request(spark, d)
    leads = V.lead(spark, d).select("person", "lead_id", "lead_code", "lead_at")
    earlier = [M.Other(leads, "lead_at", "lead_id", "m"), M.Other(V.stafflog(spark, d), "log_at", "log_id", "s")]
    found = M.asof(requests, earlier, ["person"], "request_at", "prev", hot)
    near = C.seconds_between(F.col("m.lead_at"), F.col("request_at")) < HALF_DAY
    recent = F.col("s.log_at") >= F.col("request_at") - F.expr("interval 1 day")
    rows = found.select(
        "request_id", "person", "code", "request_at", "request_k",
        F.when(near, F.col("m.lead_id")).alias("lead_id"),
        F.when(near, F.col("m.lead_at")).alias("lead_at"),
        F.when(near & (F.col("m.lead_code") > 7), F.col("m.lead_code")).alias("lead_subject"),
        F.when(near, F.col("m.lead_code") % 2).alias("rule_flag"),
        F.when(recent, F.col("s.log_id")).alias("log_id"),
    )
    trials = requests.select("person", "code", "request_id", "request_at", "canceled_at")
    by_code = first_trial(trials, ["person", "code"], "canceled_at", "request_at", "request_id")
    by_person = first_trial(trials, ["person"], "canceled_at", "request_at", "request_id")
    staged = S.attach_stages(
        rows,
        [
            S.Stage(by_code, {"person": "person", "code": "code"}, {"request_at": "first_at"}),
            S.Stage(by_person, {"person": "person"}, {"request_at": "first_any"}),
        ],
    )
    timed = S.derive_lead_time(staged, "log_id", "lead_at", "request_at")
    typed = timed.withColumn("lead_type", S.enrolment_type(F.col("log_id")))
    return label_lead_type(
        typed, "log_id", "lead_at", "lead_subject", "first_at", "first_any", "request_at", "rule_flag"
    )


@query("staff_created", LED_SQL + "SELECT lead_type, count(*) AS n FROM typed GROUP BY 1")
def staff_created(spark, d):
    return led_requests(spark, d).groupBy("lead_type").agg(F.count(F.lit(1)).alias("n"))


@query("lead_time", LED_SQL + "SELECT request_id, log_id, lead_id, lead_created FROM typed")
def lead_time(spark, d):
    return led_requests(spark, d).select("request_id", "log_id", "lead_id", "lead_created")


@query("lead_type", LED_SQL + "SELECT lead_type, lead_type_2, count(*) AS n FROM typed GROUP BY 1, 2")
def lead_type(spark, d):
    return led_requests(spark, d).groupBy("lead_type", "lead_type_2").agg(F.count(F.lit(1)).alias("n"))


@query("lead_type_table", LED_SQL + "SELECT lead_type, lead_type_2, count(*) AS n FROM typed GROUP BY 1, 2")
def lead_type_table(spark, d):
    """The same types by a table of decisions."""
    names = ["log_id", "lead_at", "lead_subject", "first_at", "first_any", "request_at", "rule_flag"]
    rules = decision_table(spark, REQUEST_FACTS, REQUEST_DECISIONS)
    typed = decide(
        led_requests(spark, d).drop("lead_type_2"), request_facts(*[F.col(c) for c in names]), rules, out="lead_type_2"
    )
    return typed.groupBy("lead_type", "lead_type_2").agg(F.count(F.lit(1)).alias("n"))


@query("same_hour", LED_SQL + """
SELECT CASE WHEN date_trunc('hour', lead_at) = date_trunc('hour', request_at) THEN 'new' ELSE 'current' END
         AS same_bucket, count(*) AS n FROM typed GROUP BY 1
""")
def same_hour(spark, d):
    flagged = S.with_same_bucket_flag(led_requests(spark, d), "lead_at", "request_at")
    return flagged.groupBy("same_bucket").agg(F.count(F.lit(1)).alias("n"))


@query("group_fallback", f"""
WITH {V.SOURCES_SQL}, j AS (
  SELECT * FROM s_traffic_source_lead l LEFT JOIN s_traffic_source t ON 'p' || t.parent_id = l.phone)
SELECT CASE WHEN e THEN utm_medium ELSE utm_medium_lead END AS utm_medium_lead,
       CASE WHEN e THEN utm_source ELSE utm_source_lead END AS utm_source_lead, count(*) AS n
FROM (SELECT *, coalesce(utm_medium_lead, utm_source_lead) IS NULL AS e FROM j) GROUP BY 1, 2
""")
def group_fallback(spark, d):
    """Lead tags, or the registration's tags where the lead has none at all."""
    src = V.sources(spark, d)
    joined = src.traffic_source_lead.join(
        src.traffic_source.withColumn("_phone", F.expr("'p' || parent_id")), F.expr("phone = _phone"), "left")
    filled = S.with_group_fallback(joined, ["utm_medium_lead", "utm_source_lead"], ["utm_medium", "utm_source"])
    return filled.groupBy("utm_medium_lead", "utm_source_lead").agg(F.count(F.lit(1)).alias("n"))


@query("payment_items", f"""
WITH {V.SOURCES_SQL}, j AS (
  SELECT id, CASE WHEN data LIKE '[%' THEN CAST(json_extract(data, '$[*].Description') AS VARCHAR[])
                  WHEN data LIKE '{{%' THEN [json_extract(data, '$.Description')::VARCHAR] END AS items FROM s_payments),
x AS (SELECT id, trim(unnest(items), '"') AS text FROM j)
SELECT text, CASE WHEN contains(text, 'англ') THEN 1 WHEN contains(text, 'матем') THEN 2 END AS code, count(*) AS n
FROM x GROUP BY 1, 2
""")
def payment_items(spark, d):
    """Lines of the payments' JSON with their subject; a lone object is one line."""
    lines = explode_json(V.sources(spark, d).payments, "data", "struct<Description:string>", ["id"])
    return (
        lines.select(F.col("item.Description").alias("text"))
        .withColumn("code", C.keyword_class(F.col("text"), [("англ", 1), ("матем", 2)]))
        .groupBy("text", "code").agg(F.count(F.lit(1)).alias("n"))
    )
