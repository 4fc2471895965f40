"""The whole funnel over the bound source tables, and its larger parts."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from queries import views as V
from queries.registry import query
from stagewise.functions import vocab
from stagewise.plans import leads as L
from stagewise.plans import purchases as P
from stagewise.plans import report as R
from stagewise.plans import requests as Q
from stagewise.plans.firsts import FunnelFirsts
from stagewise.plans.refresh import FactStore, refresh_slice
from stagewise.operators.rules import launch_table
from stagewise.plans.watch import Watch
from stagewise.plans.sales_funnel import FLAG_COLUMNS, LABEL_PERSON, STAGE_COLUMNS, sales_funnel
from stagewise.session import Workspace
from stagewise.sources.tables import write_fact

CFG = V.CONFIG
LO, HI, ERA = CFG.lo, CFG.hi, CFG.era_cut
TEST_LEADS, TEST_STUDENTS = vocab.TEST_LEAD_NAMES, vocab.TEST_STUDENT_NAMES

_LEVEL = "CASE WHEN {0} IN ('grade_1_4', 'middle_school', 'high_school') THEN {0} ELSE 'undefined' END"
_BY_ID = " ".join(f"WHEN '{c}/{g}' THEN '{p}'" for (c, g), p in vocab.PRODUCTS_BY_ID.items())
_BY_NAME = " ".join(f"WHEN '{s}/{g}' THEN '{p}'" for (s, g), p in vocab.PRODUCTS.items())
_CODES = " ".join(f"WHEN '{s}' THEN {c}" for c, s in vocab.SUBJECTS.items())
_TAG_NAMES = vocab.TAGS
_LEAD_TAGS = [t + "_lead" for t in _TAG_NAMES]
_PATH = "CASE WHEN contains(page_url, '?') THEN substring(page_url, 1, position('?' IN page_url) - 1) ELSE page_url END"
_LABELS = " ".join(f"WHEN contains(path, '{t}') THEN '{p}'" for t, p in vocab.PAGE_LABELS)


def _rules():
    out = []
    for test, texts, launched, by_day in vocab.LAUNCHES:
        call = "contains" if test == "contains" else "suffix"
        pages = " OR ".join(f"{call}(page, '{t.format(site=CFG.site)}')" for t in texts)
        when = f"CAST(created_at AS DATE) >= DATE '{launched[:10]}'" if by_day else f"created_at > TIMESTAMP '{launched}'"
        out.append(f"(({pages}) AND {when})")
    return " OR ".join(out)


_SLOT = "canceled_at NULLS LAST, created_at, lesson_id"
_OK_KIND = "kind NOT IN (2, 5, 6)"

TRIALS_SQL = f"""WITH {V.SOURCES_SQL},
trials AS (
  SELECT l.id AS lesson_id, l.* EXCLUDE (id), s.id AS student_id, s.first_name, s.last_name, s.phone AS student_phone,
         p.first_name AS p_first, p.last_name AS p_last, p.phone AS parent_phone, p.created_at AS parent_created_at,
         p.is_location_moscow
  FROM s_lessons l JOIN s_lessons_students b ON b.lesson_id = l.id JOIN s_students s ON s.id = b.student_id
  JOIN s_parents p ON p.id = s.parent_id WHERE l.trial),
first_trial AS (SELECT student_id, subject_id, lesson_id, created_at FROM trials WHERE {_OK_KIND}
  QUALIFY row_number() OVER (PARTITION BY student_id, subject_id ORDER BY {_SLOT}) = 1),
first_any AS (SELECT student_id, lesson_id, created_at FROM trials WHERE {_OK_KIND}
  QUALIFY row_number() OVER (PARTITION BY student_id ORDER BY {_SLOT}) = 1),
reasons AS (SELECT lesson_id, min(reason) AS reason FROM s_lessons_students_statuses GROUP BY 1),
reqs AS (
  SELECT t.student_id, t.first_name, t.is_location_moscow, parent_phone, coalesce(parent_phone, student_phone) AS phone,
         parent_created_at, t.lesson_id, reason, subject_id, {_LEVEL.format('t.grade_kind')} AS grade_kind, t.created_at,
         t.time_start
  FROM (SELECT * FROM trials WHERE {_OK_KIND} AND coalesce(first_name, last_name) IS NOT NULL
          AND coalesce(p_first, p_last) IS NOT NULL AND coalesce(parent_phone, student_phone) IS NOT NULL
          AND created_at BETWEEN TIMESTAMP '{LO}' AND TIMESTAMP '{HI}'
        QUALIFY row_number() OVER (PARTITION BY student_id, subject_id, grade_kind, time_start ORDER BY {_SLOT}) = 1) t
  LEFT JOIN reasons r ON r.lesson_id = t.lesson_id),
fin AS (SELECT student_id, subject_id, {_LEVEL.format('grade_kind')} AS grade_kind, lesson_id, time_start
  FROM trials WHERE NOT coalesce(test, false) AND status IN (2, 3))
"""


def _trials(spark, d):
    src = V.sources(spark, d)
    return src, Q.trial_lessons(src)


@query("requests", TRIALS_SQL + "SELECT student_id, phone, lesson_id, reason, subject_id, grade_kind, time_start FROM reqs")
def requests(spark, d):
    src, trials = _trials(spark, d)
    return Q.requests(trials, src.lessons_students_statuses, CFG).select(
        "student_id", "phone", "lesson_id", "reason", "subject_id", "grade_kind", "time_start")


@query("finished", TRIALS_SQL + "SELECT * FROM fin")
def finished(spark, d):
    return Q.finished(_trials(spark, d)[1], CFG)


@query("staff_log", f"""WITH {V.SOURCES_SQL}
SELECT g.id AS log_id, g.lesson_id, g.student_id, l.subject_id FROM s_lesson_creation_logs g
JOIN s_lessons l ON l.id = g.lesson_id WHERE l.trial
""")
def staff_log(spark, d):
    return Q.staff_log(V.sources(spark, d)).select("log_id", "lesson_id", "student_id", "subject_id")


@query("paid_lessons", f"""WITH {V.SOURCES_SQL}
SELECT lesson_id, student_id, subject_id, {_LEVEL.format('grade_kind')} AS grade_kind, created_at
FROM s_lessons l JOIN s_lessons_students b ON b.lesson_id = l.id
WHERE NOT coalesce(trial, false) AND status IN (0, 1, 2, 3)
""")
def paid_lessons(spark, d):
    rows = Q.paid_lessons(V.sources(spark, d), CFG)
    level = F.when(F.col("grade_kind").isin(*vocab.SCHOOL_LEVELS), F.col("grade_kind")).otherwise(vocab.UNDEFINED)
    return rows.select("lesson_id", "student_id", "subject_id", level.alias("grade_kind"), "created_at")


_LINES = """
lines AS (
  SELECT id, client_id, moment, amount, testing, trim(unnest(
    CASE WHEN data LIKE '[%' THEN CAST(json_extract(data, '$[*].Description') AS VARCHAR[])
         WHEN data LIKE '{%' THEN [CAST(json_extract(data, '$.Description') AS VARCHAR)] END), '"') AS text
  FROM s_payments WHERE NOT coalesce(testing, false) AND amount > 1)"""
_PAY = f""",
{_LINES.strip()},
states AS (SELECT payment_id, bool_or(state = 'paid') AS paid, bool_or(state IN ('paid', 'cancelled')) AS accepted,
                  bool_or(data IS NOT NULL) AS has_package FROM s_orders GROUP BY 1),
before AS (
  SELECT client_id, subject_id, CAST(moment AS DATE) AS moment, amount
  FROM (SELECT *, CASE WHEN contains(text, 'англ') THEN 1 WHEN contains(text, 'матем') THEN 2 END AS subject_id
        FROM lines WHERE CAST(moment AS DATE) < DATE '{ERA}')
  QUALIFY row_number() OVER (PARTITION BY client_id, subject_id ORDER BY CAST(moment AS DATE), id, text) = 1),
paid AS (SELECT p.id, client_id, moment, amount, has_package FROM s_payments p JOIN states s ON s.payment_id = p.id
  WHERE s.paid AND p.id IN (SELECT id FROM lines WHERE NOT starts_with(text, 'Пробное занятие'))),
spans AS (
  SELECT n.id, n.client_id, n.amount, CAST(n.moment AS DATE) AS moment,
         lead(n.moment) OVER (PARTITION BY n.client_id ORDER BY n.moment, n.id) AS next_moment, f.first_day
  FROM paid n LEFT JOIN (SELECT client_id, CAST(min(moment) AS DATE) AS first_day FROM paid GROUP BY 1) f
    ON f.client_id = n.client_id
  WHERE has_package AND CAST(n.moment AS DATE) >= DATE '{ERA}'),
lessons1 AS (
  SELECT student_id, subject_id, grade_kind, min(time_start) AS time_start
  FROM s_lessons l JOIN s_lessons_students b ON b.lesson_id = l.id
  WHERE NOT coalesce(trial, false) AND status IN (0, 1, 2, 3) GROUP BY ALL),
after AS (
  SELECT DISTINCT s.client_id, s.id AS payment_id, s.amount, s.moment, l.subject_id,
         CASE l.subject_id || '/' || l.grade_kind {_BY_ID} ELSE 'undefined' END AS subject_name_rev
  FROM spans s LEFT JOIN lessons1 l ON l.student_id = s.client_id
    AND l.time_start BETWEEN s.moment AND s.moment + INTERVAL 1 MONTH + INTERVAL 30 DAY
    AND l.time_start BETWEEN s.moment AND coalesce(s.next_moment, TIMESTAMP '2999-12-31 00:00:00')
  WHERE s.first_day = s.moment OR l.student_id IS NOT NULL)
"""
PURCHASE_SQL = f"WITH {V.SOURCES_SQL}{_PAY}"


_ERAS_SQL = PURCHASE_SQL + """
SELECT 'before' AS era, client_id, subject_id, moment AS first_purchase, NULL AS payment_id, CAST(NULL AS DOUBLE) AS amount,
       NULL AS subject_name_rev FROM before
UNION ALL SELECT 'after', client_id, subject_id, moment, payment_id, amount, subject_name_rev FROM after
"""


@query("two_era_purchase", _ERAS_SQL)
def two_era_purchase(spark, d):
    return P.first_purchase_two_eras(V.sources(spark, d), CFG)


@query("two_era_purchase_state", _ERAS_SQL)
def two_era_purchase_state(spark, d):
    """Purchases of both eras, first payments and paid lessons taken from states that slices were merged into."""
    src, firsts = V.sources(spark, d), FunnelFirsts.at(spark, f"{Workspace(spark).root}/firsts", parts=16)
    for lo, hi in (("1970-01-01", "2024-01-12"), ("2024-01-10", "2999-01-01")):
        firsts.update(src, replace(CFG, lo=lo, hi=hi))
    return P.first_purchase_two_eras(src, CFG, firsts.payments.read(), firsts.lessons.read())


# Payloads that come in place of a payment's own, by id % 12.
ODD_LINES = {
    0: '[{"description":"x"}]',
    1: '[{"Descr',
    2: '[{"Description":"x"},{"Other":"y"}]',
    3: "7",
    4: '[{"Description":null}]',
}
_ODD = "CASE id % 12 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in ODD_LINES.items()) + " ELSE data END"


@query("rejected_payments", f"""WITH {V.SOURCES_SQL}, odd AS (SELECT id, client_id, moment, {_ODD} AS data FROM s_payments
  WHERE coalesce(NOT testing, true) AND amount > {CFG.min_amount}),
typed AS (SELECT *, CASE WHEN json_valid(data) THEN json_type(data) END AS t FROM odd),
sized AS (SELECT *, CASE WHEN t = 'ARRAY' THEN json_array_length(data) WHEN t = 'OBJECT' THEN 1 END AS n,
    CASE WHEN t = 'OBJECT' THEN '[' || data || ']' WHEN t = 'ARRAY' THEN data END AS list FROM typed),
why AS (SELECT id, client_id, moment, data, CASE WHEN data IS NULL THEN 'null' WHEN t IS NULL THEN 'broken'
  WHEN n IS NULL THEN 'not_a_list' WHEN n = 0 THEN 'empty'
  WHEN len(json_extract(list, '$[*].description')) > 0 THEN 'other_case'
  WHEN len(json_extract(list, '$[*].Description')) < n THEN 'missing_key' END AS reason FROM sized)
SELECT * FROM why WHERE reason IS NOT NULL""")
def rejected_payments(spark, d):
    """Payments whose lines are lost, some payloads replaced by broken ones, with the reason."""
    src = V.sources(spark, d)
    odd = src.payments.withColumn("data", F.expr(_ODD))
    return P.rejected_payments(replace(src, payments=odd), CFG)


@query("all_payments", PURCHASE_SQL + f"""
SELECT client_id, moment, CASE WHEN contains(text, 'англ') THEN 1 WHEN contains(text, 'математ') THEN 2 END AS subject_id,
       amount
FROM lines JOIN states ON payment_id = id
WHERE accepted AND NOT starts_with(text, 'Пробное занятие') AND (contains(text, 'математ') OR contains(text, 'английск'))
  AND CAST(moment AS DATE) < DATE '{ERA}'
""")
def all_payments(spark, d):
    return P.all_payments(V.sources(spark, d), CFG)


_UNCONVERTED = f""",
real AS (SELECT * FROM s_landing_leads WHERE lower(name) NOT IN {TEST_LEADS} OR name IS NULL),
paged AS (SELECT phone, subject, created_at, tag, {_PATH} AS path FROM real),
paged2 AS (SELECT *, CASE {_LABELS} WHEN suffix(path, '/') THEN path ELSE path || '/' END AS page FROM paged),
leads AS (
  SELECT phone, subject, created_at, page,
         CASE WHEN coalesce({_rules()}, false) OR coalesce(contains(tag, 'funnel'), false) THEN 1 ELSE 0 END AS op_landing
  FROM paged2
  QUALIFY row_number() OVER (PARTITION BY phone, subject, created_at ORDER BY page NULLS FIRST, op_landing) = 1),
day1 AS (SELECT phone, subject, CAST(created_at AS DATE) AS lead_day, op_landing FROM leads
  QUALIFY row_number() OVER (PARTITION BY phone, subject, CAST(created_at AS DATE) ORDER BY created_at) = 1),
monthly AS (
  SELECT phone, subject, grade_kind, created_at, {_PATH} AS path FROM real
  WHERE created_at BETWEEN TIMESTAMP '{LO}' AND TIMESTAMP '{HI}'
  QUALIFY row_number() OVER (PARTITION BY phone, subject, grade_kind, date_trunc('month', created_at)
                             ORDER BY created_at, page_url NULLS FIRST) = 1),
persons AS (
  SELECT p.phone, p.created_at AS parent_created_at, p.is_location_moscow, s.id AS student_id
  FROM s_parents p LEFT JOIN s_students s ON s.parent_id = p.id WHERE p.phone IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY p.phone ORDER BY p.id, s.id NULLS LAST) = 1),
ltags AS (SELECT DISTINCT phone, created_at, {', '.join(_LEAD_TAGS)} FROM s_traffic_source_lead),
numbered AS (SELECT *, CASE subject {_CODES} ELSE 0 END AS subject_id,
                    CASE subject || '/' || grade_kind {_BY_NAME} ELSE 'undefined' END AS subject_name FROM monthly),
unconverted AS (
  SELECT u.student_id, n.phone, u.is_location_moscow, n.subject_id, n.grade_kind, n.subject_name,
    n.created_at AS lal_created_at, y.op_landing, 'by_operator' AS lead_type,
    CASE WHEN f.created_at < n.created_at THEN 'by_operator: rescheduled_lead'
         WHEN a.created_at < n.created_at AND n.subject_name = 'undefined' THEN 'by_operator: rescheduled_lead'
         WHEN y.op_landing = 1 AND (f.created_at IS NULL OR f.created_at = n.created_at OR a.created_at IS NULL
              OR a.created_at = n.created_at) THEN 'by_operator: funnel_page_new_lead'
         WHEN y.op_landing = 0 AND (f.created_at IS NULL OR f.created_at = n.created_at OR a.created_at IS NULL
              OR a.created_at = n.created_at) THEN 'by_operator: not_funnel_page_new_lead' END AS lead_type_2,
    n.created_at AS lead_created, CASE WHEN suffix(n.path, '/') THEN n.path ELSE n.path || '/' END AS page_name,
    {', '.join('t.' + c for c in _LEAD_TAGS)},
    CASE WHEN date_trunc('hour', u.parent_created_at) = date_trunc('hour', n.created_at) THEN 'new' ELSE 'current' END
      AS new_current_user_flag
  FROM numbered n LEFT JOIN persons u ON u.phone = n.phone
  LEFT JOIN day1 y ON y.phone = n.phone AND coalesce(y.subject, '0') = coalesce(n.subject, '0')
    AND y.lead_day = CAST(n.created_at AS DATE)
  LEFT JOIN ltags t ON t.phone = n.phone AND t.created_at = n.created_at
  LEFT JOIN first_trial f ON f.student_id = u.student_id AND f.subject_id = n.subject_id AND f.created_at <= n.created_at
  LEFT JOIN first_any a ON a.student_id = u.student_id AND a.created_at <= n.created_at)
"""


_PLAIN_FLAG = "* REPLACE (CAST(is_location_moscow AS INTEGER) AS is_location_moscow)"


def _unconverted(src, trials):
    first_of_day = L.first_leads_of_day(L.flagged_leads(src, CFG))
    by_subject, by_student = (Q.first_trials(trials, CFG, s) for s in (True, False))
    return L.unconverted_leads(src, first_of_day, by_subject, by_student, CFG)


@query("unconverted_leads", TRIALS_SQL.rstrip() + _UNCONVERTED + f"SELECT {_PLAIN_FLAG} FROM unconverted")
def unconverted_leads(spark, d):
    return _unconverted(*_trials(spark, d))


@query("funnel_page_leads", TRIALS_SQL.rstrip() + _UNCONVERTED + "SELECT page, op_landing, count(*) AS n FROM leads GROUP BY ALL")
def funnel_page_leads(spark, d):
    """Leads per page label and funnel-page flag."""
    leads = L.labelled_leads(L.flagged_leads(V.sources(spark, d), CFG))
    return leads.groupBy("page", "op_landing").agg(F.count(F.lit(1)).alias("n"))


_ALL_NULL = "coalesce(" + ", ".join("g." + t for t in _LEAD_TAGS) + ") IS NULL"
_TYPED_NULLS = {c: "NULL" for c in STAGE_COLUMNS}
_LEAD_ONLY = [
    "student_id", "phone", "is_location_moscow", "subject_id", "grade_kind", "subject_name", "lal_created_at",
    "op_landing", "lead_type", "lead_type_2", "lead_created", "page_name", *_LEAD_TAGS, "new_current_user_flag",
]

_FULL = TRIALS_SQL.rstrip() + _PAY.rstrip() + _UNCONVERTED.rstrip() + f""",
slots AS (SELECT DISTINCT parent_phone AS phone, lesson_id, t.created_at,
                 CASE WHEN n.id IS NOT NULL THEN {V.SUBJECT_SQL.format('t.subject_id')} END AS subject_label
  FROM (SELECT * FROM trials WHERE {_OK_KIND}
        QUALIFY row_number() OVER (PARTITION BY subject_id, student_id, time_start ORDER BY {_SLOT}) = 1) t
  LEFT JOIN s_subjects n ON n.id = t.subject_id WHERE parent_phone IS NOT NULL),
lal AS (
  SELECT l.phone, r.lesson_id, l.created_at, coalesce(l.subject, r.subject_label) AS lead_subject, l.op_landing, l.page
  FROM leads l JOIN slots r ON r.phone = l.phone AND l.created_at < r.created_at
  QUALIFY row_number() OVER (PARTITION BY l.phone, l.subject, r.subject_label, l.created_at
                             ORDER BY r.created_at, r.lesson_id) = 1
    AND floor(epoch(r.created_at)) - floor(epoch(l.created_at)) < {CFG.max_gap_seconds}),
buys AS (SELECT DISTINCT client_id, subject_id, moment, payment_id, amount, subject_name_rev FROM after),
logged AS (SELECT DISTINCT g.student_id, l.subject_id, l.id AS lesson_id FROM s_lesson_creation_logs g
  JOIN s_lessons l ON l.id = g.lesson_id WHERE l.trial),
touches AS (SELECT s.id AS student_id, t.* FROM s_traffic_source t JOIN s_students s ON s.parent_id = t.parent_id),
joined AS (
  SELECT q.*, CAST(e.time_start AS DATE) AS trial_finished_at, b.moment AS p_before, c.moment AS p_after, c.payment_id,
    c.amount, c.subject_name_rev, g.lesson_id AS sl_lesson_id, m.created_at AS lal_created_at, m.lead_subject,
    m.op_landing, m.page AS page_name, f.created_at AS first_trial_lesson, a.created_at AS first_trial_any,
    {', '.join('h.' + t for t in _TAG_NAMES)}
  FROM reqs q
  LEFT JOIN (SELECT DISTINCT student_id, subject_id, grade_kind, time_start FROM fin) e
    ON e.student_id = q.student_id AND e.subject_id = q.subject_id AND e.grade_kind = q.grade_kind
    AND e.time_start = q.time_start
  LEFT JOIN before b ON b.client_id = q.student_id AND b.subject_id = q.subject_id
  LEFT JOIN buys c ON c.client_id = q.student_id AND coalesce(c.subject_id, q.subject_id) = q.subject_id
  LEFT JOIN logged g ON g.student_id = q.student_id AND g.subject_id = q.subject_id AND g.lesson_id = q.lesson_id
  LEFT JOIN lal m ON m.phone = q.parent_phone AND m.lesson_id = q.lesson_id AND m.created_at < q.created_at
    AND m.created_at + INTERVAL 14 DAY > q.created_at
  LEFT JOIN first_trial f ON f.student_id = q.student_id AND f.subject_id = q.subject_id
  LEFT JOIN first_any a ON a.student_id = q.student_id
  LEFT JOIN touches h ON h.student_id = q.student_id
    AND (q.created_at <= h.added_to_telemarketing_list_request + INTERVAL 54 DAY
         OR h.added_to_telemarketing_list_request IS NULL)
  WHERE lower(q.first_name) NOT IN {TEST_STUDENTS} AND q.subject_id IS NOT NULL),
timed AS (
  SELECT *, CASE WHEN sl_lesson_id IS NULL THEN created_at - INTERVAL 1 MINUTE
                 WHEN lal_created_at IS NULL THEN created_at ELSE lal_created_at END AS lead_created,
         CASE WHEN lead_subject IS NULL THEN first_trial_any ELSE first_trial_lesson END AS history
  FROM joined),
converted AS (
  SELECT DISTINCT student_id, t.phone, is_location_moscow, lesson_id, reason, subject_id, grade_kind,
    CASE subject_id || '/' || grade_kind {_BY_ID} ELSE 'undefined' END AS subject_name, time_start, sl_lesson_id,
    lal_created_at, first_trial_lesson, first_trial_any, op_landing,
    CASE WHEN sl_lesson_id IS NULL THEN 'by_user' ELSE 'by_operator' END AS lead_type,
    CASE WHEN sl_lesson_id IS NULL AND first_trial_any = t.created_at THEN 'by_user: new'
         WHEN sl_lesson_id IS NULL AND first_trial_any <> t.created_at THEN 'by_user: current'
         WHEN sl_lesson_id IS NULL THEN 'undefined'
         WHEN lal_created_at IS NULL THEN 'by_operator: other'
         WHEN history < lal_created_at THEN 'by_operator: rescheduled_lead'
         WHEN history >= lal_created_at AND op_landing = 1 THEN 'by_operator: funnel_page_new_lead'
         WHEN history >= lal_created_at AND op_landing = 0 THEN 'by_operator: not_funnel_page_new_lead'
         ELSE 'undefined' END AS lead_type_2,
    lead_created, CAST(t.created_at AS DATE) AS trial_created_at, trial_finished_at, subject_name_rev,
    coalesce(p_before, p_after) AS first_purchase, page_name,
    {', '.join(f't.{c} AS {c}_request' for c in _TAG_NAMES)},
    {', '.join(f'CASE WHEN {_ALL_NULL} THEN t.{c} ELSE g.{c}_lead END AS {c}_lead' for c in _TAG_NAMES)},
    CASE WHEN date_trunc('hour', parent_created_at) = date_trunc('hour', lal_created_at) THEN 'new' ELSE 'current' END
      AS new_current_user_flag, payment_id, round(amount, 0) AS amount
  FROM timed t LEFT JOIN ltags g ON g.phone = t.phone AND g.created_at = t.lead_created),
rows_all AS (
  SELECT {', '.join(STAGE_COLUMNS)}, 1 AS union_rn FROM converted
  UNION ALL
  SELECT {', '.join(c if c in _LEAD_ONLY else 'NULL' for c in STAGE_COLUMNS)}, 2 FROM unconverted)
"""

_TIES = ", ".join(f"{c} NULLS FIRST" for c in FLAG_COLUMNS.ties)


def _period(unit, ts):
    return f"CAST({ts} AS DATE)" if unit == "day" else f"CAST(date_trunc('{unit}', {ts}) AS DATE)"


def _number(unit, ts, product):
    keys = f"phone, {_period(unit, ts)}" + (", subject_name" if product else "")
    return (
        f"row_number() OVER (PARTITION BY {keys} "
        f"ORDER BY union_rn, {ts} NULLS FIRST, lesson_id NULLS FIRST, {_TIES})"
    )


_NAMES = {"day": "rn_daily", "week": "rn_weekly", "month": "rn_monthly"}
_FLAGS = ", ".join(
    f"CASE WHEN trial_created_at IS NOT NULL THEN {_number(u, 'trial_created_at', True)} "
    f"ELSE {_number(u, 'lead_created', False)} END AS {n}, {_number(u, 'lead_created', True)} AS {n}_lead"
    for u, n in _NAMES.items()
)


def _label_ctes():
    out, joins, columns = [], [], []
    for u, n in _NAMES.items():
        who = "coalesce(" + ", ".join(f"CAST({c} AS VARCHAR)" for c in LABEL_PERSON[u]) + ")"
        when = f"coalesce({_period(u, 'trial_created_at')}, {_period(u, 'lead_created')})"
        out.append(f"lab_{u} AS (SELECT DISTINCT {who} AS w, {when} AS p, coalesce(subject_name, '0') AS s, lead_type AS a, "
                   f"lead_type_2 AS b FROM fact WHERE {n} = 1)")
        here = "coalesce(" + ", ".join(f"CAST(f.{c} AS VARCHAR)" for c in LABEL_PERSON[u]) + ")"
        then = f"coalesce({_period(u, 'f.trial_created_at')}, {_period(u, 'f.lead_created')})"
        joins.append(f"LEFT JOIN lab_{u} ON lab_{u}.w = {here} AND lab_{u}.p = {then} "
                     f"AND (f.subject_name = 'undefined' OR lab_{u}.s = coalesce(f.subject_name, '0'))")
        columns += [f"coalesce(lab_{u}.a, f.lead_type) AS lead_type_{u}",
                    f"coalesce(lab_{u}.b, f.lead_type_2) AS lead_type_2_{u}"]
    return out, joins, columns


_CTES, _JOINS, _COLUMNS = _label_ctes()
FUNNEL_SQL = _FULL.rstrip() + f""",
flagged AS (SELECT *, {_FLAGS} FROM rows_all),
fact AS (SELECT * FROM flagged WHERE union_rn = 1 OR rn_daily = 1),
{', '.join(_CTES)},
funnel AS (SELECT DISTINCT f.*, {', '.join(_COLUMNS)} FROM fact f {' '.join(_JOINS)})
"""


def funnel(spark, d):
    return sales_funnel(V.sources(spark, d), CFG)


@query("funnel_full", FUNNEL_SQL + f"SELECT {_PLAIN_FLAG} FROM funnel")
def funnel_full(spark, d):
    """The whole fact table of 52 columns."""
    return funnel(spark, d)


# ten days out of the month: history, leads and payments outside still count where they should
SLICE = replace(CFG, lo="2024-01-12 00:00:00", hi="2024-01-21 00:00:00")


def _between(cfg):
    return f"BETWEEN TIMESTAMP '{cfg.lo}' AND TIMESTAMP '{cfg.hi}'"


@query("funnel_slice", FUNNEL_SQL.replace(_between(CFG), _between(SLICE)) + f"SELECT {_PLAIN_FLAG} FROM funnel")
def funnel_slice(spark, d):
    """The fact table of a short run slice, as a scheduled run makes it."""
    return sales_funnel(V.sources(spark, d), SLICE)


@query("funnel_rule_rows", FUNNEL_SQL.replace(_between(CFG), _between(SLICE)) + f"SELECT {_PLAIN_FLAG} FROM funnel")
def funnel_rule_rows(spark, d):
    """The fact table of the same slice with the launch rules as rows of a table."""
    return sales_funnel(V.sources(spark, d), SLICE, page_rules=launch_table(spark, SLICE.site))


_OF_REQUESTS = "count(*) FILTER (union_rn = 1 AND {})"
_METRICS = {
    "rows_all": {
        ("rows", "rows"): "count(*)",
        ("rows", "request_rows"): _OF_REQUESTS.format("true"),
        ("rows", "without_lead"): _OF_REQUESTS.format("lal_created_at IS NULL"),
        ("rows", "without_finish"): _OF_REQUESTS.format("trial_finished_at IS NULL"),
        ("rows", "without_purchase"): _OF_REQUESTS.format("first_purchase IS NULL"),
        ("rows", "without_first_trial"): _OF_REQUESTS.format("first_trial_any IS NULL"),
        ("rows", "without_lead_time"): "count(*) FILTER (lead_created IS NULL)",
        ("rows", "finished_without_request"): "count(*) FILTER (trial_finished_at IS NOT NULL AND trial_created_at IS NULL)",
        ("rows", "lead_after_request"): _OF_REQUESTS.format("CAST(lal_created_at AS DATE) > trial_created_at"),
        ("requests", "made_up"): "count(DISTINCT lesson_id) FILTER (lesson_id NOT IN (SELECT lesson_id FROM joined))",
        ("requests", "largest_fan_out"): "any_value((SELECT max(n) FROM (SELECT count(*) AS n FROM converted GROUP BY lesson_id)))",
    },
    "joined": {
        ("requests", "expected"): "count(DISTINCT lesson_id)",
        ("requests", "lost"): "count(DISTINCT lesson_id) FILTER (lesson_id NOT IN (SELECT lesson_id FROM converted))",
    },
    "fact": {
        ("flagged", "rows"): "count(*)",
        ("flagged", "request_rows"): _OF_REQUESTS.format("true"),
        ("flagged", "not_numbered"): f"count(*) FILTER ({' OR '.join(f'{n}{b} IS NULL' for n in _NAMES.values() for b in ('', '_lead'))})",
        ("flagged", "later_leads_of_a_day"): "count(*) FILTER (union_rn <> 1 AND rn_daily <> 1)",
        **{("flagged", f"counted_{n[3:]}{b}"): f"count(*) FILTER ({n}{b} = 1)" for n in _NAMES.values() for b in ("", "_lead")},
    },
}


@query("funnel_figures", FUNNEL_SQL + " UNION ALL ".join(
    f"SELECT '{stage}' AS stage, '{metric}' AS metric, {value} AS value FROM {source}"
    for source, metrics in _METRICS.items() for (stage, metric), value in metrics.items()
))
def funnel_figures(spark, d):
    """The figures a run is watched by; the run stops where one breaks its bounds."""
    watch = Watch()
    sales_funnel(V.sources(spark, d), CFG, watch=watch)
    return watch.table(spark)


@query("funnel_full_report", FUNNEL_SQL + f"""
SELECT {_period('week', 'lead_created')} AS period, coalesce(CASE WHEN external_source_type_lead IN {vocab.TRAFFIC_TYPES}
         THEN external_source_type_lead END, 'undefined') AS traffic_type, lead_type_week AS enrolment_type,
       lead_type_2_week AS lead_type,
       count(lead_created) AS leads, count(trial_created_at) AS requests,
       count(CASE WHEN trial_created_at IS NOT NULL THEN trial_finished_at END) AS finished,
       count(CASE WHEN trial_created_at IS NOT NULL THEN first_purchase END) AS purchases
FROM funnel WHERE rn_weekly_lead = 1 GROUP BY ALL
""")
def funnel_full_report(spark, d):
    """The fact table by week, traffic type and period lead type."""
    return R.funnel_counts(funnel(spark, d), "week", "lead", [R.traffic_type("lead"), *R.lead_type_of("week")])


# leads of one phone and day at one instant: what tells them apart decides which is numbered first
TIES_SQL = FUNNEL_SQL.replace(
    "real AS (SELECT * FROM s_landing_leads", "real AS (SELECT * REPLACE (date_trunc('day', created_at) AS created_at) FROM s_landing_leads"
)


def tied(spark, d):
    src = V.sources(spark, d)
    return replace(src, landing_leads=src.landing_leads.withColumn("created_at", F.date_trunc("day", "created_at")))


@query("funnel_ties", TIES_SQL + f"SELECT {_PLAIN_FLAG} FROM funnel")
def funnel_ties(spark, d):
    """The fact table where many leads share an instant."""
    return sales_funnel(tied(spark, d), CFG)


@query("fact_sink", FUNNEL_SQL + f"SELECT {_PLAIN_FLAG}, CAST(date_trunc('month', lead_created) AS DATE) AS lead_month FROM funnel")
def fact_sink(spark, d):
    """The fact table written ordered, in a folder per lead month, and read back."""
    space = Workspace(spark)
    write_fact(funnel(spark, d), f"{space.root}/fact")
    return spark.read.parquet(f"{space.root}/fact").withColumn("lead_month", F.to_date("lead_month"))


_LEAD_MONTH = "CAST(date_trunc('month', lead_created) AS DATE) AS lead_month"
# two slices that share days, the first one again after the second
SLICES = [("2024-01-01 00:00:00", "2024-01-14 12:00:00"), ("2024-01-12 00:00:00", "2024-01-31 00:00:00")]


def stored(spark, src, slices, cfg=CFG) -> FactStore:
    """A store that was brought up to date slice by slice."""
    store = FactStore(spark, f"{Workspace(spark).root}/store")
    for lo, hi in slices:
        refresh_slice(store, src, replace(cfg, lo=lo, hi=hi))
    return store


@query("fact_refresh", FUNNEL_SQL + f"SELECT {_PLAIN_FLAG}, {_LEAD_MONTH} FROM funnel")
def fact_refresh(spark, d):
    """The stored fact after one slice, the next and the first again: as one run over both."""
    src = V.sources(spark, d, V.events_by_type(spark, d))
    store = stored(spark, src, [*SLICES, SLICES[0]])
    return store.read().withColumn("lead_month", F.to_date("lead_month"))


_ORDER = "date_trunc('month', lead_created), lead_created, lesson_id NULLS FIRST, phone NULLS FIRST"


@query("fact_order", FUNNEL_SQL + f"""
SELECT CAST(row_number() OVER (ORDER BY {_ORDER}) AS BIGINT) AS place, lead_created, lesson_id, phone FROM funnel
""")
def fact_order(spark, d):
    """Places of the rows of the written files, file by file and row by row."""
    space = Workspace(spark)
    write_fact(funnel(spark, d), f"{space.root}/fact")
    rows = spark.read.parquet(f"{space.root}/fact").select("*", "_metadata.file_name", "_metadata.row_index")
    # files of a month are numbered in the order of their times
    sizes = rows.groupBy("lead_month", "file_name").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("lead_month", "file_name").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("lead_month", "file_name", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = (F.col("start") + F.col("row_index") + 1).alias("place")
    return rows.join(starts, ["lead_month", "file_name"]).select(place, "lead_created", "lesson_id", "phone")


def _fact_report(basis, unit, keys, tail="SELECT * FROM counts"):
    flag = _NAMES[unit] + ("_lead" if basis == "lead" else "")
    when = _period(unit, "lead_created")
    if basis == "request":
        when = f"coalesce({_period(unit, 'trial_created_at')}, {when})"
    by = "".join(f", {e} AS {c}" for c, e in keys)
    return FUNNEL_SQL + f"""
, counts AS (SELECT {when} AS period{by}, count(lead_created) AS leads, count(trial_created_at) AS requests,
       count(CASE WHEN trial_created_at IS NOT NULL THEN trial_finished_at END) AS finished,
       count(CASE WHEN trial_created_at IS NOT NULL THEN first_purchase END) AS purchases,
       count(CASE WHEN coalesce(CAST(time_start AS DATE) <= DATE '2024-01-17', true) THEN trial_created_at END) AS due
FROM funnel WHERE {flag} = 1 GROUP BY ALL)
{tail}"""


_KNOWN = f"coalesce(CASE WHEN external_source_type_request IN {vocab.TRAFFIC_TYPES} THEN external_source_type_request END, 'undefined')"
_SCHOOLS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.SCHOOL_TYPES.items())
_ALL_COUNTS = "leads, requests, finished, purchases FROM counts"


@query("fact_request_basis", _fact_report("request", "week", (), f"SELECT period, {_ALL_COUNTS}"))
def fact_request_basis(spark, d):
    """The fact table by week of the request."""
    return R.funnel_counts(funnel(spark, d), "week", "request")


@query("fact_request_source", _fact_report("request", "month", [("traffic_type", _KNOWN)], f"SELECT period, traffic_type, {_ALL_COUNTS}"))
def fact_request_source(spark, d):
    """The fact table by month and traffic type of the request."""
    return R.funnel_counts(funnel(spark, d), "month", "request", [R.traffic_type("request")])


@query("fact_school_type", _fact_report(
    "lead", "month", [("school_type", f"CASE grade_kind {_SCHOOLS} ELSE 'undefined' END")], f"SELECT period, school_type, {_ALL_COUNTS}"))
def fact_school_type(spark, d):
    """The fact table by month of the lead and school type."""
    return R.funnel_counts(funnel(spark, d), "month", "lead", [R.school_type()])


@query("fact_conversion_as_of", _fact_report(
    "request", "week", (), "SELECT period, requests, finished, CAST(finished AS DOUBLE) / nullif(CAST(due AS DOUBLE), 0) AS request_to_finished FROM counts"))
def fact_conversion_as_of(spark, d):
    """Finished rate of the fact table over the requests due by a day."""
    return R.conversion_as_of(funnel(spark, d), "2024-01-17", "week", "request")


def report_cuts():
    """All reports: plain, by school type, and by source of the lead and of the request."""
    cuts = {"all": {}, "school_type": {"school_type": R.school_type()}}
    for source in ("lead", "request"):
        cuts[f"traffic_{source}"] = {f"traffic_{source}": R.traffic_type(source)}
        cuts[f"channel_{source}"] = {f"channel_{source}": R.channel(source)}
        cuts[f"utm_{source}"] = {f"utm_{source}": R.utm_tag("utm_source", source)}
    return cuts


def _cuts_sql():
    at = {(b, u): (_NAMES[u] + ("_lead" if b == "lead" else ""), _period(u, "lead_created")) for b in ("lead", "request") for u in _NAMES}
    when = {k: p if k[0] == "lead" else f"coalesce({_period(k[1], 'trial_created_at')}, {p})" for k, (_, p) in at.items()}

    def case(values):
        return "CASE " + " ".join(f"WHEN basis = '{b}' AND grain = '{u}' THEN {v}" for (b, u), v in values.items()) + " END"

    by = {"school_type": f"CASE grade_kind {_SCHOOLS} ELSE 'undefined' END"}
    for s in ("lead", "request"):
        by[f"traffic_{s}"] = _KNOWN.replace("external_source_type_request", f"external_source_type_{s}")
        by[f"channel_{s}"] = f"coalesce(traffic_source_{s}, 'undefined')"
        by[f"utm_{s}"] = f"coalesce(utm_source_{s}, 'undefined')"
    for n, c in (("enrolment_type", "lead_type"), ("lead_type", "lead_type_2")):
        by[n] = "CASE grain " + " ".join(f"WHEN '{u}' THEN {c}_{u}" for u in _NAMES) + " END"
    sets = {"all": [], **{n: [n] for n in by if n not in R.LABELS}, "lead_type": list(R.LABELS)}
    spread = ", ".join(f"({b!r}, {u!r})" for b, u in at)
    unions = " UNION ALL ".join(
        f"SELECT basis, grain, period, '{name}' AS cut, {', '.join(n if n in s else f'NULL AS {n}' for n in by)}, "
        "count(lead_created) AS leads, count(trial_created_at) AS requests, "
        "count(CASE WHEN trial_created_at IS NOT NULL THEN trial_finished_at END) AS finished, "
        "count(CASE WHEN trial_created_at IS NOT NULL THEN first_purchase END) AS purchases "
        f"FROM spread GROUP BY {', '.join(['basis', 'grain', 'period', *s])}" for name, s in sets.items())
    return FUNNEL_SQL + f"""
, spread AS MATERIALIZED (SELECT basis, grain, {case(when)} AS period, lead_created, trial_created_at, trial_finished_at, first_purchase,
    {', '.join(f'{e} AS _{n}' for n, e in by.items())}
  FROM funnel, (VALUES {spread}) v(basis, grain) WHERE {case({k: f for k, (f, _) in at.items()})} = 1)
""" + unions.replace("FROM spread", f"FROM (SELECT * RENAME ({', '.join(f'_{n} AS {n}' for n in by)}) FROM spread)")


@query("fact_all_cuts", _cuts_sql())
def fact_all_cuts(spark, d):
    """All reports of the fact table by every basis and grain, from one scan of it."""
    return R.all_cuts(funnel(spark, d), report_cuts(), labels=True)
