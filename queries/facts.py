"""Stacked stages over the event views: flags, labels and reports."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from queries import views as V
from queries.matching import LED_SQL, led_requests
from queries.registry import query
from stagewise.functions import columns as C
from stagewise.functions import vocab
from stagewise.operators import match as M
from stagewise.operators import periods as P
from stagewise.operators import renumber as N
from stagewise.operators import stages as S
from stagewise.operators.skew import find_hot
from stagewise.plans import report as R
from stagewise.session import Workspace

SENTINEL = "2018-01-01"
COLS = P.FlagColumns(ties=("lead_row",))

# School level of each customer segment.
LEVELS = {"AUTOMOBILE": "grade_1_4", "BUILDING": "middle_school", "FURNITURE": "high_school", "MACHINERY": "other"}
_LEVEL_SQL = "CASE segment " + " ".join(f"WHEN '{s}' THEN '{g}'" for s, g in LEVELS.items()) + " END"
_TYPE_SQL = "CASE {0} " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(vocab.TRAFFIC_TYPES)) + " END"
# the same expressions hold in both engines
TAGS = {
    "external_source_type_lead": _TYPE_SQL.format("lead_k % 7"),
    "traffic_source_lead": "CASE WHEN lead_k % 4 > 0 THEN 'channel' || (lead_k % 4) END",
    "utm_source_lead": "CASE WHEN lead_k % 5 > 0 THEN 's' || (lead_k % 5) END",
}
REQUEST_TAGS = {
    "external_source_type_request": _TYPE_SQL.format("nation % 7"),
    "traffic_source_request": "CASE WHEN nation % 4 > 0 THEN 'channel' || (nation % 4) END",
    "utm_source_request": "CASE WHEN nation % 5 > 0 THEN 's' || (nation % 5) END",
}


def _select(tags):
    return ", ".join(f"{e} AS {c}" for c, e in tags.items())


FACT_SQL = LED_SQL.rstrip() + f"""
, finish AS (SELECT request_id AS f_request, min(done_at) AS done_at FROM request_v r
  JOIN done_v d ON d.person = r.person AND d.code = r.code AND done_at > request_at GROUP BY 1),
buy AS (SELECT request_id AS b_request, min(purchase_at) AS purchase_at FROM request_v r
  JOIN purchase_v d ON d.person = r.person AND d.code = r.code AND purchase_at > request_at GROUP BY 1),
requested AS (
  SELECT contact AS phone, t.person AS student_id, {V.SUBJECT_SQL.format('code')} AS subject_name,
    {_LEVEL_SQL} AS grade_kind, request_id AS lesson_id, CAST(request_at AS DATE) AS trial_created_at,
    request_at + INTERVAL 1 HOUR * (24 * (request_k % 10)) AS time_start,
    CAST(done_at AS DATE) AS trial_finished_at, CAST(purchase_at AS DATE) AS first_purchase,
    lead_created, lead_type, lead_type_2, coalesce(lead_id, -request_id) AS lead_row, request_k AS lead_k, nation
  FROM typed t JOIN person_v p ON p.person = t.person
  LEFT JOIN finish ON f_request = request_id LEFT JOIN buy ON b_request = request_id),
unrequested AS (
  SELECT contact AS phone, l.person AS student_id, {V.SUBJECT_SQL.format('lead_code')} AS subject_name,
    {_LEVEL_SQL} AS grade_kind, CAST(NULL AS BIGINT) AS lesson_id, CAST(NULL AS DATE) AS trial_created_at,
    CAST(NULL AS TIMESTAMP) AS time_start, CAST(NULL AS DATE) AS trial_finished_at, CAST(NULL AS DATE) AS first_purchase,
    lead_at AS lead_created, 'by_operator' AS lead_type,
    CASE lead_k % 2 WHEN 1 THEN 'by_operator: funnel_page_new_lead' ELSE 'by_operator: not_funnel_page_new_lead' END
      AS lead_type_2, lead_id AS lead_row, lead_k, nation
  FROM lead_v l JOIN person_v p ON p.person = l.person),
stacked AS (
  SELECT * EXCLUDE (lead_k, nation), 1 AS union_rn, {_select(TAGS)}, {_select(REQUEST_TAGS)} FROM requested
  UNION ALL
  SELECT * EXCLUDE (lead_k, nation), 2, {_select(TAGS)}, {', '.join('NULL' for _ in REQUEST_TAGS)} FROM unrequested)
"""


def stacked(spark, d):
    """Requests with all stages over leads, tagged 1 and 2."""
    hot = V.hot_persons(spark, d)
    led = led_requests(spark, d, hot)
    bought = V.purchase(spark, d).drop("amount")
    later = [M.Other(V.done(spark, d), "done_at", "done_id", "f"), M.Other(bought, "purchase_at", "purchase_id", "b")]
    staged = M.asof(led, later, ["person", "code"], "request_at", "next", hot)
    people = V.person(spark, d)
    level = C.constant_map(LEVELS)[F.col("segment")].alias("grade_kind")
    requests = staged.join(people, "person").select(
        F.col("contact").alias("phone"),
        F.col("person").alias("student_id"),
        C.code_label(F.col("code"), vocab.SUBJECTS, vocab.UNDEFINED).alias("subject_name"),
        level,
        F.col("request_id").alias("lesson_id"),
        F.to_date("request_at").alias("trial_created_at"),
        F.expr("request_at + INTERVAL '1' HOUR * (24 * (request_k % 10))").alias("time_start"),
        F.to_date("f.done_at").alias("trial_finished_at"),
        F.to_date("b.purchase_at").alias("first_purchase"),
        "lead_created",
        "lead_type",
        "lead_type_2",
        F.coalesce("lead_id", -F.col("request_id")).alias("lead_row"),
        *[F.expr(e.replace("lead_k", "request_k")).alias(c) for c, e in TAGS.items()],
        *[F.expr(e).alias(c) for c, e in REQUEST_TAGS.items()],
    )
    leads = V.lead(spark, d).join(people, "person").select(
        F.col("contact").alias("phone"),
        F.col("person").alias("student_id"),
        C.code_label(F.col("lead_code"), vocab.SUBJECTS, vocab.UNDEFINED).alias("subject_name"),
        level,
        F.col("lead_at").alias("lead_created"),
        F.lit(vocab.BY_OPERATOR).alias("lead_type"),
        F.when(F.col("lead_k") % 2 == 1, vocab.LEAD_TYPES[2]).otherwise(vocab.LEAD_TYPES[3]).alias("lead_type_2"),
        F.col("lead_id").alias("lead_row"),
        *[F.expr(e).alias(c) for c, e in TAGS.items()],
    )
    return S.union_stages(requests, leads)


_ROWS = "lesson_id, lead_row, union_rn"


@query("union_tagged", FACT_SQL + f"""
SELECT {_ROWS}, phone, student_id, subject_name, lead_created, trial_created_at, trial_finished_at, first_purchase
FROM stacked
""")
def union_tagged(spark, d):
    return stacked(spark, d).select(
        "lesson_id", "lead_row", "union_rn", "phone", "student_id", "subject_name", "lead_created",
        "trial_created_at", "trial_finished_at", "first_purchase",
    )


@query("suppress_covered", FACT_SQL + f"""
SELECT {_ROWS}, phone, lead_created FROM (SELECT *, row_number() OVER (
  PARTITION BY phone, CAST(lead_created AS DATE) ORDER BY union_rn, lead_created, lead_row) AS rn FROM stacked)
WHERE union_rn = 1 OR rn = 1
""")
def suppress_covered(spark, d):
    kept = P.suppress_covered(stacked(spark, d), "phone", "lead_created", "union_rn", ["lead_row"])
    return kept.select("lesson_id", "lead_row", "union_rn", "phone", "lead_created")


def _window(unit, basis, product=True):
    ts = "trial_created_at" if basis == "request" else "lead_created"
    p = f"CAST({ts} AS DATE)" if unit == "day" else f"date_trunc('{unit}', {ts})"
    return (
        f"row_number() OVER (PARTITION BY phone, {p}{', subject_name' if product else ''} "
        f"ORDER BY union_rn, {ts} NULLS FIRST, lesson_id NULLS FIRST, lead_row)"
    )


def _flags(unit):
    name = P.FLAG[unit]
    return (
        f"CASE WHEN trial_created_at IS NOT NULL THEN {_window(unit, 'request')} "
        f"ELSE {_window(unit, 'lead', False)} END AS {name}, {_window(unit, 'lead')} AS {name}_lead"
    )


FLAGGED_SQL = FACT_SQL.rstrip() + f"""
, flagged AS (SELECT *, {', '.join(_flags(u) for u in P.GRAINS)} FROM stacked),
fact AS (SELECT * FROM flagged WHERE union_rn = 1 OR rn_daily = 1)
"""


def _hot_contacts(spark, d):
    events = V.table(spark, d, "events").select(F.col("user_id").alias("person"))
    return find_hot(events.join(V.person(spark, d), "person").select(F.col("contact").alias("phone")), ["phone"])


def flagged(spark, d, grains=P.GRAINS):
    return P.period_flags(stacked(spark, d), COLS, grains, SENTINEL, hot=_hot_contacts(spark, d))


def fact(spark, d, grains=P.GRAINS):
    rows = flagged(spark, d, grains)
    return rows.where((F.col("union_rn") == 1) | (F.col("rn_daily") == 1))


def _flag_query(spark, d, unit):
    names = [P.FLAG[unit], P.FLAG[unit] + "_lead"]
    return flagged(spark, d, [unit]).select("lesson_id", "lead_row", "union_rn", *names)


for _unit in P.GRAINS:
    query(f"flags_{_unit}", FLAGGED_SQL + f"SELECT {_ROWS}, {P.FLAG[_unit]}, {P.FLAG[_unit]}_lead FROM flagged")(
        partial(_flag_query, unit=_unit)
    )

_EXACT = _window("day", "lead").replace("CAST(lead_created AS DATE)", "lead_created")


@query("flags_exact_day", FACT_SQL + f"SELECT {_ROWS}, {_flags('day').replace(_window('day', 'lead'), _EXACT)} FROM stacked")
def flags_exact_day(spark, d):
    """Daily flags where leads are numbered by their exact time."""
    rows = P.period_flags(stacked(spark, d), COLS, ["day"], SENTINEL, exact_daily_lead=True, hot=_hot_contacts(spark, d))
    return rows.select("lesson_id", "lead_row", "union_rn", "rn_daily", "rn_daily_lead")


_IDS = ["lesson_id", "lead_row", "union_rn"]


def late_changes(spark, d):
    """Rows with flags as of a day before, the rows that came late, and those that went since.

    Every 40th lead comes late; every 50th row was there twice, with another number.
    """
    space = Workspace(spark)
    rows = space.stage(stacked(spark, d), "rows")
    late = (F.col("union_rn") == 2) & (F.col("lead_row") % 40 == 7)
    gone = rows.where(F.col("lead_row") % 50 == 3).withColumn("lead_row", -F.col("lead_row") - 10**9)
    before = P.period_flags(rows.where(~late).unionByName(gone), COLS, P.GRAINS, SENTINEL, hot=_hot_contacts(spark, d))
    return space, space.stage(before, "before"), rows.where(late), gone


@query("flags_refresh", FLAGGED_SQL + f"SELECT {_ROWS}, {', '.join(f'{f}, {f}_lead' for f in P.FLAG.values())} FROM flagged")
def flags_refresh(spark, d):
    """Flags after late leads came and doubled rows went, numbered again only where they lie."""
    space, before, late, gone = late_changes(spark, d)
    rows = N.update_flags(before, late, gone, _IDS, space, COLS, sentinel=SENTINEL, hot=_hot_contacts(spark, d))
    return rows.select(*_IDS, *[f + b for f in P.FLAG.values() for b in ("", "_lead")])


_PERSON = {
    "month": ("phone", "student_id"),
    "week": ("student_id", "phone"),
    "day": ("student_id", "phone"),
}


def _trunc(unit, ts):
    return f"CAST({ts} AS DATE)" if unit == "day" else f"CAST(date_trunc('{unit}', {ts}) AS DATE)"


def _labels_sql(unit):
    person = "coalesce(" + ", ".join(f"CAST({p} AS VARCHAR)" for p in _PERSON[unit]) + ")"
    return FLAGGED_SQL + f"""
, keyed AS (SELECT *, {person} AS p, coalesce({_trunc(unit, 'trial_created_at')}, {_trunc(unit, 'lead_created')}) AS pd
  FROM fact),
lab AS (SELECT DISTINCT p, pd, subject_name, lead_type, lead_type_2 FROM keyed WHERE {P.FLAG[unit]} = 1)
SELECT DISTINCT k.lesson_id, k.lead_row, k.union_rn, coalesce(l.lead_type, k.lead_type) AS lead_type_{unit},
       coalesce(l.lead_type_2, k.lead_type_2) AS lead_type_2_{unit}
FROM keyed k LEFT JOIN lab l ON l.p = k.p AND l.pd = k.pd
  AND (k.subject_name = 'undefined' OR l.subject_name = k.subject_name)
"""


def _label_query(spark, d, unit):
    grains = list(dict.fromkeys(["day", unit]))
    # the table is read twice, for its rows and for the labels of the counted ones
    rows = Workspace(spark).stage(fact(spark, d, grains), "fact")
    labelled = P.period_labels(rows, unit, _PERSON[unit], cols=COLS, sentinel=SENTINEL)
    return labelled.select(
        "lesson_id", "lead_row", "union_rn", f"lead_type_{unit}", f"lead_type_2_{unit}"
    ).distinct()


for _unit in P.GRAINS:
    query(f"labels_{_unit}", _labels_sql(_unit))(partial(_label_query, unit=_unit))


def _kept(rows):
    return rows.where((F.col("union_rn") == 1) | (F.col("rn_daily") == 1))


def _labelled(rows, space):
    out = fact = space.stage(rows, "fact")
    for unit in P.GRAINS:
        out = P.period_labels(out, unit, _PERSON[unit], cols=COLS, sentinel=SENTINEL, fact=fact)
    return out.distinct()


_ALL_LABELS = [f"{c}_{u}" for u in P.GRAINS for c in ("lead_type", "lead_type_2")]
_KEYS_SQL = ", ".join(
    f"coalesce({', '.join(f'CAST({p} AS VARCHAR)' for p in _PERSON[u])}) AS p_{u}, "
    f"coalesce({_trunc(u, 'trial_created_at')}, {_trunc(u, 'lead_created')}) AS d_{u}" for u in P.GRAINS)


@query("labels_refresh", FLAGGED_SQL + f"""
, keyed AS (SELECT *, {_KEYS_SQL} FROM fact),
{', '.join(f"lab_{u} AS (SELECT DISTINCT p_{u} AS p, d_{u} AS d, subject_name AS s, lead_type AS a, lead_type_2 AS b FROM keyed "
           f"WHERE {P.FLAG[u]} = 1)" for u in P.GRAINS)}
SELECT DISTINCT k.lesson_id, k.lead_row, k.union_rn, {', '.join(
    f"coalesce({u}_.a, k.lead_type) AS lead_type_{u}, coalesce({u}_.b, k.lead_type_2) AS lead_type_2_{u}" for u in P.GRAINS)}
FROM keyed k {' '.join(f"LEFT JOIN lab_{u} {u}_ ON {u}_.p = k.p_{u} AND {u}_.d = k.d_{u} "
                       f"AND (k.subject_name = 'undefined' OR {u}_.s = k.subject_name)" for u in P.GRAINS)}
""")
def labels_refresh(spark, d):
    """Labels after late leads came and doubled rows went, made again only where they lie."""
    space, before, late, gone = late_changes(spark, d)
    labelled = space.stage(_labelled(_kept(before), space), "labelled")
    after = N.update_flags(before, late, gone, _IDS, space, COLS, sentinel=SENTINEL, hot=_hot_contacts(spark, d))
    after, old = space.stage(_kept(after), "after"), _kept(before)
    changed = space.stage(N.unequal(old, after), "changed")
    rows = N.update_labels(labelled, after, changed, _PERSON, space, cols=COLS, sentinel=SENTINEL)
    return rows.select(*_IDS, *_ALL_LABELS).distinct()


# --- reports ------------------------------------------------------------------


def _report_sql(basis, unit, by=(), extra="", where="TRUE", tail=""):
    flag = P.FLAG[unit] + ("_lead" if basis == "lead" else "")
    p = _trunc(unit, "lead_created")
    if basis == "request":
        p = f"coalesce({_trunc(unit, 'trial_created_at')}, {p})"
    keys = "".join(f", {e} AS {n}" for n, e in by)
    return FLAGGED_SQL + f"""
, counts AS (
  SELECT {p} AS period{keys}, count(*) AS leads, count(trial_created_at) AS requests,
         count(CASE WHEN trial_created_at IS NOT NULL THEN trial_finished_at END) AS finished,
         count(CASE WHEN trial_created_at IS NOT NULL THEN first_purchase END) AS purchases{extra}
  FROM fact WHERE {flag} = 1 AND {where} GROUP BY ALL)
{tail or 'SELECT * FROM counts'}
"""


def _counts(spark, d, basis, unit, by=(), rows=None):
    grains = list(dict.fromkeys(["day", unit]))
    rows = fact(spark, d, grains) if rows is None else rows
    return R.funnel_counts(rows, unit, basis, by, sentinel=SENTINEL)


for _basis, _unit in (("lead", "month"), ("request", "month"), ("lead", "week"), ("request", "week"),
                      ("lead", "day"), ("request", "day")):
    _name = f"funnel_{_basis}_basis" + ("" if _unit == "month" else f"_{_unit}")
    query(_name, _report_sql(_basis, _unit))(partial(_counts, basis=_basis, unit=_unit))

_SCHOOL = ("CASE grade_kind WHEN 'grade_1_4' THEN 'primary' WHEN 'middle_school' THEN 'middle' "
           "WHEN 'high_school' THEN 'high' ELSE 'undefined' END")
_TRAFFIC = "coalesce(external_source_type_{0}, 'undefined')"
_CHANNEL = "coalesce(traffic_source_{0}, 'undefined')"
_UTM = "coalesce(utm_source_{0}, 'undefined')"


@query("by_segment", _report_sql("lead", "month", [("school_type", _SCHOOL)]))
def by_segment(spark, d):
    """Funnel by school type."""
    return _counts(spark, d, "lead", "month", [R.school_type()])


def _by_traffic(spark, d, source):
    return _counts(spark, d, "lead", "week", [R.traffic_type(source)])


def _by_channel(spark, d, source):
    return _counts(spark, d, "lead", "month", [R.channel(source)])


def _by_utm(spark, d, source):
    return _counts(spark, d, "lead", "month", [R.utm_tag("utm_source", source)])


for _source in ("lead", "request"):
    query(f"by_source_toggle_{_source}", _report_sql("lead", "week", [("traffic_type", _TRAFFIC.format(_source))]))(
        partial(_by_traffic, source=_source))
    query(f"by_channel_{_source}", _report_sql("lead", "month", [("channel", _CHANNEL.format(_source))]))(
        partial(_by_channel, source=_source))
    query(f"by_utm_{_source}", _report_sql("lead", "month", [("utm_source", _UTM.format(_source))]))(
        partial(_by_utm, source=_source))


@query("by_lead_type", _report_sql(
    "request", "week", [("enrolment_type", "lead_type"), ("lead_type", "lead_type_2")]))
def by_lead_type(spark, d):
    """Funnel by enrolment type and lead type of the row."""
    by = [F.col("lead_type").alias("enrolment_type"), F.col("lead_type_2").alias("lead_type")]
    return _counts(spark, d, "request", "week", by)


@query("filtered", _report_sql(
    "request", "week", where="lead_type = 'by_operator' AND lead_type_2 IN "
    "('by_operator: rescheduled_lead', 'by_operator: other')"))
def filtered(spark, d):
    """Counts of chosen enrolment and lead types."""
    chosen = R.filtered(fact(spark, d, ["day", "week"]), ["by_operator"],
                        ["by_operator: rescheduled_lead", "by_operator: other"])
    return _counts(spark, d, "request", "week", rows=chosen)


_DIV = "CAST({0} AS DOUBLE) / nullif(CAST({1} AS DOUBLE), 0)"


@query("conversion", _report_sql("request", "week", tail=f"""
SELECT *, {_DIV.format('requests', 'leads')} AS lead_to_request, {_DIV.format('finished', 'requests')} AS request_to_finished,
       {_DIV.format('purchases', 'finished')} AS finished_to_purchase, {_DIV.format('purchases', 'leads')} AS lead_to_purchase
FROM counts
"""))
def conversion(spark, d):
    return R.conversion(_counts(spark, d, "request", "week"))


@query("conversion_as_of", _report_sql(
    "request", "week", extra=", count(CASE WHEN CAST(time_start AS DATE) <= DATE '2024-01-17' THEN trial_created_at END) AS due",
    tail=f"SELECT period, requests, finished, {_DIV.format('finished', 'due')} AS request_to_finished FROM counts"))
def conversion_as_of(spark, d):
    """Finished rate over the requests due by a day."""
    return R.conversion_as_of(fact(spark, d, ["day", "week"]), "2024-01-17", "week", "request", sentinel=SENTINEL)
