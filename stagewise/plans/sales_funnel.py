"""The wide funnel table: lead, request, finished trial, first purchase."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.config import FunnelConfig
from stagewise.functions import columns as C
from stagewise.functions import vocab
from stagewise.operators.lead_type import request_lead_type
from stagewise.operators.match import attribute_within
from stagewise.operators.periods import GRAINS, FlagColumns, period_flags, spread_label_sets, with_label_sets
from stagewise.operators.skew import HotGroups, merged_hot, named_keys, stage_watched
from stagewise.operators.stages import (
    Stage,
    attach_stages,
    created_by_staff,
    exclude_test_records,
    lead_time,
    union_stages,
    with_group_fallback,
)
from stagewise.plans import leads as L
from stagewise.plans import purchases as P
from stagewise.plans import requests as R
from stagewise.plans.watch import Watch, flag_metrics, row_metrics
from stagewise.session import Workspace
from stagewise.sources.tables import FunnelSources

REQUEST_TAGS = [f"{t}_request" for t in vocab.TAGS]
LEAD_TAGS = L.LEAD_TAGS

STAGE_COLUMNS = [
    "student_id",
    "phone",
    "is_location_moscow",
    "lesson_id",
    "reason",
    "subject_id",
    "grade_kind",
    "subject_name",
    "time_start",
    "sl_lesson_id",
    "lal_created_at",
    "first_trial_lesson",
    "first_trial_any",
    "op_landing",
    "lead_type",
    "lead_type_2",
    "lead_created",
    "trial_created_at",
    "trial_finished_at",
    "subject_name_rev",
    "first_purchase",
    "page_name",
    *REQUEST_TAGS,
    *LEAD_TAGS,
    "new_current_user_flag",
    "payment_id",
    "amount",
]

# every stage column that may differ between two rows of a person and request takes part in the order
FLAG_COLUMNS = FlagColumns(ties=tuple(c for c in STAGE_COLUMNS if c not in ("phone", "lesson_id", "lead_created")))

# person key of the label of each grain, first non-NULL wins
LABEL_PERSON = {
    "month": ("phone", "student_id"),
    "week": ("student_id", "phone"),
    "day": ("student_id", "phone"),
}
# grains in the order of their label columns
LABEL_GRAINS = GRAINS[::-1]


def request_attribution(src: FunnelSources) -> DataFrame:
    """Tags of a registration, per student."""
    students = src.students.select("parent_id", F.col("id").alias("student_id"))
    tags = [F.col(t).alias(f"{t}_request") for t in vocab.TAGS]
    touches = src.traffic_source.select("parent_id", "added_to_telemarketing_list_request", *tags).distinct()
    return touches.join(students, "parent_id").drop("parent_id")


def request_rows(
    src: FunnelSources,
    requests: DataFrame,
    trials: DataFrame,
    leads: DataFrame,
    first_trial: DataFrame,
    first_trial_any: DataFrame,
    cfg: FunnelConfig,
    hot_phones: HotGroups,
    hot_students: HotGroups,
    work: Workspace | None = None,
    watch: Watch | None = None,
) -> DataFrame:
    """Requests with the later stages, then the lead and its attribution."""
    base = exclude_test_records(requests, names={"first_name": (vocab.TEST_STUDENT_NAMES, False)})
    base = base.where(F.col("subject_id").isNotNull())
    if watch is not None:
        watch.expect(base, "lesson_id")
    staged = attach_stages(
        base,
        [
            Stage(
                R.finished(trials, cfg).withColumn("finished_at", F.to_date("time_start")),
                on={k: k for k in ("student_id", "subject_id", "grade_kind", "time_start")},
                values={"finished_at": "trial_finished_at"},
            ),
            Stage(
                P.purchases_before(src, cfg),
                on={"student_id": "client_id", "subject_id": "subject_id"},
                values={"moment": "purchase_before"},
            ),
            Stage(
                P.purchases_after(src, cfg, work),
                on={"student_id": "client_id"},
                wildcard=("subject_id", "subject_id"),
                values={
                    "subject_name_rev": "subject_name_rev",
                    "moment": "purchase_after",
                    "payment_id": "payment_id",
                    "amount": "amount",
                },
            ),
            Stage(
                first_trial,
                on={"student_id": "student_id", "subject_id": "subject_id"},
                values={"created_at": "first_trial_lesson"},
            ),
            Stage(first_trial_any, on={"student_id": "student_id"}, values={"created_at": "first_trial_any"}),
        ],
    )
    logged = created_by_staff(staged, R.staff_log(src), ["student_id", "subject_id", "lesson_id"], "lesson_id")
    # a lead's nearest request is its earliest later one, so none outside these times can matter
    slots = R.matchable_requests(trials, src.subjects, cfg).where(lead_window("request_created_at", cfg))
    matched = L.matched_leads(leads, slots, cfg, hot_phones, work).select(
        F.col("phone").alias("_phone"),
        F.col("lesson_id").alias("_lesson"),
        "lal_created_at",
        F.coalesce("lead_subject", "request_subject").alias("lead_subject"),
        "op_landing",
        "page_name",
    )
    near = (
        (F.col("parent_phone") == F.col("_phone"))
        & (F.col("lesson_id") == F.col("_lesson"))
        & (F.col("lal_created_at") < F.col("created_at"))
        & (F.col("lal_created_at") + F.expr(cfg.attach_gap) > F.col("created_at"))
    )
    led = logged.join(matched, near, "left").drop("_phone", "_lesson")
    touched = attribute_within(
        led,
        request_attribution(src),
        "student_id",
        "created_at",
        "added_to_telemarketing_list_request",
        cfg.touch_ttl,
        hot_students,
        work=work,
    )

    log, lead, request = F.col("sl_lesson_id"), F.col("lal_created_at"), F.col("created_at")
    first, first_any = F.col("first_trial_lesson"), F.col("first_trial_any")
    labelled = touched.withColumns(
        {
            "subject_name": C.pair_label(F.col("subject_id"), F.col("grade_kind"), vocab.PRODUCTS_BY_ID),
            "lead_created": lead_time(log, lead, request, cfg.lead_offset),
            "lead_type_2": request_lead_type(
                log, lead, F.col("lead_subject"), first, first_any, request, F.col("op_landing")
            ),
            "first_purchase": F.coalesce("purchase_before", "purchase_after"),
            "new_current_user_flag": C.same_bucket(F.col("parent_created_at"), lead),
            "trial_created_at": F.to_date("created_at"),
            "amount": F.round("amount", 0),
        }
    )
    tags = L.lead_attribution(src).select(
        F.col("phone").alias("_phone"), F.col("created_at").alias("_created"), *LEAD_TAGS
    )
    attributed = labelled.join(
        tags, (F.col("phone") == F.col("_phone")) & (F.col("lead_created") == F.col("_created")), "left"
    )
    return with_group_fallback(attributed, LEAD_TAGS, REQUEST_TAGS).select(*STAGE_COLUMNS).distinct()


def lead_window(ts: str, cfg: FunnelConfig) -> Column:
    """Times at which a lead can touch the run slice.

    From the attach bound before the slice (whole first day at least) to the end
    of its last day; reaches the scans as a filter on the plain column.
    """
    lo, hi = F.lit(cfg.lo).cast("timestamp"), F.lit(cfg.hi).cast("timestamp")
    reach = lo - F.expr(cfg.attach_gap) - F.expr(cfg.lead_offset)
    start = F.least(F.date_trunc("day", lo), reach)
    return (F.col(ts) >= start) & (F.col(ts) < F.date_trunc("day", hi) + F.expr("interval 1 day"))


def in_play(src: FunnelSources, requests: DataFrame) -> DataFrame:
    """People with a request or a lead in the slice, and all who share their phone."""
    persons = R.people(src)
    phones = requests.select(F.col("parent_phone").alias("phone")).unionAll(src.landing_leads.select("phone"))
    by_phone = persons.join(phones.distinct(), F.col("parent_phone") == F.col("phone"), "left_semi")
    students = requests.where("parent_phone IS NULL").select("student_id").distinct()
    return by_phone.unionByName(persons.where("parent_phone IS NULL").join(students, "student_id", "left_semi"))


def narrowed(
    src: FunnelSources, cfg: FunnelConfig, work: Workspace
) -> tuple[FunnelSources, DataFrame, DataFrame, dict[str, HotGroups]]:
    """The requests of the slice, the trial history of the people in play with its large groups, and their sources.

    A run covers a short slice of a long history. Leads and their tags are cut
    by time at the scan. Payments, lessons and registration touches are cut to the
    people in play, orders to their payments, statuses and staff logs to the
    lessons of the slice, all before anything is joined, grouped or parsed. All
    rows of a kept person stay.
    """
    src = replace(
        src,
        landing_leads=src.landing_leads.where(lead_window("created_at", cfg)),
        traffic_source_lead=src.traffic_source_lead.where(lead_window("created_at", cfg)),
    )
    sliced = src.lessons.where(C.in_slice(F.col("created_at"), cfg.lo, cfg.hi, cfg.hi_inclusive))
    created = R.trial_lessons(replace(src, lessons=sliced))
    created_ids = sliced.select(F.col("id").alias("lesson_id"))
    statuses = src.lessons_students_statuses.join(created_ids, "lesson_id", "left_semi")
    requests = work.stage(R.requests(created, statuses, cfg), "requests")

    players = work.stage(in_play(src, requests), "people")
    students = players.select("student_id")
    bridge = src.lessons_students.join(students, "student_id", "left_semi")
    clients = students.withColumnRenamed("student_id", "client_id")
    payments = src.payments.join(clients, "client_id", "left_semi")
    paid_ids = payments.select(F.col("id").alias("payment_id"))
    src = replace(
        src,
        lessons_students=bridge,
        payments=payments,
        orders=src.orders.join(paid_ids, "payment_id", "left_semi"),
        lesson_creation_logs=src.lesson_creation_logs.join(requests.select("lesson_id"), "lesson_id", "left_semi"),
        traffic_source=src.traffic_source.join(players.select("parent_id"), "parent_id", "left_semi"),
    )
    # leads and trials of a phone are swept together, so either side alone counts from half the size
    trials, hot = stage_watched(
        R.trial_lessons(src, players), "trials", ["parent_phone", "student_id"], work, cfg.hot_rows // 2
    )
    return src, requests, trials, hot


def funnel_rows(
    src: FunnelSources,
    cfg: FunnelConfig,
    work: Workspace,
    page_rules: DataFrame | None = None,
    watch: Watch | None = None,
) -> DataFrame:
    """Request rows and unconverted leads, tagged 1 and 2."""
    src, requests, trials, hot = narrowed(src, cfg, work)
    leads, hot_leads = stage_watched(L.flagged_leads(src, cfg, page_rules), "leads", ["phone"], work, cfg.hot_rows // 2)
    # rows without a phone match nothing, however many they are
    hot_phones = merged_hot("phone", *[named_keys(g) for g in (hot_leads["phone"].keys, hot["parent_phone"].keys)])
    first_trial = R.first_trials(trials, cfg, by_subject=True)
    first_trial_any = R.first_trials(trials, cfg, by_subject=False)
    converted = request_rows(
        src,
        requests,
        trials,
        L.labelled_leads(leads),
        first_trial,
        first_trial_any,
        cfg,
        hot_phones,
        hot["student_id"],
        work,
        watch,
    )
    unconverted = L.unconverted_leads(src, L.first_leads_of_day(leads), first_trial, first_trial_any, cfg)
    return union_stages(converted, unconverted).select(*STAGE_COLUMNS, "union_rn")


def flagged_rows(
    rows: DataFrame, cfg: FunnelConfig, work: Workspace | None = None, hot: HotGroups | None = None
) -> DataFrame:
    """Period flags, less the unconverted leads of days that are covered.

    ``hot`` lists the large groups of phones, if they are known.
    """

    def flags(df: DataFrame) -> DataFrame:
        return period_flags(
            df,
            FLAG_COLUMNS,
            sentinel=cfg.sentinel,
            exact_daily_lead=cfg.exact_daily_lead,
            hot_rows=cfg.hot_rows,
            hot=hot,
            work=work,
        )

    kept = flags(rows).where((F.col("union_rn") == 1) | (F.col("rn_daily") == 1))
    return flags(kept.select(*rows.columns)) if cfg.flags_after_suppression else kept


def sales_funnel(
    src: FunnelSources,
    cfg: FunnelConfig = FunnelConfig(),
    work: Workspace | None = None,
    page_rules: DataFrame | None = None,
    watch: Watch | None = None,
) -> DataFrame:
    """The fact table of 52 columns: stages, flags and per-period labels.

    Relations read more than once are staged in the shared work folder: the
    requests, people and trial lessons in play, the flagged leads, the stacked and the
    flagged rows. Large groups are learnt from these writes. ``page_rules`` are launch rules
    as rows (``operators.rules.PAGE_RULES``) in place of the fixed ones.
    A ``watch`` takes the figures of the run and stops it where one lies outside its bounds.
    """
    return spread_label_sets(funnel_with_label_sets(src, cfg, work, page_rules, watch), LABEL_GRAINS)


def funnel_with_label_sets(
    src: FunnelSources,
    cfg: FunnelConfig = FunnelConfig(),
    work: Workspace | None = None,
    page_rules: DataFrame | None = None,
    watch: Watch | None = None,
) -> DataFrame:
    """The fact table before its rows fan out by their labels, which are sets for each of ``LABEL_GRAINS`` here."""
    work = work or Workspace(src.lessons.sparkSession)

    def written(stage: str, metrics: dict[str, Column], df: DataFrame, write):
        return write(df) if watch is None else watch.during(stage, metrics, df, write)

    rows, hot = written(
        "rows",
        row_metrics(),
        funnel_rows(src, cfg, work, page_rules, watch),
        lambda df: stage_watched(df, "rows", ["phone"], work, cfg.hot_rows),
    )
    fact = written(
        "flagged", flag_metrics(), flagged_rows(rows, cfg, work, hot["phone"]), lambda df: work.stage(df, "flagged")
    )
    if watch is not None:
        watch.compare(rows.where("union_rn = 1"), "lesson_id")
        watch.verify()
    out = fact
    for grain in LABEL_GRAINS:
        out = with_label_sets(out, grain, LABEL_PERSON[grain], cols=FLAG_COLUMNS, sentinel=cfg.sentinel, fact=fact)
    return out
