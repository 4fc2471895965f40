"""Leads from landing pages, matched and unconverted."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.config import FunnelConfig
from stagewise.functions import columns as C
from stagewise.functions import vocab
from stagewise.operators.keyed import first_per_key
from stagewise.operators.labelling import launch_rules, with_canonical_page, with_rule_flag
from stagewise.operators.lead_type import unconverted_lead_type
from stagewise.operators.match import nearest_match
from stagewise.operators.rules import with_rule_label
from stagewise.operators.skew import HotGroups
from stagewise.operators.stages import exclude_test_records
from stagewise.session import Workspace
from stagewise.sources.tables import FunnelSources

LEAD_TAGS = [f"{t}_lead" for t in vocab.TAGS]


def real_leads(src: FunnelSources) -> DataFrame:
    return exclude_test_records(src.landing_leads, names={"name": (vocab.TEST_LEAD_NAMES, True)})


def flagged_leads(src: FunnelSources, cfg: FunnelConfig, page_rules: DataFrame | None = None) -> DataFrame:
    """Real leads with page and funnel-page flag.

    The flag follows the fixed launch times, or the rows of ``page_rules`` if they are
    given: any rule that holds sets it, whatever its label.
    """
    leads = with_canonical_page(real_leads(src), "page_url", vocab.PAGE_LABELS, cfg.strict_pages)
    if page_rules is None:
        flagged = with_rule_flag(leads, "page", "created_at", "tag", launch_rules(cfg.site), out="op_landing")
    else:
        labelled = with_rule_label(leads, "page", "created_at", page_rules.withColumn("label", F.lit("1")), out="_rule")
        hit = F.col("_rule").isNotNull() | C.has_tag(labelled, "tag", vocab.FUNNEL_TAG)
        flagged = labelled.withColumn("op_landing", F.when(hit, 1).otherwise(0))
    return flagged.select("phone", "subject", "created_at", "page", "op_landing")


def labelled_leads(flagged: DataFrame) -> DataFrame:
    """One flagged lead per phone, subject and time."""
    return first_per_key(flagged, ["phone", "subject", "created_at"], ["page", "op_landing"])


def first_leads_of_day(flagged: DataFrame) -> DataFrame:
    """First flagged lead per phone, subject and day."""
    dated = flagged.withColumn("lead_day", F.to_date("created_at"))
    return first_per_key(dated, ["phone", "subject", "lead_day"], ["created_at", "page", "op_landing"])


def matched_leads(
    leads: DataFrame, requests: DataFrame, cfg: FunnelConfig, hot: HotGroups | None = None, work: Workspace | None = None
) -> DataFrame:
    """Leads with the request they led to."""
    named = leads.where(F.col("phone").isNotNull()).select(
        "phone",
        F.col("subject").alias("lead_subject"),
        F.col("created_at").alias("lal_created_at"),
        F.col("page").alias("page_name"),
        "op_landing",
    )
    return nearest_match(
        named,
        requests,
        person="phone",
        lead_ts="lal_created_at",
        lead_id="lead_subject",
        request_ts="request_created_at",
        request_id="lesson_id",
        subject="request_subject",
        max_gap=cfg.max_gap_seconds,
        rank_side=cfg.rank_side,
        hot_rows=cfg.hot_rows,
        hot=hot,
        work=work,
    )


def lead_attribution(src: FunnelSources) -> DataFrame:
    """Tags of a lead by phone and time, copies once."""
    return src.traffic_source_lead.select("phone", "created_at", *LEAD_TAGS).distinct()


def first_person_of_phone(src: FunnelSources) -> DataFrame:
    """One parent and student per phone, the smallest ids."""
    parents = src.parents.where(F.col("phone").isNotNull()).select(
        F.col("id").alias("parent_id"), "phone", F.col("created_at").alias("parent_created_at"), "is_location_moscow"
    )
    students = src.students.select("parent_id", F.col("id").alias("student_id"))
    return first_per_key(
        parents.join(students, "parent_id", "left"),
        ["phone"],
        ["parent_id", F.col("student_id").asc_nulls_last()],
    )


def unconverted_leads(
    src: FunnelSources,
    first_of_day: DataFrame,
    first_trial: DataFrame,
    first_trial_any: DataFrame,
    cfg: FunnelConfig,
) -> DataFrame:
    """One lead per phone, subject, level and month of the slice, labelled from history.

    The monthly dedup comes first, so that everything after it joins few rows.
    """
    subject_ids = {label: code for code, label in vocab.SUBJECTS.items()}
    leads = real_leads(src).where(C.in_slice(F.col("created_at"), cfg.lo, cfg.hi, cfg.hi_inclusive))
    monthly = first_per_key(
        leads.withColumn("_month", C.period("month", F.col("created_at"))),
        ["phone", "subject", "grade_kind", "_month"],
        ["created_at", "page_url"],
    ).select("phone", "subject", "grade_kind", "created_at", "page_url")

    phones = leads.select("phone").distinct()
    reached = replace(src, parents=src.parents.join(phones, "phone", "left_semi"))
    persons = first_person_of_phone(reached).withColumnRenamed("phone", "_phone")
    day = first_of_day.select(
        F.col("phone").alias("_d_phone"),
        F.coalesce("subject", F.lit("0")).alias("_d_subject"),
        F.col("lead_day").alias("_d_day"),
        "op_landing",
    )
    day = first_per_key(day, ["_d_phone", "_d_subject", "_d_day"], ["op_landing"])
    tags = first_per_key(lead_attribution(src), ["phone", "created_at"], LEAD_TAGS).select(
        F.col("phone").alias("_t_phone"), F.col("created_at").alias("_t_created"), *LEAD_TAGS
    )
    subject_key = F.coalesce(F.col("subject"), F.lit("0"))
    rows = (
        monthly.join(persons, F.col("phone") == F.col("_phone"), "left")
        .join(
            day,
            (F.col("phone") == F.col("_d_phone"))
            & (subject_key == F.col("_d_subject"))
            & (F.to_date("created_at") == F.col("_d_day")),
            "left",
        )
        .join(tags, (F.col("phone") == F.col("_t_phone")) & (F.col("created_at") == F.col("_t_created")), "left")
        .withColumn("subject_id", C.code_label(F.col("subject"), subject_ids, 0))
    )

    ft = first_trial.select(
        F.col("student_id").alias("_ft_student"),
        F.col("subject_id").alias("_ft_subject"),
        F.col("created_at").alias("_ft"),
    )
    fta = first_trial_any.select(F.col("student_id").alias("_fta_student"), F.col("created_at").alias("_fta"))
    with_history = rows.join(
        ft,
        (F.col("student_id") == F.col("_ft_student"))
        & (F.col("subject_id") == F.col("_ft_subject"))
        & (F.col("_ft") <= F.col("created_at")),
        "left",
    ).join(fta, (F.col("student_id") == F.col("_fta_student")) & (F.col("_fta") <= F.col("created_at")), "left")

    product = C.pair_label(F.col("subject"), F.col("grade_kind"), vocab.PRODUCTS)
    return with_history.select(
        "student_id",
        "phone",
        "is_location_moscow",
        "subject_id",
        "grade_kind",
        product.alias("subject_name"),
        F.col("created_at").alias("lal_created_at"),
        "op_landing",
        F.lit(vocab.BY_OPERATOR).alias("lead_type"),
        unconverted_lead_type(F.col("created_at"), product, F.col("_ft"), F.col("_fta"), F.col("op_landing")).alias(
            "lead_type_2"
        ),
        F.col("created_at").alias("lead_created"),
        C.canonical_page(F.col("page_url"), (), cfg.strict_pages).alias("page_name"),
        *LEAD_TAGS,
        C.same_bucket(F.col("parent_created_at"), F.col("created_at")).alias("new_current_user_flag"),
    )
