"""Trial lessons with their people: requests, finished trials, history, staff log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.config import FunnelConfig
from stagewise.functions import columns as C
from stagewise.functions import vocab
from stagewise.operators.keyed import first_per_key, first_trial
from stagewise.sources.tables import FunnelSources


def slot_order() -> list[Column]:
    """Cancelled lessons first, by cancel time, then by creation."""
    return [F.col("canceled_at").asc_nulls_last(), F.col("created_at"), F.col("lesson_id")]


def people(src: FunnelSources) -> DataFrame:
    """Students with the parent's contact."""
    students = src.students.select(
        F.col("id").alias("student_id"),
        "parent_id",
        "first_name",
        "last_name",
        F.col("phone").alias("student_phone"),
    )
    parents = src.parents.select(
        F.col("id").alias("parent_id"),
        F.col("first_name").alias("parent_first_name"),
        F.col("last_name").alias("parent_last_name"),
        F.col("phone").alias("parent_phone"),
        F.col("created_at").alias("parent_created_at"),
        "is_location_moscow",
    )
    return students.join(parents, "parent_id")


def trial_lessons(src: FunnelSources, persons: DataFrame | None = None) -> DataFrame:
    """Every trial lesson of every known student, or of the given ones, with the parent's contact."""
    lessons = src.lessons.where(F.col("trial").eqNullSafe(True)).select(
        F.col("id").alias("lesson_id"),
        "subject_id",
        "grade_kind",
        "created_at",
        "time_start",
        "canceled_at",
        "kind",
        "status",
        "test",
    )
    bridge = src.lessons_students.select("lesson_id", "student_id")
    if persons is None:
        # only trial lessons meet the people
        return lessons.join(bridge, "lesson_id").join(people(src), "student_id")
    return bridge.join(persons, "student_id").join(lessons, "lesson_id")


def allowed(trials: DataFrame, cfg: FunnelConfig) -> DataFrame:
    """Trials of a kind that counts; a missing kind does not."""
    return trials.where(~F.col("kind").isin(*cfg.excluded_kinds))


def status_reasons(statuses: DataFrame) -> DataFrame:
    """One reason per lesson, so that statuses cannot multiply requests."""
    return statuses.groupBy("lesson_id").agg(F.min("reason").alias("reason"))


def requests(trials: DataFrame, statuses: DataFrame, cfg: FunnelConfig) -> DataFrame:
    """Trials created in the run slice by reachable people, one per slot."""
    some_name = F.col("first_name").isNotNull() | F.col("last_name").isNotNull()
    some_parent_name = F.col("parent_first_name").isNotNull() | F.col("parent_last_name").isNotNull()
    reachable = F.col("parent_phone").isNotNull() | F.col("student_phone").isNotNull()
    created = allowed(trials, cfg).where(
        some_name & some_parent_name & reachable & C.in_slice(F.col("created_at"), cfg.lo, cfg.hi, cfg.hi_inclusive)
    )
    slots = first_per_key(created, ["student_id", "subject_id", "grade_kind", "time_start"], slot_order())
    return (
        slots.join(status_reasons(statuses), "lesson_id", "left")
        .withColumn("grade_kind", C.school_level(F.col("grade_kind")))
        .withColumn("subject_label", C.code_label(F.col("subject_id"), vocab.SUBJECTS, vocab.UNDEFINED))
        .select(
            "student_id",
            "first_name",
            "last_name",
            "is_location_moscow",
            "parent_phone",
            F.coalesce("parent_phone", "student_phone").alias("phone"),
            "parent_created_at",
            "lesson_id",
            "reason",
            "subject_id",
            "subject_label",
            "grade_kind",
            "created_at",
            "time_start",
        )
    )


def finished(trials: DataFrame, cfg: FunnelConfig) -> DataFrame:
    """Trials that took place."""
    return trials.where(C.is_false(F.col("test")) & F.col("status").isin(*cfg.finished_statuses)).select(
        "student_id", "subject_id", C.school_level(F.col("grade_kind")).alias("grade_kind"), "lesson_id", "time_start"
    )


def first_trials(trials: DataFrame, cfg: FunnelConfig, by_subject: bool) -> DataFrame:
    """First trial per student and subject, or per student."""
    keys = ["student_id", "subject_id"] if by_subject else ["student_id"]
    history = allowed(trials, cfg).select(
        "student_id", "lesson_id", "subject_id", "grade_kind", "created_at", "canceled_at"
    )
    return first_trial(history, keys).drop("canceled_at")


def subject_names(subjects: DataFrame) -> DataFrame:
    """Label of every known subject id."""
    label = C.code_label(F.col("id"), vocab.SUBJECTS, vocab.UNDEFINED)
    return subjects.select(F.col("id").alias("subject_id"), label.alias("request_subject")).distinct()


def matchable_requests(trials: DataFrame, subjects: DataFrame, cfg: FunnelConfig) -> DataFrame:
    """Requests leads can be matched to, one per student, subject and start, by parent phone."""
    slots = first_per_key(allowed(trials, cfg), ["subject_id", "student_id", "time_start"], slot_order())
    by_phone = slots.where(F.col("parent_phone").isNotNull()).select(
        F.col("parent_phone").alias("phone"), "lesson_id", "subject_id", F.col("created_at").alias("request_created_at")
    )
    return by_phone.distinct().join(subject_names(subjects), "subject_id", "left").drop("subject_id")


def staff_log(src: FunnelSources) -> DataFrame:
    """Trial lessons that staff created for a student."""
    logs = src.lesson_creation_logs.select(F.col("id").alias("log_id"), "lesson_id", "student_id")
    lessons = src.lessons.where(F.col("trial").eqNullSafe(True)).select(
        F.col("id").alias("lesson_id"), "subject_id", "grade_kind", "time_start"
    )
    return logs.join(lessons, "lesson_id")


def paid_lessons(src: FunnelSources, cfg: FunnelConfig) -> DataFrame:
    """Paid lessons of each student, planned or done."""
    lessons = src.lessons.where(C.is_false(F.col("trial")) & F.col("status").isin(*cfg.paid_statuses))
    return lessons.withColumnRenamed("id", "lesson_id").join(
        src.lessons_students.select("lesson_id", "student_id"), "lesson_id"
    )
