"""Ordered rules that name the type of a lead; the first that holds wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.functions import vocab

USER_NEW, USER_CURRENT, FUNNEL_PAGE, OTHER_PAGE, RESCHEDULED, OTHER = vocab.LEAD_TYPES


def first_rule(rules: Sequence[tuple[Column, str]], default: str | None) -> Column:
    out = F.lit(default)
    for condition, label in reversed(list(rules)):
        out = F.when(condition, label).otherwise(out)
    return out


def request_lead_type(
    staff_log: Column,
    lead_ts: Column,
    subject: Column,
    first_trial: Column,
    first_trial_any: Column,
    request_ts: Column,
    rule_flag: Column,
) -> Column:
    """Type of a request's lead.

    History is looked up in the lead's subject if it has one, else in any.
    """
    own = staff_log.isNull()
    led = staff_log.isNotNull() & lead_ts.isNotNull()
    with_subject = led & subject.isNotNull()
    no_subject = led & subject.isNull()
    # a missing first trial is neither earlier nor later than the lead
    fresh = (with_subject & (first_trial >= lead_ts)) | (no_subject & (first_trial_any >= lead_ts))
    repeated = (with_subject & (first_trial < lead_ts)) | (no_subject & (first_trial_any < lead_ts))
    return first_rule(
        [
            (own & (first_trial_any == request_ts), USER_NEW),
            (own & (first_trial_any != request_ts), USER_CURRENT),
            (fresh & (rule_flag == 1), FUNNEL_PAGE),
            (fresh & (rule_flag == 0), OTHER_PAGE),
            (repeated, RESCHEDULED),
            (staff_log.isNotNull() & lead_ts.isNull(), OTHER),
        ],
        vocab.UNDEFINED,
    )


def label_lead_type(
    df: DataFrame,
    staff_log: str,
    lead_ts: str,
    subject: str,
    first_trial: str,
    first_trial_any: str,
    request_ts: str,
    rule_flag: str,
    out: str = "lead_type_2",
) -> DataFrame:
    names = (staff_log, lead_ts, subject, first_trial, first_trial_any, request_ts, rule_flag)
    return df.withColumn(out, request_lead_type(*[F.col(n) for n in names]))


def unconverted_lead_type(
    lead_ts: Column, product: Column, first_trial: Column, first_trial_any: Column, rule_flag: Column
) -> Column:
    """Type of a lead without a request; NULL where the landing page is unknown."""
    no_product = product.isNull() | (product == vocab.UNDEFINED)
    fresh = (
        first_trial.isNull()
        | (first_trial == lead_ts)
        | first_trial_any.isNull()
        | (first_trial_any == lead_ts)
    )
    return first_rule(
        [
            (first_trial < lead_ts, RESCHEDULED),
            ((first_trial_any < lead_ts) & no_product, RESCHEDULED),
            ((rule_flag == 1) & fresh, FUNNEL_PAGE),
            ((rule_flag == 0) & fresh, OTHER_PAGE),
        ],
        None,
    )


# the rules above as decisions over few facts, the first that fits wins; None fits any value
REQUEST_FACTS = ("origin", "history", "landing")
REQUEST_DECISIONS = (
    ("own", "same", None, USER_NEW),
    ("own", "other", None, USER_CURRENT),
    ("led", "later", "1", FUNNEL_PAGE),
    ("led", "later", "0", OTHER_PAGE),
    ("led", "earlier", None, RESCHEDULED),
    ("unled", None, None, OTHER),
    (None, None, None, vocab.UNDEFINED),
)
UNCONVERTED_FACTS = ("history", "landing")
UNCONVERTED_DECISIONS = (
    ("earlier", None, RESCHEDULED),
    ("fresh", "1", FUNNEL_PAGE),
    ("fresh", "0", OTHER_PAGE),
)


def request_facts(
    staff_log: Column,
    lead_ts: Column,
    subject: Column,
    first_trial: Column,
    first_trial_any: Column,
    request_ts: Column,
    rule_flag: Column,
) -> dict[str, Column]:
    """What the type of a request's lead depends on, for `rules.decide`."""
    own, led = staff_log.isNull(), lead_ts.isNotNull()
    first = F.when(subject.isNotNull(), first_trial).otherwise(first_trial_any)
    compared = F.when(first_trial_any == request_ts, "same").when(first_trial_any != request_ts, "other")
    history = F.when(first >= lead_ts, "later").when(first < lead_ts, "earlier")
    return {
        "origin": F.when(own, "own").when(led, "led").otherwise("unled"),
        "history": F.when(own, compared).otherwise(history),
        "landing": rule_flag.cast("string"),
    }


def unconverted_facts(
    lead_ts: Column, product: Column, first_trial: Column, first_trial_any: Column, rule_flag: Column
) -> dict[str, Column]:
    """What the type of a lead without a request depends on, for `rules.decide`."""
    no_product = product.isNull() | (product == vocab.UNDEFINED)
    earlier = (first_trial < lead_ts) | ((first_trial_any < lead_ts) & no_product)
    fresh = first_trial.isNull() | (first_trial == lead_ts) | first_trial_any.isNull() | (first_trial_any == lead_ts)
    return {"history": F.when(earlier, "earlier").when(fresh, "fresh"), "landing": rule_flag.cast("string")}
