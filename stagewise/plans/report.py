"""Counts and rates of the funnel by period, segment and traffic source."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.functions import vocab
from stagewise.functions.columns import code_label, period
from stagewise.operators.periods import FLAG, GRAINS, FlagColumns, label_period

COUNTS = ("leads", "requests", "finished", "purchases")
LABELS = ("enrolment_type", "lead_type")


@dataclass(frozen=True)
class FactColumns:
    """Stage columns of the fact table."""

    flags: FlagColumns = FlagColumns()
    start: str = "time_start"
    finished: str = "trial_finished_at"
    purchase: str = "first_purchase"


def _flag_and_period(grain: str, basis: str, cols: FactColumns, sentinel: str) -> tuple[str, Column]:
    if basis == "lead":
        return FLAG[grain] + "_lead", period(grain, F.col(cols.flags.lead_ts))
    if basis == "request":
        return FLAG[grain], label_period(cols.flags, grain, sentinel)
    raise ValueError("basis is 'lead' or 'request'")


def counted_rows(fact: DataFrame, grain: str, basis: str, cols: FactColumns, sentinel: str) -> DataFrame:
    """The rows that count in their period: each person and product once."""
    flag, when = _flag_and_period(grain, basis, cols, sentinel)
    return fact.where(F.col(flag) == 1).withColumn("period", when)


def funnel_counts(
    fact: DataFrame,
    grain: str = "month",
    basis: str = "lead",
    by: Sequence[Column] = (),
    cols: FactColumns = FactColumns(),
    sentinel: str = "2018-01-01",
) -> DataFrame:
    """Leads, requests, finished trials and purchases per period (and segment)."""
    rows = counted_rows(fact, grain, basis, cols, sentinel)
    return rows.groupBy("period", *by).agg(*_counts(cols))


def _counts(cols: FactColumns) -> list[Column]:
    requested = F.col(cols.flags.request_day).isNotNull()
    return [
        F.count_if(F.col(cols.flags.lead_ts).isNotNull()).alias("leads"),
        F.count_if(requested).alias("requests"),
        F.count_if(requested & F.col(cols.finished).isNotNull()).alias("finished"),
        F.count_if(requested & F.col(cols.purchase).isNotNull()).alias("purchases"),
    ]


def school_type(level: str = "grade_kind") -> Column:
    return code_label(F.col(level), vocab.SCHOOL_TYPES, vocab.UNDEFINED).alias("school_type")


def _basis_column(name: str, source: str) -> Column:
    if source not in ("lead", "request"):
        raise ValueError("source is 'lead' or 'request'")
    return F.col(f"{name}_{source}")


def traffic_type(source: str = "lead") -> Column:
    """Traffic category of the lead or of the request; unknown ones are undefined."""
    kind = _basis_column("external_source_type", source)
    known = F.when(kind.isin(*vocab.TRAFFIC_TYPES), kind)
    return F.coalesce(known, F.lit(vocab.UNDEFINED)).alias("traffic_type")


def channel(source: str = "lead") -> Column:
    return F.coalesce(_basis_column("traffic_source", source), F.lit(vocab.UNDEFINED)).alias("channel")


def utm_tag(tag: str, source: str = "lead") -> Column:
    return F.coalesce(_basis_column(tag, source), F.lit(vocab.UNDEFINED)).alias(tag)


def lead_type_of(grain: str) -> tuple[Column, Column]:
    """Enrolment type and lead type as labelled for the period."""
    return F.col(f"lead_type_{grain}").alias("enrolment_type"), F.col(f"lead_type_2_{grain}").alias("lead_type")


def all_cuts(
    fact: DataFrame,
    cuts: Mapping[str, Mapping[str, Column]],
    grains: Sequence[str] = GRAINS,
    bases: Sequence[str] = ("lead", "request"),
    cols: FactColumns = FactColumns(),
    sentinel: str = "2018-01-01",
    labels: bool = False,
) -> DataFrame:
    """The counts of `funnel_counts` for every basis, grain and cut, from one scan of the fact.

    `cuts` names the reports and their columns; one without columns is the plain report. A
    row is spread over the bases and grains it counts in, then counted by grouping sets,
    combined before the only shuffle. Columns that a cut lacks are NULL in its rows, and
    `cut` tells this from a NULL of the fact. With `labels`, the cut `lead_type` has the
    types as labelled for the grain. A column that two cuts share is one and the same.
    """

    def counted(basis: str, grain: str) -> Column:
        flag, when = _flag_and_period(grain, basis, cols, sentinel)
        typed = [c.alias(f"_{n}") for n, c in zip(LABELS, lead_type_of(grain))] if labels else []
        entry = F.struct(F.lit(basis).alias("basis"), F.lit(grain).alias("grain"), when.alias("period"), *typed)
        return F.when(F.col(flag) == 1, entry)

    entries = F.array(*[counted(b, g) for b in bases for g in grains])
    spread = fact.withColumn("_at", F.explode(F.filter(entries, lambda e: e.isNotNull())))
    columns = {n: c for by in cuts.values() for n, c in by.items()}
    sets = {name: list(by) for name, by in cuts.items()}
    if labels:
        columns |= {n: F.col(f"_at._{n}") for n in LABELS}
        sets["lead_type"] = list(LABELS)
    keys = ["basis", "grain", "period"]
    needed = [cols.flags.lead_ts, cols.flags.request_day, cols.finished, cols.purchase]
    # names of their own, as a cut may have the name of a column of the fact
    taken = {n: f"_cut_{n}" for n in columns}
    rows = spread.select(*needed, *[f"_at.{k}" for k in keys], *[c.alias(taken[n]) for n, c in columns.items()])
    by = [*keys, *taken.values()]
    grouped = rows.groupingSets([[F.col(c) for c in (*keys, *[taken[n] for n in s])] for s in sets.values()], *by)
    counts = grouped.agg(F.grouping_id().alias("_id"), *_counts(cols))
    # the bit of a column is set where its set does not hold it
    bits = {c: 1 << (len(by) - 1 - i) for i, c in enumerate(by)}
    number = {name: sum(bits[c] for n, c in taken.items() if n not in s) for name, s in sets.items()}
    if len(set(number.values())) < len(number):
        raise ValueError("two cuts have the same columns")
    cut = F.coalesce(*[F.when(F.col("_id") == i, F.lit(name)) for name, i in number.items()])
    return counts.select(*keys, cut.alias("cut"), *[F.col(c).alias(n) for n, c in taken.items()], *COUNTS)


def filtered(
    fact: DataFrame,
    enrolment_types: Sequence[str] | None = None,
    lead_types: Sequence[str] | None = None,
    enrolment_col: str = "lead_type",
    lead_type_col: str = "lead_type_2",
) -> DataFrame:
    """Rows of the chosen enrolment types and lead types."""
    out = fact
    if enrolment_types is not None:
        out = out.where(F.col(enrolment_col).isin(*enrolment_types))
    if lead_types is not None:
        out = out.where(F.col(lead_type_col).isin(*lead_types))
    return out


def _rate(part: str, whole: str) -> Column:
    return F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double"))


def conversion(counts: DataFrame) -> DataFrame:
    """Rates between the stages, NULL where the earlier stage is empty."""
    return counts.withColumns(
        {
            "lead_to_request": _rate("requests", "leads"),
            "request_to_finished": _rate("finished", "requests"),
            "finished_to_purchase": _rate("purchases", "finished"),
            "lead_to_purchase": _rate("purchases", "leads"),
        }
    )


def conversion_as_of(
    fact: DataFrame,
    as_of: str,
    grain: str = "month",
    basis: str = "request",
    by: Sequence[Column] = (),
    cols: FactColumns = FactColumns(),
    sentinel: str = "2018-01-01",
) -> DataFrame:
    """Finished rate over the requests that start by the end of ``as_of``.

    Requests that start later leave the denominator only; the counts stay whole.
    """
    requested = F.col(cols.flags.request_day).isNotNull()
    due = F.coalesce(F.to_date(cols.start) <= F.lit(as_of).cast("date"), F.lit(True))
    rows = counted_rows(fact, grain, basis, cols, sentinel)
    counts = rows.groupBy("period", *by).agg(
        F.count_if(requested).alias("requests"),
        F.count_if(requested & F.col(cols.finished).isNotNull()).alias("finished"),
        F.count_if(requested & due).alias("_due"),
    )
    return counts.withColumn("request_to_finished", _rate("finished", "_due")).drop("_due")
