"""Figures of a funnel run and the bounds they must keep.

Figures come out of the writes that a run makes anyway, as metrics of the write; only what
needs the rows of a request together (lost requests, the largest fan-out) is counted in a
job of its own, over the ids.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import TypeVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")


class BrokenInvariant(RuntimeError):
    """A figure of the run lies outside its bounds."""


@dataclass(frozen=True)
class Bound:
    """What a figure may be: a number, or another figure (stage, metric); NULL for no limit."""

    stage: str
    metric: str
    at_least: int | tuple[str, str] | None = None
    at_most: int | tuple[str, str] | None = None


# what holds in any run: no request is lost or made up, covered rows stay, no later stage without
# the earlier one, every row is numbered and only first ones of their lead day are left without a request
FUNNEL_BOUNDS = (
    Bound("requests", "lost", at_most=0),
    Bound("requests", "made_up", at_most=0),
    Bound("rows", "finished_without_request", at_most=0),
    Bound("rows", "lead_after_request", at_most=0),
    Bound("rows", "without_lead_time", at_most=0),
    Bound("flagged", "rows", at_most=("rows", "rows")),
    Bound("flagged", "request_rows", at_least=("rows", "request_rows"), at_most=("rows", "request_rows")),
    Bound("flagged", "not_numbered", at_most=0),
    Bound("flagged", "later_leads_of_a_day", at_most=0),
)


def row_metrics() -> dict[str, Column]:
    """Figures of the stacked rows: sizes, what stayed without a match, and what must not be."""
    request = F.col("union_rn") == 1

    def requests(test: Column) -> Column:
        return F.count_if(request & F.coalesce(test, F.lit(False)))

    return {
        "rows": F.count(F.lit(1)),
        "request_rows": F.count_if(request),
        "without_lead": requests(F.col("lal_created_at").isNull()),
        "without_finish": requests(F.col("trial_finished_at").isNull()),
        "without_purchase": requests(F.col("first_purchase").isNull()),
        "without_first_trial": requests(F.col("first_trial_any").isNull()),
        "without_lead_time": F.count_if(F.col("lead_created").isNull()),
        "finished_without_request": F.count_if(F.col("trial_finished_at").isNotNull() & F.col("trial_created_at").isNull()),
        "lead_after_request": requests(F.to_date("lal_created_at") > F.col("trial_created_at")),
    }


def flag_metrics() -> dict[str, Column]:
    """Figures of the flagged rows."""
    numbers = [f"rn_{g}{b}" for g in ("daily", "weekly", "monthly") for b in ("", "_lead")]
    missing = F.lit(False)
    for name in numbers:
        missing = missing | F.col(name).isNull()
    counted = {f"counted_{name[3:]}": F.count_if(F.col(name) == 1) for name in numbers}
    return {
        "rows": F.count(F.lit(1)),
        "request_rows": F.count_if(F.col("union_rn") == 1),
        "not_numbered": F.count_if(missing),
        "later_leads_of_a_day": F.count_if((F.col("union_rn") != 1) & (F.col("rn_daily") != 1)),
        **counted,
    }


class Watch:
    """Collects the figures of one run; `verify` raises where one lies outside its bounds.

    Add bounds of your own, such as the largest fan-out of a request:
    ``Watch([*FUNNEL_BOUNDS, Bound("requests", "largest_fan_out", at_most=50)])``.
    """

    def __init__(self, bounds: Sequence[Bound] = FUNNEL_BOUNDS):
        self.bounds = tuple(bounds)
        self.figures: dict[tuple[str, str], int] = {}
        self.requests: DataFrame | None = None

    def during(self, stage: str, metrics: Mapping[str, Column], df: DataFrame, write: Callable[[DataFrame], T]) -> T:
        """Write a relation by ``write`` and take its figures from that write."""
        seen = Observation()
        out = write(df.observe(seen, *[c.alias(n) for n, c in metrics.items()]))
        self.figures |= {(stage, n): v for n, v in seen.get.items() if n in metrics}
        return out

    def expect(self, requests: DataFrame, request_id: str) -> None:
        """The requests that must come out of the run."""
        self.requests = requests.select(F.col(request_id).alias("_wanted"))

    def compare(self, rows: DataFrame, request_id: str) -> None:
        """Count the expected requests that ``rows`` lack, and the rows of the others."""
        if self.requests is None:
            raise ValueError("no requests are expected")
        wanted = self.requests.groupBy("_wanted").agg(F.count(F.lit(1)).alias("_times"))
        got = rows.groupBy(F.col(request_id).alias("_got")).agg(F.count(F.lit(1)).alias("_rows"))
        both = wanted.join(got, F.col("_wanted").eqNullSafe(F.col("_got")), "full")
        counts = {
            "expected": F.count("_times"),
            "lost": F.count_if(F.col("_rows").isNull()),
            "made_up": F.count_if(F.col("_times").isNull()),
            "largest_fan_out": F.coalesce(F.max("_rows"), F.lit(0)),
        }
        found = both.agg(*[c.alias(n) for n, c in counts.items()]).first()
        self.figures |= {("requests", n): found[n] for n in counts}

    def broken(self) -> list[str]:
        """Every bound that does not hold, in words; a bound on a figure that was not taken is broken too."""

        def value(limit: int | tuple[str, str]) -> int | None:
            return limit if isinstance(limit, int) else self.figures.get(limit)

        out = []
        for b in self.bounds:
            found = self.figures.get((b.stage, b.metric))
            limits = [(word, value(x)) for word, x in (("at least", b.at_least), ("at most", b.at_most)) if x is not None]
            for word, limit in limits:
                fits = found is not None and limit is not None and (found >= limit if word == "at least" else found <= limit)
                if not fits:
                    out.append(f"{b.stage}.{b.metric} is {found}, must be {word} {limit}")
        return out

    def verify(self) -> None:
        """Raise if a bound is broken."""
        if found := self.broken():
            raise BrokenInvariant("; ".join(found))

    def table(self, spark: SparkSession) -> DataFrame:
        """The figures as rows: stage, metric, value."""
        rows = [(stage, metric, value) for (stage, metric), value in sorted(self.figures.items())]
        return spark.createDataFrame(rows, "stage string, metric string, value long")
