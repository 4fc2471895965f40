"""All dates, bounds and switches of the funnel in one value."""

from __future__ import annotations

from dataclasses import dataclass

from stagewise.operators.skew import HOT_ROWS


@dataclass(frozen=True)
class FunnelConfig:
    """Settings of one funnel run; times are UTC text as Spark casts it."""

    # run slice over lead and request creation
    lo: str = "2023-09-01 00:00:00"
    hi: str = "2023-09-10 00:00:00"
    hi_inclusive: bool = True

    # host of the landing site, used by the launch rules
    site: str = "example.com"

    # payments strictly before this day belong to the old era
    era_cut: str = "2021-08-27"
    min_amount: float = 1.0
    horizon: str = "interval 1 month"
    horizon_extra: str = "interval 30 days"
    open_end: str = "2999-12-31 00:00:00"

    # lead to request
    max_gap_seconds: int = 5_260_000
    attach_gap: str = "interval 14 days"
    rank_side: str = "lead"
    lead_offset: str = "interval 1 minute"

    # request attribution
    touch_ttl: str = "interval 54 days"

    # lessons
    excluded_kinds: tuple[int, ...] = (2, 5, 6)
    finished_statuses: tuple[int, ...] = (2, 3)
    paid_statuses: tuple[int, ...] = (0, 1, 2, 3)

    # flags
    sentinel: str = "2018-01-01"
    exact_daily_lead: bool = False
    flags_after_suppression: bool = False

    # pages: one trailing slash, or the doubled one before a query string
    strict_pages: bool = True

    # a group with more rows than this is split over several tasks
    hot_rows: int = HOT_ROWS
