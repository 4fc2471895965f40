"""Matching events of two relations in time, without listing all pairs of a person."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagewise.functions.columns import seconds_between
from stagewise.operators.skew import HOT_ROWS, HotGroups, by_group_size, find_hot, join_same, with_blocks
from stagewise.operators.spans import left_join_points, left_join_spans
from stagewise.session import Workspace


@dataclass(frozen=True)
class Other:
    """A relation to look up in time: its time, its id and the name of the match."""

    rows: DataFrame
    ts: str
    row_id: str
    out: str = "match"


def asof(
    left: DataFrame,
    others: Other | Sequence[Other],
    keys: Sequence[str],
    ts: str,
    direction: str = "next",
    hot: HotGroups | None = None,
    hot_rows: int = HOT_ROWS,
    work: Workspace | None = None,
) -> DataFrame:
    """Each left row with the nearest row of every other relation strictly after it (or before it).

    All sides are merged per key and swept once in time order, so the work is
    one shuffle and one sort; a match is a struct of the found row, NULL if
    none. Found rows of the same time are told apart by their id: the smallest
    when looking ahead, the largest when looking back. A NULL key matches nothing.
    """
    others = [others] if isinstance(others, Other) else list(others)
    carried = [c for c in left.columns if c not in keys]
    found = [f"_found{n}" for n in range(len(others))]
    rows = left.select(
        *keys, F.col(ts).alias("_t"), F.lit(0).alias("_side"), F.struct(*carried).alias("_row")
    )
    for n, other in enumerate(others):
        rest = [c for c in other.rows.columns if c not in (*keys, other.ts, other.row_id)]
        known = other.rows.where(F.col(other.ts).isNotNull()).dropna(subset=list(keys))
        side = known.select(
            *keys,
            F.col(other.ts).alias("_t"),
            F.lit(n + 1).alias("_side"),
            F.struct(other.ts, other.row_id, *rest).alias(found[n]),
        )
        rows = rows.unionByName(side, allowMissingColumns=True)
    ahead = direction == "next"
    nearest = F.min if ahead else F.max

    def sort(*cols: str) -> list[Column]:
        return [F.col(c).desc() if ahead else F.col(c).asc() for c in cols]

    # among equal times the left row comes first and cannot see the others
    order = [*sort("_t"), F.col("_side"), *sort(*[f"{f}.{o.row_id}" for f, o in zip(found, others)])]

    def sweep(df: DataFrame, by: Sequence[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        seen = {f: F.last(f, ignorenulls=True).over(w) for f in found}
        return df.withColumns(seen).where(F.col("_side") == 0)

    def finish(df: DataFrame) -> DataFrame:
        matches = [F.when(F.col("_t").isNotNull(), F.col(f)).alias(o.out) for f, o in zip(found, others)]
        return df.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in carried], *matches)

    def plain(df: DataFrame) -> DataFrame:
        return finish(sweep(df, keys))

    def sliced(df: DataFrame) -> DataFrame:
        # the order of the sweep, ascending; left rows of one instant never see each other, so any order does
        side = -F.col("_side") if ahead else F.col("_side")
        ids = [F.col(f"{f}.{o.row_id}") for f, o in zip(found, others)]
        cut = with_blocks(df, keys, {"_slice": [F.col("_t"), side, *ids, F.xxhash64("_row")]})
        by = [*keys, "_slice"]
        # what a slice hands on: the nearest rows of the slices swept before it
        best = cut.groupBy(*by).agg(*[nearest(f).alias(f) for f in found])
        passed = Window.partitionBy(*keys).orderBy(*sort("_slice")).rowsBetween(Window.unboundedPreceding, -1)
        carry = best.select(*by, *[F.last(f, ignorenulls=True).over(passed).alias("_c" + f) for f in found])
        joined = join_same(sweep(cut, by), carry, by)
        return finish(joined.withColumns({f: F.coalesce(f, "_c" + f) for f in found}))

    return by_group_size(rows, keys, plain, sliced, hot, hot_rows, work)


def nearest_match(
    leads: DataFrame,
    requests: DataFrame,
    person: str,
    lead_ts: str,
    lead_id: str,
    request_ts: str,
    request_id: str,
    subject: str,
    max_gap: int,
    rank_side: str = "lead",
    hot_rows: int = HOT_ROWS,
    hot: HotGroups | None = None,
    work: Workspace | None = None,
) -> DataFrame:
    """Pairs of a lead and a later request of the same person.

    ``rank_side='lead'``: for every lead the nearest request of each subject the
    person asked for. ``rank_side='request'``: for every request the nearest
    lead, whatever its subject. Gaps of ``max_gap`` whole seconds or more drop.
    The columns of the two sides must differ except for ``person``.
    """
    if hot is None:
        # counted on the plain inputs, before leads meet subjects
        hot = find_hot(leads.select(person).unionAll(requests.select(person)), [person], hot_rows, work)
    if rank_side == "lead":
        # NULL is a subject of its own
        keyed = requests.withColumn("_key", F.coalesce(F.concat(F.lit("="), subject), F.lit("")))
        # one row per person and subject: few per person, and free of copies
        asked = keyed.select(person, "_key").where(F.col(person).isNotNull()).distinct()
        wanted = leads.join(asked, person)
        later = Other(keyed, request_ts, request_id, "_m")
        pairs = asof(wanted, later, [person, "_key"], lead_ts, "next", hot, hot_rows, work)
        columns = [*leads.columns, *[F.col(f"_m.{c}").alias(c) for c in requests.columns if c != person]]
    else:
        pairs = asof(requests, Other(leads, lead_ts, lead_id, "_m"), [person], request_ts, "prev", hot, hot_rows, work)
        columns = [
            *[F.col(c if c == person else f"_m.{c}").alias(c) for c in leads.columns],
            *[c for c in requests.columns if c != person],
        ]
    matched = pairs.where(F.col("_m").isNotNull()).select(*columns)
    return matched.where(seconds_between(F.col(lead_ts), F.col(request_ts)) < max_gap)


def followed_by(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_ts: str,
    right_ts: str,
    horizon_end: Column,
    next_ts: str,
    open_end: str,
    first_ever: str,
    hot: HotGroups | None = None,
    hot_rows: int = HOT_ROWS,
    work: Workspace | None = None,
) -> DataFrame:
    """Left events with the right events inside their time span, ends included.

    The span ends at the horizon or at the next left event, whichever is first.
    A left row stays if it is first ever (a boolean column) or has a match.
    Keys with many rows are joined by blocks of time.
    """
    end = F.least(horizon_end, F.coalesce(F.col(next_ts), F.lit(open_end).cast("timestamp")))
    spans = left.withColumn("_from", F.col(left_ts).cast("timestamp")).withColumn("_to", end)
    right = right.withColumnRenamed(key, "_key")
    at, lo, hi = F.col(right_ts).cast("timestamp"), F.col("_from"), F.col("_to")
    joined = left_join_spans(spans, right, key, at, lo, hi, at.between(lo, hi), hot, hot_rows, work)
    kept = joined.where(F.coalesce(F.col(first_ever), F.lit(False)) | F.col("_key").isNotNull())
    return kept.drop("_from", "_to", "_key")


def attribute_within(
    df: DataFrame,
    touches: DataFrame,
    key: str,
    ts: str,
    touch_ts: str,
    ttl: str,
    hot: HotGroups | None = None,
    hot_rows: int = HOT_ROWS,
    work: Workspace | None = None,
) -> DataFrame:
    """Rows with the touches still valid at their time; a touch without time always is.

    Copies of a touch count once. Every row is kept; it comes out once for each
    valid touch of its key, so touches per key should be few. Keys with many rows are
    joined by blocks of time.
    """
    touches = touches.distinct().withColumnRenamed(key, "_key")
    end = F.col(touch_ts) + F.expr(ttl)
    valid = (F.col(ts) <= end) | F.col(touch_ts).isNull()
    return left_join_points(df, touches, key, F.col(ts), end, valid, hot, hot_rows, work).drop("_key")
