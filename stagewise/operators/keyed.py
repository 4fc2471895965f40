"""First and next event of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagewise.operators.skew import HOT_ROWS, HotGroups, by_group_size, join_same, with_blocks
from stagewise.session import Workspace


def first_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the first in ``order``, which must be total.

    The filter on rank 1 lets every task keep one row per key before the
    shuffle, so a hot key sends as many rows as there are tasks.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def first_seen(df: DataFrame, keys: Sequence[str], ts: str, out: str | None = None) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(ts).alias(out or ts))


def next_event(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: Sequence[str],
    out: str = "next_ts",
    hot_rows: int = HOT_ROWS,
    hot: HotGroups | None = None,
    work: Workspace | None = None,
) -> DataFrame:
    """Time of the following row of the same key, NULL for the last."""
    order = [F.col(ts), *tie]

    def plain(rows: DataFrame) -> DataFrame:
        return rows.withColumn(out, F.lead(ts).over(Window.partitionBy(*keys).orderBy(*order)))

    def sliced(rows: DataFrame) -> DataFrame:
        cut = with_blocks(rows, keys, {"_slice": [F.col(ts), *[F.col(c) for c in tie]]})
        by = [*keys, "_slice"]
        # a struct, to tell a following row without time from no following row
        inside = cut.withColumn("_next", F.lead(F.struct(ts)).over(Window.partitionBy(*by).orderBy(*order)))
        # the last row of a slice is followed by the first of the next slice
        starts = cut.groupBy(*by).agg(F.min(F.struct(ts)).alias("_start"))
        follow = starts.withColumn("_follow", F.lead("_start").over(Window.partitionBy(*keys).orderBy("_slice")))
        joined = join_same(inside, follow.drop("_start"), by)
        return joined.withColumn(out, F.coalesce("_next", "_follow")[ts]).drop("_slice", "_next", "_follow")

    return by_group_size(df, keys, plain, sliced, hot, hot_rows, work)


def first_trial(
    history: DataFrame,
    keys: Sequence[str],
    canceled_at: str = "canceled_at",
    created_at: str = "created_at",
    row_id: str = "lesson_id",
) -> DataFrame:
    """First trial per student, or per student and subject.

    Cancelled lessons come first, by cancel time; the rest by creation.
    """
    return first_per_key(history, keys, [F.col(canceled_at).asc_nulls_last(), F.col(created_at), F.col(row_id)])
