"""Joins of points in time with spans, for keys that hold a large share of all rows.

An equality join puts a key into one task. Here the times of a large key are cut into
blocks at the quantiles of its points. Every point lies in one block; a span is copied
into the blocks that it touches, and both meet by key and block. A pair comes out once,
as its point has one block only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.operators.skew import BLOCKS, HOT_ROWS, HotGroups, by_group_size, find_hot, join_same
from stagewise.session import Workspace

_BLOCK, _BOUNDS, _ROW = "_block", "_bounds", "_row"


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def in_blocks(
    points: DataFrame, spans: DataFrame, key: str, at: Column, lo: Column | None, hi: Column, n: int = BLOCKS
) -> tuple[DataFrame, DataFrame]:
    """Both sides with a block: points once, spans once for each block from `lo` to `hi`.

    A span without `lo` starts before all points, one whose `hi` is NULL ends after all.
    A point without time is in the first block. Bounds come from the points of each key,
    so that blocks are about equal; equal times share a block. One row of bounds per key.
    """
    shares = [i / n for i in range(1, n)]
    bounds = points.groupBy(key).agg(F.percentile_approx(_micros(at), shares, 20 * n).alias(_BOUNDS))

    def number(ts: Column, missing: Column) -> Column:
        reached = F.size(F.filter(F.array_distinct(_BOUNDS), lambda b: b <= _micros(ts)))
        return F.when(ts.isNull() | F.col(_BOUNDS).isNull(), missing).otherwise(reached)

    first, last = F.lit(0), F.coalesce(F.size(F.array_distinct(_BOUNDS)), F.lit(0))
    numbered = join_same(points, bounds, [key]).withColumn(_BLOCK, number(at, first))
    start = first if lo is None else number(lo, first)
    # a span that ends before it starts holds no point
    touched = F.sequence(start, F.greatest(start, number(hi, last)))
    copied = join_same(spans, bounds, [key]).withColumn(_BLOCK, F.explode(touched))
    return numbered.drop(_BOUNDS), copied.drop(_BOUNDS)


def left_join_points(
    left: DataFrame,
    spans: DataFrame,
    key: str,
    at: Column,
    hi: Column,
    inside: Column,
    hot: HotGroups | None = None,
    hot_rows: int = HOT_ROWS,
    work: Workspace | None = None,
) -> DataFrame:
    """Left rows with the spans that hold their time; a left row without any stays.

    Spans have no start; `hi` is their end, NULL for none. The key of `spans` is named
    `_key`, `inside` is the exact condition besides the key.
    """

    def plain(rows: DataFrame) -> DataFrame:
        return rows.join(spans, (F.col(key) == F.col("_key")) & inside, "left")

    def sliced(rows: DataFrame) -> DataFrame:
        points, copied = in_blocks(rows, _of_keys(spans, rows, key), key, at, None, hi)
        copied = copied.drop(key).withColumnRenamed(_BLOCK, "_b")
        met = (F.col(key) == F.col("_key")) & (F.col(_BLOCK) == F.col("_b")) & inside
        return points.join(copied, met, "left").drop(_BLOCK, "_b")

    return by_group_size(left, [key], plain, sliced, hot, hot_rows, work)


def left_join_spans(
    left: DataFrame,
    points: DataFrame,
    key: str,
    at: Column,
    lo: Column,
    hi: Column,
    inside: Column,
    hot: HotGroups | None = None,
    hot_rows: int = HOT_ROWS,
    work: Workspace | None = None,
) -> DataFrame:
    """Left rows, whose spans go from `lo` to `hi`, with the points inside; a left row without any stays.

    A key is large by its rows on either side. The key of `points` is named `_key`, `inside`
    is the exact condition besides the key. Left rows are numbered when those of large
    keys are written, so that a copy without a point does not pass for a row without any.
    """
    work = work or Workspace(left.sparkSession)
    if hot is None:
        hot = find_hot(left.select(key).unionAll(points.select("_key")), [key], hot_rows, work)

    def plain(rows: DataFrame) -> DataFrame:
        return rows.join(points, (F.col(key) == F.col("_key")) & inside, "left")

    def sliced(rows: DataFrame) -> DataFrame:
        numbered, copied = in_blocks(_of_keys(points, rows, key), rows, key, at, lo, hi)
        numbered = numbered.drop(key).withColumnRenamed(_BLOCK, "_b")
        met = (F.col(key) == F.col("_key")) & (F.col(_BLOCK) == F.col("_b")) & inside
        pairs = work.stage(copied.join(numbered, met).drop(_BLOCK, "_b"), "pairs")
        alone = rows.join(pairs.select(F.col(_ROW).alias("_r")).distinct(), F.col(_ROW) == F.col("_r"), "left_anti")
        return pairs.unionByName(alone, allowMissingColumns=True)

    if hot.keys is None:
        return plain(left)
    rows = left.withColumn(_ROW, F.monotonically_increasing_id())
    return by_group_size(rows, [key], plain, sliced, hot, hot_rows, work).drop(_ROW)


def _of_keys(side: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows of the other side whose key the large rows have, with the key under both names."""
    keys = rows.select(F.col(key).alias("_wanted")).distinct()
    return side.join(keys, F.col("_key") == F.col("_wanted"), "left_semi").withColumn(key, F.col("_key"))
