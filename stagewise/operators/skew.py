"""Exact windows over groups that may hold a large share of all rows.

A window puts each group into one task. Before one is planned, the group sizes
are counted; groups above ``hot_rows`` rows are then cut into slices that follow
the window's order, and what a slice needs from the slices before or after it
travels in a summary with one row per slice. Without such groups the plan is
the ordinary window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from stagewise.session import Workspace

HOT_ROWS = 100_000
# rows of ordinary groups that one task sorts, where their number is known
TASK_ROWS = 50_000
# the list of hot keys is broadcast up to this many, beyond that it is joined as any table
MAX_BROADCAST_KEYS = 500_000
# keys that a summary of frequent keys holds, and lists; a key with more than one row in
# SURE is listed for certain: its error is a row in 0.75 * TRACKED, and two errors tell keys apart
TRACKED, LISTED = 16_384, 8_192
SURE = int(0.75 * TRACKED / 2)
# blocks that a hot group is cut into, and rows sampled for each
BLOCKS = 256
SAMPLE = 20


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on keys where NULL equals NULL; the left keys are kept."""
    cond: Column = F.lit(True)
    for key in keys:
        right = right.withColumnRenamed(key, "_k_" + key)
    for key in keys:
        cond = cond & left[key].eqNullSafe(right["_k_" + key])
    joined = left.join(right, cond, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*["_k_" + k for k in keys])


@dataclass(frozen=True)
class HotGroups:
    """The outcome of a size check: the keys of the large groups, if there are any, and how many rows were seen."""

    keys: DataFrame | None
    rows: int | None = None

    def spread(self, df: DataFrame, *keys: str) -> DataFrame:
        """Rows by key in tasks of about ``TASK_ROWS`` rows.

        Sorts of one task add up, and a size in bytes says little of them, as wide rows
        shrink in a shuffle. Where the rows were not counted, Spark chooses the number.
        """
        return df.repartition(*keys) if self.rows is None else df.repartition(self.rows // TASK_ROWS + 1, *keys)


def find_hot(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS, work: Workspace | None = None) -> HotGroups:
    """Count the groups and list those with more than ``hot_rows`` rows.

    Runs one job over the key columns, which writes the list; counts combine
    before the shuffle.
    At most ``rows / hot_rows`` keys can be listed (100,000 for 10**10 rows at
    the default). The list is staged in ``work``, or in a workspace of its own.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    seen = Observation()
    counted = sizes.observe(seen, F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"))
    large = (work or Workspace(df.sparkSession)).stage(counted.where(F.col("_n") > hot_rows).select(*keys), "hot")
    return HotGroups(None if large.isEmpty() else large, seen.get["rows"])


def stage_watched(
    df: DataFrame, name: str, keys: Sequence[str], work: Workspace, hot_rows: int = HOT_ROWS
) -> tuple[DataFrame, dict[str, HotGroups]]:
    """Stage a relation, and list the large groups of each key column out of the same write.

    Every writing task keeps a summary of frequent keys of bounded size; they are merged as
    metrics of the write, so that no job counts the groups. Up to ``hot_rows * SURE`` rows
    (about 6 * 10**8 at the default) a summary misses no group above ``hot_rows``; beyond
    that the groups of the staged rows are counted. NULL is a group like any other.
    """
    seen = Observation()
    metrics = [F.count(F.lit(1)).alias("n")]
    for i, key in enumerate(keys):
        column = "`" + key.replace("`", "``") + "`"
        metrics.append(F.expr(f"approx_top_k({column}, {LISTED}, {TRACKED})").alias(f"top{i}"))
        metrics.append(F.count_if(F.expr(column).isNull()).alias(f"nulls{i}"))
    staged = work.stage(df.observe(seen, *metrics), name)
    found = seen.get
    hot = {}
    for i, key in enumerate(keys):
        if found["n"] <= hot_rows:
            hot[key] = HotGroups(None, found["n"])
        elif found["n"] > hot_rows * SURE:
            hot[key] = find_hot(staged, [key], hot_rows, work)
        else:
            large = [(top["item"],) for top in found[f"top{i}"] if top["item"] is not None and top["count"] > hot_rows]
            large += [(None,)] if found[f"nulls{i}"] > hot_rows else []
            schema = StructType([StructField(key, staged.schema[key].dataType)])
            hot[key] = HotGroups(df.sparkSession.createDataFrame(large, schema) if large else None, found["n"])
    return staged, hot


def named_keys(keys: DataFrame | None) -> DataFrame | None:
    """A list of large groups less the NULL one, for joins in which NULL equals nothing; none if it is empty."""
    named = None if keys is None else keys.dropna()
    return None if named is None or named.isEmpty() else named


def merged_hot(name: str, *groups: DataFrame | None) -> HotGroups:
    """Groups that are large in any of several relations, each a list of one column."""
    lists = [g.toDF(name) for g in groups if g is not None]
    if not lists:
        return HotGroups(None)
    out = lists[0]
    for more in lists[1:]:
        out = out.union(more)
    return HotGroups(out.distinct())


def with_blocks(df: DataFrame, keys: Sequence[str], blocks: dict[str, Sequence[Column]], n: int = BLOCKS) -> DataFrame:
    """Add a block number per name: groups are cut by splitters sampled from a whole order.

    The order is ascending, NULL first, over all columns given, so rows of one instant are
    cut as well where later columns tell them apart; only rows that are equal in all of them
    share a block for certain. A later row is never in an earlier block. About
    ``SAMPLE * n`` rows of a group, chosen by the hash of their place, give its splitters:
    that many values are gathered in one row, however large the group is.
    """
    at = {name: F.struct(*[c.alias(f"c{i}") for i, c in enumerate(order)]) for name, order in blocks.items()}
    placed = df.withColumns({"_at" + name: place for name, place in at.items()})
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    sized = join_same(placed.select(*keys, *["_at" + name for name in blocks]), sizes, keys)
    every = F.greatest(F.lit(1), F.floor(F.col("_size") / (SAMPLE * n)))

    def sample(name: str) -> Column:
        place = F.col("_at" + name)
        return F.sort_array(F.collect_set(F.when(F.pmod(F.xxhash64(place), every) == 0, place)))

    def splitters(name: str) -> Column:
        found = F.col("_sample" + name)
        chosen = F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: F.get(found, (i * F.size(found) / n).cast("int")))
        return F.array_distinct(F.array_compact(chosen)).alias("_bounds" + name)

    samples = sized.groupBy(*keys).agg(*[sample(name).alias("_sample" + name) for name in blocks])
    joined = join_same(placed, samples.select(*keys, *[splitters(name) for name in blocks]), keys)

    def number(name: str) -> Column:
        return F.size(F.filter("_bounds" + name, lambda b: b <= F.col("_at" + name)))

    return joined.withColumns({name: number(name) for name in blocks}).drop(*["_bounds" + name for name in blocks], *["_at" + name for name in blocks])


def by_group_size(
    df: DataFrame,
    keys: Sequence[str],
    plain: Callable[[DataFrame], DataFrame],
    sliced: Callable[[DataFrame], DataFrame],
    hot: HotGroups | None = None,
    hot_rows: int = HOT_ROWS,
    work: Workspace | None = None,
) -> DataFrame:
    """``plain`` over the ordinary groups, ``sliced`` over the large ones.

    ``hot`` may come from a cheaper relation or name some of the keys only; a
    wrong guess costs time, never results. Rows of large groups are staged, as
    the slices, their bounds and their summaries all read them; the others are
    never written.
    """
    work = work or Workspace(df.sparkSession)
    hot = find_hot(df, keys, hot_rows, work) if hot is None else hot
    if hot.keys is None:
        return plain(df)
    few = hot.keys.count() <= MAX_BROADCAST_KEYS
    listed, on = F.broadcast(hot.keys) if few else hot.keys, hot.keys.columns
    large = work.stage(join_same(df, listed, on, "left_semi"), "rows")
    return plain(join_same(df, listed, on, "left_anti")).unionByName(sliced(large))
