"""Helpers shared by the text operators: input columns, lineage cuts, worker path."""

from __future__ import annotations

import gc
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagewise.session import work_dir

_PER_BATCH, BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"
ROOT = str(Path(__file__).resolve().parents[2])

#: A word is a run of anything but these characters.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def column(name: str) -> Column:
    """Column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: str) -> DataFrame:
    """Only the columns an operator needs, so that other columns cannot clash."""
    return docs.select(
        column(id_col).cast("long").alias("doc_id"),
        column(text_col).cast("string").alias("text"),
        *[column(name).alias(alias) for alias, name in more.items()],
    )


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, name the shared checkpoint folder, keep batches small.

    Rows hold whole texts or sets, so a worker gets BATCH of them at a time unless the
    session asks for another number than Spark's own.
    """
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    if spark.conf.get(_PER_BATCH) == "10000":
        spark.conf.set(_PER_BATCH, BATCH)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(work_dir(spark))
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared checkpoint folder and go on from there.

    Rows and their partitions are fixed from here on, whatever executors are lost.
    """
    release(ready(df.sparkSession))
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let go of shuffle files that an earlier checkpoint has made needless.

    Spark removes them when the driver's JVM finds their lineage unreachable, which
    may otherwise be half an hour later.
    """
    gc.collect()
    spark._jvm.System.gc()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def deal(df: DataFrame, *keys, least: int = 12) -> DataFrame:
    """Hash-partition by keys into as many partitions as the session shuffles with."""
    n = max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)


def running_starts(df: DataFrame, group: list[str], part: str, order: list[str], size: str, out: str) -> DataFrame:
    """Add `out`: the sum of `size` over earlier rows of the group, rows ordered by (part, order).

    Sums inside a part come from one window per (group, part); only one total per
    (group, part) enters the window over the whole group, so a hot group is not
    gathered in one task.
    """
    from pyspark.sql import Window

    inside = Window.partitionBy(*group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*group, part).agg(F.sum(size).alias("_total"))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    rows = df.withColumn("_inner", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    keys = [rows[c].eqNullSafe(totals[c]) for c in [*group, part]]
    joined = rows.join(totals, on=keys, how="inner")
    return joined.select(*[rows[c] for c in df.columns], (F.col("_base") + F.col("_inner")).alias(out))
