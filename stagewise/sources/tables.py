"""The source tables of the funnel and its sink."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagewise.functions.columns import period
from stagewise.session import Workspace

# rows that one task of the sink sorts, where their number is known
TASK_ROWS = 200_000


@dataclass(frozen=True)
class FunnelSources:
    """One DataFrame per source table, read lazily."""

    payments: DataFrame
    orders: DataFrame
    lessons: DataFrame
    lessons_students: DataFrame
    lessons_students_statuses: DataFrame
    lesson_creation_logs: DataFrame
    students: DataFrame
    parents: DataFrame
    landing_leads: DataFrame
    subjects: DataFrame
    traffic_source: DataFrame
    traffic_source_lead: DataFrame

    @classmethod
    def names(cls) -> list[str]:
        return [f.name for f in fields(cls)]

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str) -> "FunnelSources":
        return cls(**{n: spark.read.parquet(f"{root.rstrip('/')}/{n}") for n in cls.names()})

    @classmethod
    def from_tables(cls, spark: SparkSession, tables: Mapping[str, str]) -> "FunnelSources":
        """``tables`` maps each source to a catalog name such as ``schema.table``."""
        return cls(**{n: spark.table(tables.get(n, n)) for n in cls.names()})


# the column by which each history table meets the others
BUCKET_KEYS = {
    "payments": "client_id",
    "orders": "payment_id",
    "lessons": "id",
    "lessons_students": "student_id",
    "lessons_students_statuses": "lesson_id",
    "lesson_creation_logs": "lesson_id",
    "students": "parent_id",
    "parents": "id",
    "traffic_source": "parent_id",
}


def write_bucketed(src: FunnelSources, root: str, prefix: str, buckets: int) -> dict[str, str]:
    """Lay the sources out as catalog tables, history in buckets by the key it is joined by.

    Returns the names for ``FunnelSources.from_tables``; tables are ``<prefix><source>``, files lie
    under ``root``. A join on the key then moves only the other side, which the run has
    already narrowed, to the buckets. Take as many buckets as give files of a few hundred MB,
    and at least as many as ``spark.sql.shuffle.partitions``. Rows go to their bucket before
    they are written, so that there is one file per bucket.
    """
    names = {}
    for name in FunnelSources.names():
        df, key = getattr(src, name), BUCKET_KEYS.get(name)
        writer = df.write if key is None else df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
        names[name] = prefix + name
        writer.mode("overwrite").option("path", f"{root.rstrip('/')}/{name}").saveAsTable(names[name])
    return names


def write_fact(
    fact: DataFrame,
    path: str,
    mode: str = "overwrite",
    replace_months: bool = False,
    staged: bool = False,
    ordered: bool = True,
    by_month: bool = True,
    spread: Callable[[DataFrame], DataFrame] | None = None,
    rows: int = 0,
) -> None:
    """Write the fact ordered by lead time, in one folder per lead month.

    The range sort splits equal times by request and phone, and as each task
    holds one stretch of time it opens few month folders. With ``replace_months`` only
    the folders of months in ``fact`` are overwritten, the others keep their files.

    A range sort reads its rows twice, once to choose the ranges. So that they are not worked
    out twice the fact is staged first, unless it is a mere scan (``staged``). Without
    ``ordered`` there is no sort at all: the folders by month hold rows as they come. Without
    ``by_month`` there is one folder, for rows that are still on their way: a task that writes
    many folders sorts its rows by them.

    ``spread`` makes several rows of one that keep its place in the order, ``rows`` in all. They
    come out after the shuffle, in tasks of about ``TASK_ROWS`` rows.
    """
    if ordered and not staged:
        with Workspace(fact.sparkSession) as work:
            write_fact(work.stage(fact, "unordered"), path, mode, replace_months, staged=True)
        return
    months = fact.withColumn("lead_month", period("month", F.col("lead_created")))
    order = ["lead_month", "lead_created", "lesson_id", "phone"]
    if spread is not None:
        out = spread(months.repartitionByRange(rows // TASK_ROWS + 1, *order)).sortWithinPartitions(*order)
    else:
        out = months.orderBy(*order) if ordered else months
    writer = out.write.mode(mode).option("partitionOverwriteMode", "dynamic" if replace_months else "static")
    (writer.partitionBy("lead_month") if by_month else writer).parquet(path)
