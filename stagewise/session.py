"""Session settings and the shared work area for staged tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # one person may own a large share of a join's left side
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings the operators are planned for."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@cache
def _local_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="stagewise-")


def work_dir(spark: SparkSession) -> str:
    """Folder shared by all executors, as the cluster names it.

    Only a local session without the setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return _local_dir(spark.sparkContext.applicationId)


def _found(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever file system Spark reaches."""
    system, at = _found(spark, path)
    return system.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or folder, if it is there."""
    system, at = _found(spark, path)
    system.delete(at, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it is not there."""
    system, at = _found(spark, path)
    return [f.getPath().getName() for f in system.listStatus(at)] if system.exists(at) else []


class Workspace:
    """Writes a relation once and hands back a scan of it.

    A staged table cuts the lineage (a lost executor re-reads files instead of
    recomputing joins) and, unlike a cached one, keeps column pruning. As a
    context manager it removes its folder when the block ends: write the result
    before. It owns its folder alone; operators that stage something get it passed.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{work_dir(spark)}/run-{uuid.uuid4().hex}"
        self._used: dict[str, int] = {}

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        # a name may come again, when an operator runs twice
        n = self._used[name] = self._used.get(name, 0) + 1
        path = f"{self.root}/{name}" + (f"-{n}" if n > 1 else "")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Remove the folder of this workspace."""
        remove(self.spark, self.root)
