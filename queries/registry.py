"""Names, functions and SQL of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from queries.views import plain_types
from stagewise.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None):
    """Register a query; its SQL must give the same columns."""

    def add(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain_types(build(configure(spark), sf_dir))

        run.__name__, run.__doc__ = name, build.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql.strip()
        return build

    return add
