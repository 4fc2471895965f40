"""All registered queries."""

from queries import facts, funnel, keyed, labelling, matching  # noqa: F401
from queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
