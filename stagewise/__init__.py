"""Funnel analytics as plain Spark DataFrame functions.

Every operator takes DataFrames and returns a DataFrame; nothing is collected
and no Python function runs per row.
"""

from stagewise.config import FunnelConfig
from stagewise.sources.tables import FunnelSources
from stagewise.plans.sales_funnel import sales_funnel

__all__ = ["FunnelConfig", "FunnelSources", "sales_funnel"]
