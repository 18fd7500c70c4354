"""All registered queries."""

from plumbline.plans import models_catalog, series_catalog, statistics_catalog, tables_catalog  # noqa: F401
from plumbline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
