"""All registered queries."""

from skein.plans import evaluation, extraction, graphs, histories, lookups, reporting, resolution, retrieval  # noqa: F401
from skein.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
