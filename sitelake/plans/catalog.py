"""Imports every query module so that the catalogue is complete."""

from sitelake.plans.registry import ORACLES, PLANS
from sitelake.plans import report_queries, site_queries, source_queries, split_queries, stream_queries, vector_queries  # noqa: F401

__all__ = ["ORACLES", "PLANS"]
