"""Imports every query module, so that the registry is complete."""

from kgloom.plans import funnel_queries, graph_queries, record_queries, run_queries, text_queries  # noqa: F401
from kgloom.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
