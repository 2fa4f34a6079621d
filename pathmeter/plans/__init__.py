"""Registered queries over the driver tables, with their reference SQL."""

from pathmeter.plans import calibrate, live, measure, network, panels, reports, routing, selection, trees
from pathmeter.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "calibrate", "live", "measure", "network", "panels", "reports", "routing", "selection", "trees"]
