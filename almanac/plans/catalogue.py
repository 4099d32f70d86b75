"""Imports every catalogue module so that their queries register."""

from __future__ import annotations

from almanac.plans import q_eval, q_hierarchy, q_interpret, q_misc, q_models, q_panel, q_stats, q_timeseries, q_transform  # noqa: F401
from almanac.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
