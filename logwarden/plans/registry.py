"""Importing this module registers every query."""

from __future__ import annotations

from logwarden.plans import analysis, correlation, detection, ingest, profiled, windowing  # noqa: F401
from logwarden.plans.catalog import ORACLES, QUERIES  # noqa: F401
