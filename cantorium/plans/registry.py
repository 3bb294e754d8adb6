"""Queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from cantorium.plans import descriptive, literals, reports, scans, scores, similarity  # noqa: F401  they register themselves
from cantorium.plans.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
