"""Every registered query of the profiling library with the SQL that gives the same rows."""

from __future__ import annotations

from gradus.plans import ingestion, modelling, profiling, sequencing
from gradus.plans.binding import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "ingestion", "modelling", "profiling", "sequencing"]
