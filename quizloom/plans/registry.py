"""All queries of the core and their SQL, with every module that registers some imported."""

from __future__ import annotations

from quizloom.plans import bank, ingest, practice, records, reports, review, text  # noqa: F401
from quizloom.plans.queryset import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
