"""All registered queries of the library."""

from __future__ import annotations

from tracework.plans import documents, filings, linked, sequences, stores, walks  # noqa: F401  they register themselves
from tracework.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
