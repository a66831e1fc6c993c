"""Queries of the reference inventory and their SQL, by name."""

from folioframe.plans import audit, books, files, numbering, rules, tokens, transcription  # noqa: F401  each adds its queries
from folioframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
