"""Queries over the canonical tables; importing the package registers them."""

from assaylake.plans import control, engineering, extra, frozen, learning, more, qc, scoring, side, structure
from assaylake.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "control", "engineering", "extra", "frozen", "learning", "more", "qc", "scoring", "side", "structure"]
