"""All registered queries."""

from racebook.plans import joins, model, odds, race, streams, text, tickets, verify  # noqa: F401
from racebook.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
