"""Registered queries over the supplied tables, and independent SQL for them."""

from seagrid.checks.oracles import ORACLES
from seagrid.checks.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
