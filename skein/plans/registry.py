"""All queries and their SQL, by name."""

from __future__ import annotations

from skein.plans import features, forms, graph, network, relational  # noqa: F401
from skein.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
