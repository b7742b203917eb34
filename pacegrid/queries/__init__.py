"""Registered queries, one module per family, each with its SQL twin next to it."""

from pacegrid.queries import columns, importance, joins, lines, models, racing, reshape, scalars, stats, trees, windows  # noqa: F401
from pacegrid.queries.base import REGISTRY

__all__ = ["REGISTRY"]
