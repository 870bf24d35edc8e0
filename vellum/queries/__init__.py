"""The engine's own queries, by name, and their SQL."""

from vellum.queries import aggregates, bubbles, contours, filters, flow, geometry, joins, layout, pixels, text, tilted, windows  # noqa: F401
from vellum.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
