"""All queries with their SQL."""

from __future__ import annotations

from . import more  # noqa: F401  (adds its queries)
from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
